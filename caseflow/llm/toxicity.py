"""Toxicity by a factorisation machine over hashed terms.

A text's terms are its distinct words (A-Z lower-cased; digits, letters and non-ASCII bytes) and the words' first 4,
5 and 6 bytes, hashed to SLOTS slots. Every term of the learning sample gets a weight and factors, none is screened out, so that terms
which tell nothing by themselves can still tell something together. The score is sigmoid(w0 + x sum w_i + x**2 sum_{i<j} <v_i, v_j>) over the
text's m terms, x = 1 / sqrt(m): the pairwise part, of FACTORS dimensions a term, is what an additive linear model misses.

Learning takes a bounded sample: about `sample` labelled texts at most (hashes of id and text decide), of which the driver gets
the terms' slots. The threshold 0.5 holds for the calibrated score: after training, a scale and a shift are fitted to the eighth of the
sample that training left out.

Defined results: null is the empty text; an empty text, or one without any known term, scores the bias alone; without
labelled rows of both classes every score is the share of label 1 (0 if there is none). Repeated rows get equal
scores, texts of equal terms too, an empty table an empty result. Only the named columns are read; kept columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm import columnar as C

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
PREFIXES = (4, 5, 6)
FACTORS = 4
SAMPLE = 10_000
EPOCHS, BATCH, RATE, L2 = 10, 64, 1.0, 1e-5
#: Standard deviation of the factors at first: from 0 they would never move.
INIT = 0.05


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots of all texts' distinct terms, offsets by text)."""
    data = C.LOWER[data]
    starts, ends, first = C.words(data, offsets, C.ALNUM)
    text, pairs = C.owner(first), []
    total = C.running(data)
    for n in (None, *PREFIXES):
        use = slice(None) if n is None else np.flatnonzero(ends - starts > n)
        a = starts[use]
        slot = (C.hash_of(total, a, ends[use] if n is None else a + n) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        pairs.append(text[use] * SLOTS + slot)
    pair = np.unique(np.concatenate(pairs))
    return pair % SLOTS, np.searchsorted(pair, np.arange(len(offsets)) * SLOTS)


def _segments(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows; of an empty range 0."""
    out = np.zeros((len(offsets) - 1, *x.shape[1:]), x.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(x, offsets[full])
    return out


@dataclass
class Machine:
    """w0; w (terms) and v (terms, factors) of the sorted known slots; the calibration of the raw score."""

    slots: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def index(self) -> np.ndarray:
        """Place of each slot among the known ones; of others one behind them."""
        out = np.full(SLOTS, len(self.slots), np.int32)
        out[self.slots] = np.arange(len(self.slots))
        return out

    def raw(self, slots: np.ndarray, offsets: np.ndarray, index: np.ndarray | None = None) -> np.ndarray:
        ids = (self.index() if index is None else index)[slots]
        return _raw(self.w0, np.append(self.w, np.float32(0)), np.concatenate([self.v, np.zeros((1, FACTORS), np.float32)]), ids, offsets)

    def score(self, slots: np.ndarray, offsets: np.ndarray, index: np.ndarray | None = None) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * self.raw(slots, offsets, index).astype(np.float64) + self.shift, -500, 500)))


def _raw(w0: float, w: np.ndarray, v: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    x, own = np.maximum(np.diff(offsets), 1) ** -0.5, v[ids]
    both = _segments(own, offsets)
    pairs = np.einsum("ij,ij->i", both, both) - _segments(np.einsum("ij,ij->i", own, own), offsets)
    return w0 + x * _segments(w[ids], offsets) + 0.5 * x * x * pairs


def train(known: np.ndarray, slots: np.ndarray, offsets: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Mini-batch Adagrad on the logistic loss; the same input gives the same machine. known: sorted slots."""
    rng = np.random.default_rng(seed)
    left_out = np.arange(len(y)) % 8 == 7
    fitted = np.flatnonzero(~left_out)
    k = len(known)
    ids = np.zeros(SLOTS, np.int32)
    ids[known] = np.arange(k)
    ids = ids[slots]
    w, v = np.zeros(k, np.float32), rng.normal(0, INIT, (k, FACTORS)).astype(np.float32)
    gw, gv = np.ones(k, np.float32), np.ones((k, FACTORS), np.float32)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w0, g0 = np.log(share / (1 - share)), 1.0
    size = np.diff(offsets)
    for _ in range(epochs):
        order = rng.permutation(fitted)
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            m = size[rows]
            at, offs = _spans(offsets, rows)
            own, x = ids[at], np.maximum(m, 1) ** -0.5
            vv = v[own]
            err = 1.0 / (1.0 + np.exp(-np.clip(_raw(w0, w, v, own, offs), -30, 30))) - y[rows]
            touched, back = np.unique(own, return_inverse=True)
            grad = np.repeat(err * x * x, m)[:, None] * (np.repeat(_segments(vv, offs), m, 0) - vv)
            dw = np.bincount(back, np.repeat(err * x, m), len(touched)).astype(np.float32) + L2 * w[touched]
            dv = np.stack([np.bincount(back, grad[:, f], len(touched)) for f in range(FACTORS)], 1).astype(np.float32) + L2 * v[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            w[touched] -= RATE * dw / np.sqrt(gw[touched])
            v[touched] -= RATE * dv / np.sqrt(gv[touched])
            d0 = float(err.sum())
            g0 += d0 * d0
            w0 -= RATE * d0 / g0**0.5
    machine = Machine(known, float(w0), w, v)
    if not left_out.any():
        return machine
    raw, rows = [], np.flatnonzero(left_out)
    for a in range(0, len(rows), BATCH):  # a few texts at a time: their factors take much more memory than their slots
        at, offs = _spans(offsets, rows[a : a + BATCH])
        raw.append(_raw(w0, w, v, ids[at], offs))
    return _calibrate(machine, np.concatenate(raw), y[left_out])


def _spans(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all terms of the rows, offsets by row)."""
    m = np.diff(offsets)[rows]
    offs = np.concatenate([[0], np.cumsum(m)])
    return np.repeat(offsets[rows] - offs[:-1], m) + np.arange(offs[-1]), offs


def _calibrate(machine: Machine, raw: np.ndarray, y: np.ndarray) -> Machine:
    """Two-parameter logistic regression of the labels on the raw score (Newton's steps)."""
    s = raw.astype(np.float64)
    b = np.array([1.0, 0.0])
    x = np.stack([s, np.ones(len(s))], 1)
    for _ in range(20):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (p - y) + 1e-2 * (b - [1.0, 0.0])
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        b = b - np.clip(np.linalg.solve(h, g), -1, 1)
    if b[0] > 0:
        machine.scale, machine.shift = float(b[0]), float(b[1])
    return machine


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """Machine from the texts whose id has a label 0 or 1 in `labels` (other labels and null are left out)."""
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    thin = lambda rows, n, by: rows.where(F.pmod(F.xxhash64(by, F.lit("toxicity sample")), F.lit(1_000_000)) < int(min(1.0, sample / max(n, 1)) * 1_000_000))
    marks = thin(marks, marks.count(), "id")  # about `sample` rows of 12 bytes: the only thing that is broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = C.written(texts.join(F.broadcast(marks), "id").select("text", "y"), "labelled")
    rows = thin(rows, rows.count(), "text")  # ids may repeat

    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).first()
    n, k = totals["n"], totals["k"] or 0
    if k in (0, n):
        share = k / n if n else 0.0
        w0 = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return Machine(np.zeros(0, np.int64), w0, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))

    def own_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in C.chunks(batch, "text"):
                slots, offs = terms(data, offsets)
                slots = slots.astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([slots[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary())], names=["y", "slots"])

    got = rows.mapInArrow(own_terms, "y int, slots binary").toArrow()
    own = sorted(zip(got.column("slots").to_pylist(), got.column("y").to_pylist(), strict=True))  # any partitioning, the same order
    del got
    offsets, y = np.concatenate([[0], np.cumsum([len(a) // 4 for a, _ in own])]), np.array([b for _, b in own], np.float32)
    slots = np.frombuffer(b"".join(a for a, _ in own), np.int32)
    del own
    return train(np.unique(slots), slots, offsets, y)


def score(docs: DataFrame, machine: Machine, keep: dict[str, Column | None], text_col: str = "text") -> DataFrame:
    """(the kept columns, score, predicted). keep: None stands for the column of docs of that name; a text that is kept so is not sent twice."""
    sent = text_col in keep and keep[text_col] is None
    own_text = text_col if sent else C.free(list(keep), "text")[0]
    rows = docs.select(*[F.col(k) if c is None else c.alias(k) for k, c in keep.items()], *([] if sent else [F.col(text_col).alias(own_text)]))
    schema = C.extend(rows.schema.fields[: len(keep)], "score double, predicted int")
    kept = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 12 + 4 * FACTORS bytes a slot, 30 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Machine = shared.value
        index = m.index()
        for batch in batches:
            for part, data, offsets in C.chunks(batch, own_text):
                s = m.score(*terms(data, offsets), index)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)
