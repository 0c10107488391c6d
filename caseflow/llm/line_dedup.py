"""Fuzzy line dedup by MinHash: one line of each group of near-equal lines stays in the corpus.

A line's set is its distinct substrings of `shingle` characters (a shorter line is one shingle): SHINGLE of them by
default, FINE in the query and the pipeline, where at a similarity of 0.8 one changed character links lines of 40
characters and one changed word of five lines of some 80. MinHash signatures, cut into BANDS bands of ROWS values, are taken of substrings that are
SPAN characters longer: unrelated lines share many substrings of 4 characters and hardly any of 7, so that few of them meet in a band, while a
similarity of 0.8 by substrings of 4 is one of 0.675 at least by those of 7 (an edit that changes m of the former changes 7 / 4 m
of the latter at most), at which a link is missed in 1 of 100 cases (1 - (1 - 0.675**3)**13 = 0.9916). Lines of fewer than some 20 characters are the
exception: their links may be missed more often. Candidates whose sizes or parities rule a link out (columnar.may_link(), which loses none) never leave the join; the others are verified on the whole sets (of 54-bit hashes); verified
links become components by distributed union-find (components.linked(), which never gives out a bucket that is one
component already). Of each component the first line stays, by (id, hash of text, line number).

Lines are cut at "\\n" and identified by 64-bit hashes: among N different lines, N**2 / 2**65 pairs are expected to be taken for equal, one
in 6 * 10**9 lines. Lines of white space alone are never compared and stay.

Defined results: a null text stays null, an empty one empty; rows equal in id and text are one document and get equal
results; a null id comes before all others; an empty table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm import columnar as C
from caseflow.llm import components

SHINGLE, FINE, SPAN, BANDS, ROWS = 8, 4, 3, 13, 3
NUM, DEN = 80, 100
PARITIES = 512

_SLOPES = (C.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * C._BASE) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (C.mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64) * C._BASE) >> np.uint64(32)).astype(np.uint32)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number in the text, start, end) of every line; a text has one line more than it has line ends."""
    n = len(offsets) - 1
    cut = np.flatnonzero(data == 0x0A)
    text = np.searchsorted(offsets[1:], cut, "right")
    starts = np.concatenate([offsets[:-1], cut + 1])
    ends = np.concatenate([offsets[1:], cut])
    owner = np.concatenate([np.arange(n), text])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    order = np.lexsort((ends, np.concatenate([np.arange(n), text])))
    ends = ends[order]
    return owner, np.arange(len(owner)) - np.searchsorted(owner, owner), starts, ends


def shingle_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all lines in turn, first shingle of each line, one more at the end); k counts characters."""
    # where each character of UTF-8 starts; a line's end is the start of what follows
    char = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    low, high = np.searchsorted(char, starts), np.searchsorted(char, ends)
    size = np.maximum(high - low - k + 1, 1)
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(low - first[:-1], size) + np.arange(first[-1])
    return C.span_hash(data, char[at], char[np.minimum(at + k, np.repeat(high, size))]), first


#: Shingles that are hashed in one go: they and their products stay in the cache.
_STEP = 1 << 15


def bands(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Band keys (line, band), of substrings of k + SPAN characters."""
    h, first = shingle_hashes(data, starts, ends, k + SPAN)
    h = (h >> np.uint64(32)).astype(np.uint32)
    low = np.zeros((BANDS * ROWS, len(starts)), np.uint32)
    cut = np.unique(np.concatenate([[0], np.searchsorted(first, np.arange(_STEP, max(first[-1], 1), _STEP)), [len(starts)]]))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own, at = h[first[a] : first[b]], first[a:b] - first[a]
        work = np.empty_like(own)
        for j in range(BANDS * ROWS):
            np.multiply(own, _SLOPES[j], out=work)
            np.add(work, _SHIFTS[j], out=work)
            low[j, a:b] = np.minimum.reduceat(work, at)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for j in range(BANDS * ROWS):
        keys[:, j // ROWS] = C.mix(keys[:, j // ROWS] * C._BASE + low[j].astype(np.uint64) + np.uint64(j + 1))
    return keys


#: Lines that are sorted together, and the bits of a shingle's hash that count then: a line's number and its hash make one number, which is sorted without an index.
_LINES, _BITS = 1 << 10, np.uint64(54)


def _blocks(*parts: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(number of lines, their numbers and hashes in one, sorted) of each block of lines; parts: (hashes of _BITS bits, first of each line) of the same lines."""
    n = len(parts[0][1]) - 1
    for a in range(0, n, _LINES):
        b = min(n, a + _LINES)
        keys = np.concatenate([h[first[a] : first[b]] | np.repeat(np.arange(b - a, dtype=np.uint64) << _BITS, np.diff(first[a : b + 1])) for h, first in parts])
        keys.sort()
        yield b - a, keys


def _counts(keys: np.ndarray, n: int) -> np.ndarray:
    return np.bincount((keys >> _BITS).astype(np.int64), minlength=n)


def _sets(lines_: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each line, offsets by line)."""
    data, offsets = C.column(pa.table({"raw": lines_}), "raw")
    h, first = shingle_hashes(data, offsets[:-1], offsets[1:], k)
    h >>= np.uint64(64) - _BITS
    own, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for n, keys in _blocks((h, first)):
        keep = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=keep[1:])
        keys = keys[keep]
        sizes.append(_counts(keys, n))
        own.append(keys & ((np.uint64(1) << _BITS) - np.uint64(1)))
    return np.concatenate(own), np.cumsum(np.concatenate(sizes))


def similar(xs: pa.Array, ys: pa.Array, num: int, den: int, k: int = SHINGLE) -> np.ndarray:
    """Whether the Jaccard similarity of each pair of lines is num / den or more, by their whole sets."""
    (a, first_a), (b, first_b) = _sets(xs, k), _sets(ys, k)
    both = np.concatenate([np.zeros(0, np.int64), *(_counts(keys[1:][keys[1:] == keys[:-1]], n) for n, keys in _blocks((a, first_a), (b, first_b)))])
    return both * den >= num * (np.diff(first_a) + np.diff(first_b) - both)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.octet_length(text).alias("k2"))


def _occurrences(docs: DataFrame, k: int) -> DataFrame:
    """(id, k1, k2, no, line, bands) of all lines that are compared; bands only once a slice for each line."""
    schema = C.extend([docs.schema["id"]], "k1 long, k2 int, no int, line long, bands array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in C.chunks(batch, "text"):
                text, no, starts, ends = lines(data, offsets)
                filled = np.concatenate([[0], np.cumsum(C.NON_SPACE[data])])
                full = np.flatnonzero(filled[ends] > filled[starts])
                text, no, starts, ends = text[full], no[full], starts[full], ends[full]
                line = C.span_hash(data, starts, ends)
                _, one = np.unique(line, return_index=True)
                size = np.zeros(len(line), np.int32)
                size[one] = BANDS
                one = np.flatnonzero(size)
                keys = bands(data, starts[one], ends[one], k)
                offs = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                own = part.select(["id", "k1", "k2"]).take(pa.array(text))
                yield pa.RecordBatch.from_arrays(
                    [own.column("id"), own.column("k1"), own.column("k2"), pa.array(no.astype(np.int32)), pa.array(line.view(np.int64)), pa.ListArray.from_arrays(offs, pa.array(keys.reshape(-1).view(np.int64)))],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)


def _texts(docs: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """(line, raw, n, q) of the lines at (k1, k2, no): bytes, size of the set, parities."""
    own = places.groupBy("k1", "k2").agg(F.collect_list(F.struct("no", "line")).alias("places"))
    # equal texts give equal lines: one of each, before they are joined by the same keys
    rows = docs.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(own, ["k1", "k2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in C.chunks(batch, "text"):
                line, raw = [], []
                for text, own in zip(part.column("text"), part.column("places").to_pylist(), strict=True):
                    cut = text.as_py().encode("utf-8").split(b"\n")
                    line += [p["line"] for p in own]
                    raw += [cut[p["no"]] for p in own]
                raw = pa.array(raw, pa.binary())
                h, offs = _sets(raw, k)
                q = C.parities(h, offs, PARITIES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(line, pa.int64()), raw, pa.array(np.diff(offs), pa.int32()), pa.ListArray.from_arrays((np.arange(len(raw) + 1) * q.shape[1]).astype(np.int32), pa.array(q.reshape(-1).view(np.int64)))],
                    names=["line", "raw", "n", "q"],
                )

    return rows.select("text", "places").mapInArrow(run, "line long, raw binary, n int, q array<long>")


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN, shingle: int = SHINGLE) -> DataFrame:
    """(id, k1, k2, gone): numbers of the lines that go, for each document that loses some."""
    rows = _keyed(docs, id_col, text_col)
    found = C.written(_occurrences(rows, shingle), "lines")
    lists = found.where(F.size("bands") > 0).select(F.explode("bands").alias("token"), F.col("line").alias("node"))
    # one shuffle for both: a window spills its rows, however many have one token
    by = Window.partitionBy("token")
    shared = lists.select("token", "node", F.min("node").over(by).alias("lo"), F.max("node").over(by).alias("hi")).where("lo != hi")
    buckets = C.written(shared.select("token", "node").distinct(), "buckets")
    # the texts of all lines in a bucket with others, one place of each
    wanted = buckets.select(F.col("node").alias("line")).distinct()
    places = found.where(F.size("bands") > 0).join(wanted, "line").groupBy("line").agg(F.min(F.struct("k1", "k2", "no")).alias("p")).select("line", "p.*")
    texts = C.written(_texts(rows, places, shingle), "texts")
    sets = texts.select(F.col("line").alias("node"), F.struct("n", *[F.col("q")[i].alias(f"q{i}") for i in range(PARITIES // 64)]).alias("a"))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda s: texts.select(F.col("line").alias(s), F.col("raw").alias(f"r{s}"))
        both = pairs.join(side("x"), "x").join(side("y"), "y")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, _, _ in C.chunks(batch, "rx"):
                    good = pa.array(similar(part.column("rx"), part.column("ry"), num, den, shingle))
                    yield pa.RecordBatch.from_arrays([part.column("x").filter(good), part.column("y").filter(good)], names=["u", "v"])

        return both.mapInArrow(run, "u long, v long")

    lists = C.written(buckets.join(sets, "node"), "lists")
    roots = components.linked(lists, verified, C.may_link(num, den, PARITIES))
    C.dropped(buckets, texts, lists)
    own = found.drop("bands").join(roots.select(F.col("u").alias("line"), F.col("v").alias("root")), "line", "left").withColumn("root", F.coalesce("root", "line"))
    # first occurrence of every component; rows equal in id and text are one
    first = own.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "k1", "no")).alias("first")).where("n > 1")
    gone = own.join(first, "root").where(~F.struct("id", "k1", "no").eqNullSafe(F.col("first")))
    return gone.groupBy("id", "k1", "k2").agg(F.collect_set("no").alias("gone"))


def _joined(docs: DataFrame, id_col: str, text_col: str, keep: list[str], **options) -> tuple[DataFrame, str, str]:
    """The kept columns, and columns of the text and of the lines that go under names of their own."""
    gone = removed_lines(docs, id_col, text_col, **options)
    own_text, own_id, k1, k2, g_id, g1, g2, g = C.free(keep, "own_text", "own_id", "k1", "k2", "gone_id", "gone_k1", "gone_k2", "gone")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sent = [] if text_col in keep else [F.col(text_col).alias(own_text)]  # a text that is kept is not shuffled twice
    own_text = own_text if sent else text_col
    rows = docs.select(*keep, *sent, F.col(id_col).alias(own_id), F.xxhash64(text).alias(k1), F.octet_length(text).alias(k2))
    same = F.col(own_id).eqNullSafe(F.col(g_id)) & (F.col(k1) == F.col(g1)) & (F.col(k2) == F.col(g2))
    gone = gone.select(F.col("id").alias(g_id), F.col("k1").alias(g1), F.col("k2").alias(g2), F.col("gone").alias(g))
    return rows.join(gone, same, "left").select(*keep, *([own_text] if sent else []), g), own_text, g


def _left(text: str, gone: list[int] | None) -> tuple[int, str]:
    """(number of lines, text of the lines that stay)."""
    cut = text.split("\n")
    out = set(gone or ())
    return len(cut), "\n".join([x for i, x in enumerate(cut) if i not in out]) if out else text


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the lines that stay; a text may become empty, rows never go."""
    rows, own_text, gone = _joined(docs, id_col, text_col, docs.columns, **options)
    schema, t = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(len(schema.names))]
            columns[t] = pa.array([None if x is None else _left(x, g)[1] for x, g in zip(batch.column(own_text).to_pylist(), batch.column(gone).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_lines, n_removed, kept_sha256) of every row."""
    rows, own_text, gone = _joined(docs, id_col, text_col, [id_col], **options)
    schema = C.extend(rows.schema.fields[:1], "n_lines long, n_removed long, kept_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, g in zip(batch.column(own_text).to_pylist(), batch.column(gone).to_pylist(), strict=True):
                n, left = _left(x or "", g)
                out.append((n, len(g or ()), hashlib.sha256(left.encode("utf-8")).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)
