"""Substring dedup: words inside a window of `window` words that also starts elsewhere are removed.

Suffix automata of the whole corpus would have to meet every document, which is quadratic in their number. So the
reference is cut down first, without loss, and its shards are dealt out instead of broadcast to all:

1. Anchors. Every window has one anchor, its least hash of SEED consecutive words (the leftmost of equals). Windows of
   one text with the same anchor lie side by side and form a region. Equal windows have equal anchors at the same
   place, so a window can only repeat inside regions of equal anchors, and is looked for nowhere else.
2. An anchor that occurs once has no repeat. Where all regions of an anchor are equal, all their windows repeat.
3. The other anchors' distinct regions, with their multiplicity, are the reference. They are dealt to tasks by anchor;
   a task builds generalised suffix automata over shards of at most SHARD_WORDS words (an anchor is never cut), counts
   occurrences per state, and streams the regions through: at each word the matching statistic's state that holds the
   last `window` words tells how often they occur. Windows with two or more occurrences are repeats.
4. Anchors with more than HOT distinct regions would make one shard too large. Their regions are cut into windows,
   which are dealt by the window's own hash and counted.

Words are compared as 64-bit hashes in (1), (2) and (4), regions as two of them; (3) compares the words themselves.

Words are runs of bytes other than ASCII white space, unchanged. Windows are judged on the input, never on what is
left. Defined results: null has no words; texts shorter than the window are never touched; repeated rows repeat each
other's windows; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm import columnar as C

WINDOW = 35
SEED = 8
SHARD_WORDS = 200_000
HOT = 20_000


def anchors(hashes: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, anchor word, first window, last window) of every region; words are counted through all texts."""
    span = window - seed + 1  # seeds a window
    if len(hashes) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    value = C.window_hash(hashes, seed)
    at = np.arange(len(value))
    low, place, size = value, at, 1
    while size < span:  # sliding minimum by doubling; the left one wins ties
        step = min(size, span - size)
        a, b = low[:-step], low[step:]
        left = a <= b
        low, place = np.where(left, a, b), np.where(left, place[:-step], place[step:])
        size += step
    ok = C.starts_of(first, window)[: len(place)]
    start = np.flatnonzero(ok)
    place = place[start]
    if not len(start):
        return start, start, start, start
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.concatenate([head[1:], [len(start)]]) - 1
    return np.searchsorted(first, start[head], "right") - 1, place[head], start[head], start[last]


class Automaton:
    """Generalised suffix automaton over sequences of numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.count = [-1], [0], [0]

    def add(self, sequence: list[int]) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None and size[q] == size[last] + 1:  # already there
                last = q
                continue
            clone = -1
            if q is not None:
                clone = self._clone(q, last, c)
                last = clone
                continue
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(0)
            self.count.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if size[q] == size[p] + 1 else self._clone(q, p, c)
            last = cur

    def _clone(self, q: int, p: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        self.count.append(0)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def weigh(self, sequences: list[list[int]], times: list[int]) -> None:
        """Occurrences of each state's strings, each sequence counting so many times."""
        nxt, count = self.next, self.count
        for sequence, n in zip(sequences, times, strict=True):
            at = 0
            for c in sequence:
                at = nxt[at][c]
                count[at] += n
        for s in sorted(range(1, len(nxt)), key=self.size.__getitem__, reverse=True):
            count[self.link[s]] += count[s]

    def repeats(self, sequence: list[int], window: int) -> list[int]:
        """Starts of the sequence's windows that occur twice or more."""
        out, at, length = [], 0, 0
        nxt, link, size, count = self.next, self.link, self.size, self.count
        for i, c in enumerate(sequence):
            while at and c not in nxt[at]:
                at = link[at]
                length = size[at]
            if c in nxt[at]:
                at, length = nxt[at][c], length + 1
            if length >= window:
                while size[link[at]] >= window:
                    at = link[at]
                length = min(length, size[at])
                if count[at] >= 2:
                    out.append(i - window + 1)
        return out


def _keyed(docs: DataFrame, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [text.alias("text"), F.xxhash64(text).alias("k1"), F.octet_length(text).alias("k2")]


def _regions(docs: DataFrame, text_col: str, window: int, seed: int) -> DataFrame:
    """(k1, k2, anchor, region, lo, hi) of all regions: identity of the text, hashes, first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in C.chunks(batch, "text"):
                starts, ends, first = C.words(data, offsets, C.NON_SPACE)
                h = C.span_hash(data, starts, ends)
                text, place, lo, hi = anchors(h, first, window, seed)
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(C.mix(h + np.uint64(1)) * C._power(0, len(h)), out=total[1:])
                region = C.mix((total[hi + window] - total[lo]) * C._power(1, len(total))[lo] + (hi - lo).astype(np.uint64))
                anchor = C.window_hash(h, seed)[place] if len(place) else np.zeros(0, np.uint64)
                k1, k2 = (part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("k1", "k2"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1), pa.array(k2), pa.array(anchor.view(np.int64)), pa.array(region.view(np.int64)), pa.array((lo - first[text]).astype(np.int32)), pa.array((hi - lo).astype(np.int16))],
                    names=["k1", "k2", "anchor", "region", "lo", "more"],
                )

    return docs.select(*_keyed(docs, text_col)).mapInArrow(run, "k1 long, k2 int, anchor long, region long, lo int, more short")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """(anchor, region, n, words binary) from (text, places array<struct<lo, more, anchor, region, n>>): the regions' words, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in C.chunks(batch, "text"):
                starts, ends, first = C.words(data, offsets, C.NON_SPACE)
                raw, out = data.tobytes(), []
                for i, places in enumerate(part.column("places").to_pylist()):
                    for p in places:
                        a = first[i] + p["lo"]
                        own = range(a, a + p["more"] + window)
                        out.append((p["anchor"], p["region"], p["n"], b" ".join([raw[starts[j] : ends[j]] for j in own])))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                for a in range(0, len(out), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 20_000], strict=True), types, strict=True)], names=["anchor", "region", "n", "words"])

    return texts.mapInArrow(run, "anchor long, region long, n long, words binary")


def _matched(reference: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(anchor, region, offsets array<short>): windows of each region that repeat, by suffix automata of shards."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        ids: dict[bytes, int] = {}
        sequences = [[ids.setdefault(w, len(ids)) for w in words.split(b" ")] for _, _, _, words in rows]
        automaton = Automaton()
        for s in sequences:
            automaton.add(s)
        automaton.weigh(sequences, [r[2] for r in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([automaton.repeats(s, window) for s in sequences], pa.list_(pa.int16()))],
            names=["anchor", "region", "offsets"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "region", "n", "words")), strict=True):
                if words >= shard_words and row[0] != last:
                    yield solve(held)
                    held, words = [], 0
                held.append(row)
                words += row[3].count(b" ") + 1
                last = row[0]
        if held:
            yield solve(held)

    return reference.repartition("anchor").sortWithinPartitions("anchor", "region").mapInArrow(run, "anchor long, region long, offsets array<short>")


def _counted(reference: DataFrame, window: int) -> DataFrame:
    """The same for regions of hot anchors: their windows, dealt by two hashes of their own and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in C.chunks(batch, "words"):
                starts, ends, first = C.words(data, offsets, C.NON_SPACE)
                a, b = (C.window_hash(C.span_hash(data, starts, ends, s), window) for s in (0, 1))
                at = np.flatnonzero(C.starts_of(first, window)[: len(a)])
                text = np.searchsorted(first, at, "right") - 1
                own = [part.column(c).to_numpy(zero_copy_only=False)[text] for c in ("anchor", "region", "n")]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x) for x in own), pa.array((at - first[text]).astype(np.int16)), pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64))],
                    names=["anchor", "region", "n", "offset", "a", "b"],
                )

    windows = reference.mapInArrow(run, "anchor long, region long, n long, offset short, a long, b long")
    total = windows.groupBy("a", "b").agg(F.sum("n").alias("total")).where("total > 1").select("a", "b")
    return windows.join(total, ["a", "b"]).groupBy("anchor", "region").agg(F.collect_list("offset").alias("offsets"))


def repeated_windows(docs: DataFrame, text_col: str = "text", window: int = WINDOW, seed: int = SEED, shard_words: int = SHARD_WORDS, hot: int = HOT) -> DataFrame:
    """(k1, k2, places): for each text with repeats (xxhash64, bytes) its runs of repeated windows, array<struct<lo, offsets>>.

    Offsets count from lo; null offsets with `more` mean all windows from lo to lo + more.
    """
    found = C.written(_regions(docs, text_col, window, seed), "regions")
    by_anchor = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("region").alias("a"), F.max("region").alias("b")).where("n > 1")
    # written, so that both sides of the join below are plain exchanges, whose hot anchors adaptive execution splits
    by_anchor = C.written(by_anchor.select("anchor", (F.col("a") == F.col("b")).alias("equal")), "anchors")
    found = C.written(found.join(by_anchor, "anchor"), "repeated")
    # distinct regions of the others, one place of each
    reference = found.where("not equal").groupBy("anchor", "region").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "lo", "more")).alias("p"))
    reference = C.written(reference.select("anchor", "region", "n", "p.*"), "reference")
    places = reference.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "more", "anchor", "region", "n")).alias("places"))
    texts = docs.select(*_keyed(docs, text_col)).join(places, ["k1", "k2"])
    # equal texts: only one of them is cut
    texts = texts.groupBy("k1", "k2").agg(F.any_value("text").alias("text"), F.any_value("places").alias("places")).select("text", "places")
    reference = C.written(_cut(texts, window), "reference")
    many = reference.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("anchor")
    matched = _matched(reference.join(many, "anchor", "left_anti"), window, shard_words)
    if many.limit(1).count():
        matched = matched.unionByName(_counted(reference.join(many, "anchor", "left_semi"), window).select("anchor", "region", "offsets"))
    matched = C.written(matched.where(F.size("offsets") > 0), "matched")
    some = found.where("not equal").join(matched, ["anchor", "region"]).select("k1", "k2", "lo", F.lit(None).cast("short").alias("more"), "offsets")
    all_ = found.where("equal").select("k1", "k2", "lo", "more", F.lit(None).cast("array<short>").alias("offsets"))
    return all_.unionByName(some).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "more", "offsets")).alias("places"))


def _with_places(docs: DataFrame, keep: list[Column], text_col: str, **options) -> DataFrame:
    """The kept columns as c0, c1, ..., so that no name of the input meets those used here, then text and places."""
    places = repeated_windows(docs, text_col, **options)
    kept = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[c.alias(k) for c, k in zip(keep, kept, strict=True)], *[c.alias(n) for c, n in zip(_keyed(docs, text_col), ("text", "k1", "k2"), strict=True)])
    return rows.join(places.select("k1", "k2", "places"), ["k1", "k2"], "left").select(*kept, "text", "places")


def _kept(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of words, kept words) of each text."""
    starts, ends, first = C.words(data, offsets, C.NON_SPACE)
    raw = data.tobytes()
    places = part.column("places")
    for i in range(part.num_rows):
        n, own = int(first[i + 1] - first[i]), places[i].as_py()
        a = first[i]
        gone = np.zeros(n, bool)
        if own:
            at = np.concatenate([np.arange(p["lo"], p["lo"] + p["more"] + 1) if p["offsets"] is None else p["lo"] + np.array(p["offsets"], np.int64) for p in own])
            gone = C.covered(n, at, window)
        yield n, [raw[starts[a + j] : ends[a + j]] for j in np.flatnonzero(~gone)]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every row."""
    rows = _with_places(docs, [F.col(id_col)], text_col, window=window, **options)
    schema = C.extend([docs.schema[id_col]], "n_words long, n_removed long, kept_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in C.chunks(batch, "text"):
                out = [(n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()) for n, words in _kept(part, data, offsets, window)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))], names=schema.names)

    return rows.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """docs with what is left of each text (kept words joined by one space) and its columns as they were; null stays null."""
    rows = _with_places(docs, [F.col(f"`{c}`") for c in docs.columns], text_col, window=window, **options)
    schema = docs.schema
    t = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in C.chunks(batch, "text"):
                left = [None if not x.is_valid else b" ".join(words).decode("utf-8") for x, (_, words) in zip(part.column(t), _kept(part, data, offsets, window), strict=True)]
                columns = [part.column(i) for i in range(len(schema.names))]
                columns[t] = pa.array(left, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
