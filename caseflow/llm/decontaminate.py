"""Benchmark decontamination with suffix arrays over the training texts.

Documents are streamed once. Each slice of an Arrow batch is a shard: its words get a suffix array (prefix
doubling up to the window's length), and every suffix of every test item is binary-searched in it, which gives
the verbatim matches and their places. Test items are a stated query set: they are broadcast in blocks whose size
is a parameter, one streaming stage a block, and nothing is shuffled.

Words: A-Z lower-cased, then runs of digits, letters a-z and non-ASCII bytes. A window is `window` consecutive
words of an item; an item of fewer words, but not none, is one window. Words are compared as two independent
64-bit hashes (128 bits).

Defined results: a null or empty text has no words, is never hit and stays; items without words match nothing;
repeated rows and repeated items each count; a null item id counts as the empty one; an empty benchmark or an empty table changes nothing. Only the named
columns are read, other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import columnar as C

WINDOW = 13
#: Share of a document's words that makes it contaminated.
LEAST_SHARE = 0.05
#: Test words in a broadcast block (24 bytes each, some 24 MB at most).
BLOCK_WORDS = 1_000_000

MATCHES = "array<struct<start:int,words:int,item:string,offset:int>>"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of each word, and the index of each text's first word."""
    data = C.LOWER[data]
    starts, ends, first = C.words(data, offsets, C.ALNUM)
    return C.span_hash(data, starts, ends, 0), C.span_hash(data, starts, ends, 1), first


class TestBlock:
    """Words of some test items, and for each searched window its first word and length."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        arr = pa.array([x or "" for x in texts], pa.large_string())
        data, offsets = C.column(pa.table({"t": arr}), "t")
        self.a, self.b, first = tokens(data, offsets)
        self.ids = ids
        n = np.diff(first)
        size = np.minimum(n, window)
        self.item = np.repeat(np.arange(len(ids)), np.maximum(n - size + 1, 0) * (n > 0))
        self.offset = np.concatenate([np.arange(k - s + 1) for k, s in zip(n, size, strict=True) if k] or [np.zeros(0, np.int64)])
        self.start = first[self.item] + self.offset
        self.size = size[self.item]
        self.end = first[self.item + 1]


def suffix_array(ranks: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes by their first `depth` ranks at least (prefix doubling); ranks are positive, 0 ends a text."""
    # the first ranks may be larger than their number: a slice has few words of a large vocabulary
    base = max(len(ranks), int(ranks.max(initial=0))) + 1
    k, order = 1, np.argsort(ranks, kind="stable")
    while k < depth:
        later = np.zeros(len(ranks), np.int64)
        later[:-k] = ranks[k:]
        key = ranks.astype(np.int64) * base + later
        order = np.argsort(key, kind="stable")
        new = np.empty(len(ranks), np.int64)
        new[order] = np.cumsum(np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)]))
        new[ranks == 0] = 0
        ranks, k = new, 2 * k
    return order


class Shard:
    """Suffix array of the words of some texts."""

    def __init__(self, a: np.ndarray, b: np.ndarray, first: np.ndarray, test: TestBlock, depth: int):
        # only words that some test item has can match; the others are one rank, the largest, so that they stay apart
        vocabulary = np.unique(test.a)
        at = np.minimum(np.searchsorted(vocabulary, a), max(len(vocabulary) - 1, 0))
        known = vocabulary[at] == a if len(vocabulary) else np.zeros(len(a), bool)
        rank = np.where(known, at + 1, len(vocabulary) + 1)
        # runs of words without any test word keep one word
        keep = known.copy()
        keep[1:] |= known[:-1]
        last = np.zeros(len(a), bool)
        last[first[1:][np.diff(first) > 0] - 1] = True
        keep |= last
        self.place = np.flatnonzero(keep)
        text = C.owner(first)[self.place]
        # a zero after each text keeps matches inside it
        shift = np.cumsum(np.concatenate([[0], np.diff(text) != 0])) if len(text) else text
        self.ranks = np.zeros(len(self.place) + (int(shift[-1]) if len(text) else 0) + 1, np.int64)
        self.at = np.arange(len(self.place)) + shift
        self.ranks[self.at] = rank[self.place]
        self.back = np.full(len(self.ranks), -1, np.int64)
        self.back[self.at] = self.place
        self.b = np.zeros(len(self.ranks), np.uint64)
        self.b[self.at] = b[self.place]
        self.order = suffix_array(self.ranks, depth)
        self.vocabulary = vocabulary

    def find(self, test: TestBlock) -> tuple[np.ndarray, np.ndarray]:
        """(window, position in ranks) of every occurrence of every test window; binary search of all windows at once."""
        n, m = len(self.order), len(test.start)
        if not m or not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pattern = np.searchsorted(self.vocabulary, test.a) + 1
        padded = np.concatenate([self.ranks, np.zeros(int(test.size.max()) + 1, np.int64)])
        lo = self._bound(padded, pattern, test, n, after=False)
        hi = self._bound(padded, pattern, test, n, after=True)
        count = hi - lo
        which = np.repeat(np.arange(m), count)
        if not len(which):
            return which, which
        inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        at = self.order[lo[which] + inner]
        good = np.ones(len(which), bool)
        b = np.concatenate([self.b, np.zeros(int(test.size.max()) + 1, np.uint64)])
        for j in range(int(test.size.max())):  # the second hash of every word
            use = good & (j < test.size[which])
            good[use] = b[at[use] + j] == test.b[test.start[which[use]] + j]
        return which[good], at[good]

    def _bound(self, padded: np.ndarray, pattern: np.ndarray, test: TestBlock, n: int, after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(test.start), np.int64), np.full(len(test.start), n, np.int64)
        live = np.arange(len(test.start))
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            at = self.order[mid]
            less, open_ = np.zeros(len(live), bool), np.arange(len(live))
            for j in range(int(test.size.max())):
                whole = j >= test.size[live[open_]]
                if after:
                    less[open_[whole]] = True  # the suffix begins with the whole window
                open_ = open_[~whole]
                if not len(open_):
                    break
                x, y = padded[at[open_] + j], pattern[test.start[live[open_]] + j]
                less[open_[x < y]] = True
                open_ = open_[x == y]
            if after:
                less[open_] = True
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo


def find_matches(data: np.ndarray, offsets: np.ndarray, test: TestBlock, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words of the longest verbatim match, item, offset in item) of all matches, and words by text."""
    a, b, first = tokens(data, offsets)
    n_words = np.diff(first)
    shard = Shard(a, b, first, test, window)
    which, at = shard.find(test)
    word = shard.back[at]
    text = np.searchsorted(first, word, "right") - 1
    # a match that its left neighbour contains is not maximal
    i, j = np.maximum(word - 1, 0), np.maximum(test.start[which] - 1, 0)
    inner = (test.offset[which] > 0) & (word > first[text]) & (a[i] == test.a[j]) & (b[i] == test.b[j]) if len(which) else np.zeros(0, bool)
    which, word, text = which[~inner], word[~inner], text[~inner]
    # extend the others to the right as far as text and item agree
    length = test.size[which].copy()
    live = np.arange(len(which))
    while len(live):
        i, j = word[live] + length[live], test.start[which[live]] + length[live]
        more = (i < first[text[live] + 1]) & (j < test.end[which[live]])
        live, i, j = live[more], i[more], j[more]
        same = (a[i] == test.a[j]) & (b[i] == test.b[j])
        live = live[same]
        length[live] += 1
    return text, word - first[text], length, which, n_words


def _stage(docs: DataFrame, block: object, text_col: str, window: int, first_stage: bool, names: tuple[str, str]) -> DataFrame:
    n_words_col, matches_col = names
    schema = C.extend([f for f in docs.schema.fields if f.name not in names], f"`{n_words_col}` int, `{matches_col}` {MATCHES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test: TestBlock = block.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("item", pa.string()), ("offset", pa.int32())]))
        for batch in batches:
            for part, data, offsets in C.chunks(batch, text_col):
                text, start, length, which, n_words = find_matches(data, offsets, test, window)
                order = np.lexsort((which, start, text))
                rows: list[list[dict]] = [[] for _ in range(part.num_rows)]
                if not first_stage:
                    rows = part.column(matches_col).to_pylist()
                for i in order:
                    w = which[i]
                    rows[text[i]].append({"start": int(start[i]), "words": int(length[i]), "item": test.ids[test.item[w]], "offset": int(test.offset[w])})
                columns = [part.column(f.name) for f in schema.fields[:-2]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int32()), pa.array(rows, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, names: tuple[str, str] = ("_words", "_matches")) -> DataFrame:
    """docs with two columns of these names, its number of words and all longest verbatim matches; columns of these names are replaced.

    A match has its first word in the text, its length in words (at least the window's), the item and the first
    word in the item; every occurrence of a window lies in one of them.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    # an item has at most (bytes + 1) / 2 words
    size = F.ceil((F.octet_length("t") + 1) / 2)
    blocks = max(1, int((items.agg(F.sum(size)).first()[0] or 0) // block_words) + 1)
    # rows come in blocks by a hash of item; the driver holds one block at a time
    out, rest = docs, items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    for b in range(blocks):
        rows = (rest if blocks == 1 else rest.where(F.col("b") == b)).orderBy("i", "t").collect()
        block = spark.sparkContext.broadcast(TestBlock([r["i"] for r in rows], [r["t"] for r in rows], window))
        out = _stage(out, block, text_col, window, b == 0, names)
    return out


def hits(matches_col: str = "_matches"):
    """Column of the number of hit words, from the matches: union of their intervals."""
    ends = F.transform(F.array_sort(F.transform(F.col(matches_col), lambda m: F.struct(m["start"].alias("s"), (m["start"] + m["words"]).alias("e")))), lambda m: m)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda acc, m: F.struct(
        (acc["n"] + F.greatest(F.lit(0), m["e"] - F.greatest(acc["to"], m["s"]))).alias("n"),
        F.greatest(acc["to"], m["e"]).alias("to"),
    )
    return F.aggregate(ends, start, step)["n"]


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(options.pop("text_col", "text")).alias("text"))
    # a null item_id is an item without a name
    items = F.array_sort(F.array_distinct(F.transform("_matches", lambda m: F.coalesce(m["item"], F.lit("")))))
    out = match_benchmark(rows, benchmark, **options).select(F.col("id").alias(id_col), F.col("_words").cast("long").alias("n_words"), hits().cast("long").alias("n_hit"), items.alias("items"))
    return out.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, least_share: float = LEAST_SHARE, **options) -> DataFrame:
    """The rows that are not contaminated, with their columns as they were."""
    names = tuple(C.free(docs.columns, "_words", "_matches"))
    found = match_benchmark(docs, benchmark, names=names, **options)
    bad = (F.size(names[1]) > 0) & (hits(names[1]) >= F.col(names[0]) * least_share)
    return found.where(~bad).select(*docs.columns)


def items_digest(items: list[str]) -> str:
    """sha256 of sorted item ids joined by commas, as in report()."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
