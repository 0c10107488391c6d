"""Alignment of two tokenizers over the same bytes, by shuffled postings.

Side A is a byte-level merge vocabulary (the machines of transducer), side B a piece vocabulary (the sentencepiece library). A text's tokens of both
sides are laid over its bytes with a leading blank. Where tokens of both sides end, the bytes are cut into groups, and the
two tokens that end there are linked. How good a link is depends on the corpus: the count of its pair of ids, and whether that is the
highest count of its B id.

Documents are gathered in blocks of at most BLOCK_BYTES of text; a posting is a pair of ids, a block, and for each
document of the block that holds the pair, how often. Postings and the groups' digests are written once. Then postings
meet the pairs' counts in a cogroup by side id B: counts and each B id's highest count are computed in one shuffle by it, of
sums that the tasks have made before; the postings are shuffled by it and merged with the counts as two sorted streams, which spill. B ids
with more than 1 / HOT of all postings (fewer than HOT ids, whatever the corpus) are dealt by block as well, to as many tasks as their share
asks for, their counts copied to each. What postings contribute is dealt by block and summed by document.

Defined results: a null or empty text has no tokens, nor has one whose tokens' bytes are not the blank and the text (as where
it holds U+2581, which side B cannot tell from a blank): zeros, and '' as digest. Repeated rows each count and return, null ids
are carried, an empty table gives an empty result, texts of any length are one document of one block. Strings of special tokens are plain text. Both files must be readable on the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import columnar as C
from caseflow.llm import transducer

#: Bytes of text of one block, and documents at most; a longer text is a block of its own. Texts are looked at SLICE_BYTES at a time.
BLOCK_BYTES, BLOCK_DOCS, SLICE_BYTES = 4 << 20, 1 << 16, 512 << 10
#: B ids that hold more than this part of all postings are dealt to several tasks.
HOT = 400
_DIGITS = 10


class SideA:
    """Ids by the compiled machines of the byte-level vocabulary; special strings are plain text."""

    def __init__(self, path: str):
        self.machine = transducer.machine(path)
        self.length = _lengths(self.machine.vocabulary.bytes)

    def ids(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each text has); each text has a blank before it."""
        cut = transducer.Pieces(data, offsets, classes, None)
        ids, n = self.machine.tokens(data, cut.starts, cut.ends)
        return ids, np.bincount(cut.text, n, len(offsets) - 1).astype(np.int64)


class SideB:
    """Ids by the library, which puts the blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = {i: lib.id_to_piece(i) for i in range(lib.get_piece_size()) if not lib.is_control(i) and not lib.is_unknown(i)}
        self.bytes = {i: bytes([int(s[3:5], 16)]) if lib.is_byte(i) else s.replace("▁", " ").encode() for i, s in spelled.items()}
        self.length = _lengths(self.bytes)
        self.place = np.cumsum(self.length) - self.length
        self.joined = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(len(self.length))), np.uint8)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each text has)."""
        each = self.library.encode(texts, num_threads=1)
        return np.array(list(chain.from_iterable(each)), np.int32), np.array([len(x) for x in each], np.int64)

    def spells(self, ids: np.ndarray, count: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """By text, whether its tokens' bytes are its own."""
        text, want = np.repeat(np.arange(len(count)), count), np.diff(offsets)
        good = np.bincount(text, self.length[ids], len(count)) == want
        ids, text = ids[good[text]], text[good[text]]
        given = self.joined[_ranges(self.place[ids], self.length[ids])]
        own = np.repeat(good, want)
        odd = np.flatnonzero(given != data[own])
        good[np.searchsorted(offsets, np.flatnonzero(own)[odd], "right") - 1] = False
        return good


def _lengths(token_bytes: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(max(token_bytes) + 1, np.int64)
    for i, b in token_bytes.items():
        out[i] = len(b)
    return out


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... count[0] of them, and so on."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


@lru_cache(1)
def sides(a_path: str, b_path: str) -> tuple[SideA, SideB]:
    """The worker's two sides: tasks that follow each other in one worker share what they have learned."""
    return SideA(a_path), SideB(b_path)


def _printed(n: int) -> np.ndarray:
    """(n, 10): decimal digits of 0 to n - 1 with zero bytes before and one free byte after."""
    v = np.arange(n)
    out = np.zeros((n, _DIGITS), np.uint8)
    for place in range(_DIGITS - 1):
        power = 10**place
        out[:, _DIGITS - 2 - place] = np.where((v >= power) | (place == 0), 48 + v // power % 10, 0)
    return out


class Slice:
    """What is found in a slice of a block's texts (bytes with a blank before each): counts and digest of each, and how often each holds each pair of ids."""

    def __init__(self, texts: list[str], a: SideA, b: SideB, classes: np.ndarray, digits: np.ndarray):
        raw, n = [b" " + t.encode() for t in texts], len(texts)
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw]))
        (ia, na), (ib, nb) = a.ids(data, offsets, classes), b.ids(texts)
        good = b.spells(ib, nb, data, offsets) & (np.diff(offsets) > 1)
        sides = [(side, ids, np.repeat(np.arange(n), count)) for side, ids, count in ((a, ia, na), (b, ib, nb))]
        size = np.where(good, np.diff(offsets), 0)
        flags, kept = [np.zeros(int(size.sum()) + 1, bool) for _ in sides], []
        for flag, (side, ids, text) in zip(flags, sides, strict=True):
            ids, text = ids[good[text]], text[good[text]]
            ends = np.cumsum(side.length[ids])
            flag[ends] = True
            kept.append((ids, text, ends))
        (ia, ta, ea), (ib, tb, eb) = kept
        cut_a, cut_b = flags[1][ea], flags[0][eb]
        self.n_a, self.n_b = np.bincount(ta, minlength=n), np.bincount(tb, minlength=n)
        link_text = ta[cut_a]
        self.n_links = np.bincount(link_text, minlength=n)
        self.digests = self._digests(ia, cut_a, ib, cut_b, digits, good)
        code = ib[cut_b].astype(np.int64) << 20 | ia[cut_a]
        self.key, self.times = np.unique(code << 20 | link_text, return_counts=True)

    def _digests(self, ia: np.ndarray, cut_a: np.ndarray, ib: np.ndarray, cut_b: np.ndarray, digits: np.ndarray, good: np.ndarray) -> list[str]:
        """Hash of each text's `a1,a2|b1;a3|b2,b3`."""
        # A tokens of a group stand before its B tokens: a token moves on by the other side's tokens of earlier groups (B: of its own too)
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        until_b = np.append(0, np.flatnonzero(cut_b) + 1)
        until_a = np.append(0, np.flatnonzero(cut_a) + 1)
        at_a = np.arange(len(ia)) + until_b[group_a]
        at_b = np.arange(len(ib)) + until_a[group_b + 1] if len(ib) else np.zeros(0, np.int64)
        line = np.empty((len(ia) + len(ib), _DIGITS), np.uint8)
        for at, ids, cut, end in ((at_a, ia, cut_a, b"|"), (at_b, ib, cut_b, b";")):
            row = digits[ids]
            row[:, -1] = np.where(cut, end[0], b","[0])
            line[at] = row
        width = np.append(0, np.cumsum((line != 0).sum(1)))
        flat = line.reshape(-1)
        flat = flat[flat != 0].tobytes()
        ends = width[np.cumsum(self.n_a + self.n_b)]
        # without the last separator
        return [hashlib.sha256(flat[i : j - 1]).hexdigest() if ok else "" for i, j, ok in zip([0, *ends[:-1].tolist()], ends.tolist(), good.tolist(), strict=True)]


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING = "kind string, block long, b int, a int, docs array<int>, times array<int>, doc int"


def postings(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds: each document's counts and digest (`doc` its place in the block), and the postings."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = C.extend([], f"{_POSTING}, id {docs.schema[id_col].dataType.simpleString()}, {_DOC}")
    arrow = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("b", pa.int32()), ("a", pa.int32()), ("docs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("doc", pa.int32())])
    runs = transducer.class_table(a_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        classes, digits = transducer.spread(runs), _printed(max(len(a.length), len(b.length)))
        block, size, n, keys, times = TaskContext.get().partitionId() << 32, 0, 0, [], []
        for batch in batches:
            for part, data, _ in C.chunks(batch, "text", SLICE_BYTES):
                if n and (size + len(data) > BLOCK_BYTES or n + len(part) > BLOCK_DOCS):
                    yield from rows_of(block, keys, times, batch.schema.field("id").type)
                    block, size, n, keys, times = block + 1, 0, 0, [], []
                found = Slice([t or "" for t in part.column("text").to_pylist()], a, b, classes, digits)
                own = {"kind": ["doc"] * len(part), "block": np.full(len(part), block), "doc": np.arange(n, n + len(part), dtype=np.int32), "id": part.column("id")}
                own |= {"n_a": found.n_a, "n_b": found.n_b, "n_groups": found.n_links, "n_links": found.n_links, "groups_sha256": found.digests}
                yield _record(own, len(part), schema, arrow)
                keys.append(found.key + n)
                times.append(found.times)
                size, n = size + len(data), n + len(part)
        if n:
            yield from rows_of(block, keys, times, batch.schema.field("id").type)

    def rows_of(block: int, keys: list[np.ndarray], times: list[np.ndarray], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A block's postings: documents differ between slices, so no key is in two of them."""
        key, n = np.concatenate(keys), np.concatenate(times).astype(np.int32)
        by = np.argsort(key)
        key, n = key[by], n[by]
        code = key >> 20
        first = np.flatnonzero(np.diff(code, prepend=-1))
        starts = pa.array(np.append(first, len(key)).astype(np.int32))
        lists = {"docs": pa.ListArray.from_arrays(starts, pa.array((key & (1 << 20) - 1).astype(np.int32))), "times": pa.ListArray.from_arrays(starts, pa.array(n))}
        b, a = (code[first] >> 20).astype(np.int32), (code[first] & (1 << 20) - 1).astype(np.int32)
        for i in range(0, len(first), 20_000):
            m = len(b[i : i + 20_000])
            part = {"kind": ["posting"] * m, "block": np.full(m, block), "b": b[i : i + 20_000], "a": a[i : i + 20_000]} | {c: v.slice(i, 20_000) for c, v in lists.items()}
            yield _record(part, m, schema, arrow, id_type)

    return rows.mapInArrow(run, schema)


def _record(values: dict, n: int, schema, arrow: pa.Schema, id_type: pa.DataType | None = None) -> pa.RecordBatch:
    kinds = {f.name: f.type for f in arrow} | dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64()) | {"groups_sha256": pa.string()}
    kinds["id"] = values["id"].type if "id" in values else id_type
    columns = [v if isinstance(v := values.get(f, None), pa.Array) else pa.nulls(n, kinds[f]) if v is None else pa.array(v, kinds[f]) for f in schema.names]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def contributions(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, doc, n_best, count_sum) of postings and the counts of their pairs."""
    spark = found.sparkSession
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = counts.groupBy("b").agg(F.sum("n").alias("n")).where(F.col("n") * HOT > total)
    # fewer than HOT rows, as their shares add up to 1
    hot = F.broadcast(share.select("b", F.ceil(F.col("n") * HOT / F.lit(total)).cast("int").alias("parts"))) if total else None
    if hot is None:
        return spark.createDataFrame([], "block long, doc int, n_best long, count_sum long")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = F.coalesce("parts", F.lit(1))
    left = found.join(hot, "b", "left").withColumn("part", F.pmod(F.xxhash64("block"), parts).cast("int")).drop("parts").repartition(n, "b", "part")
    right = counts.drop("n").join(hot, "b", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts").repartition(n, "b", "part")
    met = left.join(right.hint("merge"), ["b", "part", "a"]).select("block", "docs", "times", "count", "best")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros((2, 0), np.int64)

        def done() -> pa.RecordBatch:
            doc = np.flatnonzero(total[1])
            return pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(doc), block)), "doc": pa.array(doc.astype(np.int32)), "n_best": pa.array(total[0][doc]), "count_sum": pa.array(total[1][doc])})

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if blocks[i] != block:
                    if block is not None:
                        yield done()
                    block, total = int(blocks[i]), np.zeros((2, 0), np.int64)
                part = batch.slice(i, j - i)
                docs = part.column(1).flatten().to_numpy()
                times = part.column(2).flatten().to_numpy().astype(np.int64)
                each = np.diff(part.column(1).offsets.to_numpy())
                if docs.max() >= total.shape[1]:
                    total = np.pad(total, ((0, 0), (0, int(docs.max()) + 1 - total.shape[1])))
                np.add.at(total[0], docs, times * np.repeat(part.column(4).to_numpy(zero_copy_only=False), each))
                np.add.at(total[1], docs, times * np.repeat(part.column(3).to_numpy(), each))
        if block is not None:
            yield done()

    return met.repartition(n, "block").sortWithinPartitions("block").mapInArrow(run, "block long, doc int, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    both = C.written(postings(docs, a_path, b_path, id_col, text_col), "alignment")
    found = both.where(F.col("kind") == "posting").select("block", "b", "a", "docs", "times")
    own = both.where(F.col("kind") == "doc").select("block", "doc", F.col("id").alias("__id"), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    summed = found.groupBy("b", "a").agg(F.sum(F.aggregate("times", F.lit(0).cast("long"), lambda x, y: x + y)).alias("count"), F.count(F.lit(1)).alias("n"))
    highest = summed.groupBy("b").agg(F.max("count").alias("highest"))
    counts = C.written(summed.join(highest, "b").select("b", "a", "count", "n", (F.col("count") == F.col("highest")).alias("best")), "alignment_counts")
    out = own.join(contributions(found, counts), ["block", "doc"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(F.col("__id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
