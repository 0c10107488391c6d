"""Near-duplicate join on word n-grams with exact Jaccard similarity.

Shingles are `k` consecutive words (A-Z lower-cased, split at ASCII white space); a text of fewer words is one
shingle; sets, not bags. Documents of equal sets are one class from the start, so copies are never compared. Each
class orders its shingles rare-first and keeps the prefix that any partner must share (prefix filter). Candidates
come from shared prefix shingles under the length, positional and suffix filters; what is left is verified once per
pair on the whole sets.

The order that all classes share: first the shingles whose hash lies in the lowest SHARE * (1 - similarity) of all hashes, by the exact number
of classes that hold them, then all others by hash. So only that part of all shingles is counted and shuffled, and any
order gives exact results. A class without enough shingles of the first kind adds its first others. Shingles that no other class has are never in a list, so
a class with a prefix of such shingles alone, as most have, is done after the count.

The suffix filter bounds the Hamming distance of two sets from below by parities: each set sends its shingles by hash to PARITIES
bits and keeps whether each bit got an odd number. Every bit in which two sets differ is one shingle at least that only one of
them has, so the filter loses nothing. It is part of the join's condition, so that only pairs that pass it leave the join.

Only components are wanted: components.linked() looks for pairs in the shingles' lists without giving out what is
already one component, and leaves no link between different components.

Shingles are compared as 64-bit hashes, sets as 128-bit hashes.

Defined results: null is the empty text; a text without words has no shingle, links with nothing and is its own
component; equal sets are linked; repeated rows (even of one id) are members like any other; an empty table gives an
empty result. component_id is the smallest id of the component. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm import columnar as C
from caseflow.llm import components

SHARE = 2.5
PARITIES = 512


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of all shingles, repeated ones included, and the number of words by text."""
    data = C.LOWER[data]
    starts, ends, first = C.words(data, offsets, C.NON_SPACE)
    h = C.span_hash(data, starts, ends)
    n, text = np.diff(first), C.owner(first)
    ok = C.starts_of(first, k)[: max(0, len(h) - k + 1)]
    out, own = C.window_hash(h, k)[ok] if len(ok) else np.zeros(0, np.uint64), text[: len(ok)][ok]
    short = np.flatnonzero((n > 0) & (n < k))
    for size in range(1, k):  # the whole sequence of a text of fewer words
        which = short[n[short] == size]
        if len(which):
            whole = C.window_hash(h, size)[first[which]]
            out, own = np.concatenate([out, whole]), np.concatenate([own, which])
    return out, own, n


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' shingles, each text's distinct and ascending; offsets by text)."""
    h, text, _ = shingles(data, offsets, k)
    return C.distinct(h, text, len(offsets) - 1)


def fits(num: int, den: int) -> Column:
    """Length and suffix filter, and positional filter for one shared shingle at (ax.pos, ay.pos)."""
    nx, ny, px, py = F.col("ax.n"), F.col("ay.n"), F.col("ax.pos"), F.col("ay.pos")
    bound = F.least(px, py) + 1 + F.least(nx - px - 1, ny - py - 1)
    return ((num + den) * bound >= num * (nx + ny)) & C.may_link(num, den, PARITIES)


def _signed(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(id, tkey, s1, s2, n, low, own, q): identity of text and set, size, first shingles of the order, how many of them are counted, parities.

    own and q only once an Arrow batch for each set.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).alias("tkey"))
    schema = C.extend(rows.schema.fields[:1], "tkey binary, s1 long, s2 long, n int, low int, own array<long>, q array<long>")
    cut = np.uint64(min(int((1 << 64) * SHARE * (1 - num / den)), (1 << 64) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            for part, data, offsets in C.chunks(batch, "text"):
                h, offs = sets(data, offsets, k)
                n = np.diff(offs)
                full = np.flatnonzero(n)
                total = np.zeros((len(n), 2), np.uint64)
                for j, salt in enumerate((C._BASE, C._M1)):  # sums of independent hashes of the distinct shingles
                    if len(full):
                        total[full, j] = np.add.reduceat(C.mix(h * salt + np.uint64(j)), offs[full])
                low = np.concatenate([[0], np.cumsum(h < cut)])
                low = low[offs[1:]] - low[offs[:-1]]
                # hashes ascend within a text: counted ones come first, then the others by hash
                size = np.maximum(low, n - -(-n * num // den) + 1)
                # so small a set that no other size is within the threshold links with equal sets alone
                size[(n == 0) | ((n * num > (n - 1) * den) & ((n + 1) * num > n * den))] = 0
                first = np.zeros(len(n), bool)
                for i, key in enumerate(map(bytes, total)):
                    first[i] = key not in seen
                    seen.add(key)
                size[~first] = 0
                at = np.repeat(offs[:-1], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                q = C.parities(h, offs, PARITIES)
                width = np.where(size > 0, q.shape[1], 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("tkey"), pa.array(total[:, 0].view(np.int64)), pa.array(total[:, 1].view(np.int64)), pa.array(n, pa.int32()), pa.array(low, pa.int32()),
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(h[at].view(np.int64))),
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(width)]).astype(np.int32), pa.array(q[size > 0].reshape(-1).view(np.int64))),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def _lists(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(token, node, a) of all shingles that stand in the prefixes of two classes at least; a: (n, pos, q0, q1, ...)."""
    entries = classes.select(F.posexplode("own").alias("at", "token"), "node")
    count = C.written(entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    # the shared shingles are the smaller side, each of them once: they are hashed, and the many others need no sort
    shared = entries.join(count.hint("shuffle_hash"), "token").groupBy("node").agg(F.collect_list(F.struct("at", "c", "token")).alias("s"))
    info = classes.select("node", "n", "low", F.size("own").alias("size"), (F.col("n") - F.ceil(F.col("n") * num / den - 1e-9) + 1).alias("prefix"), "q")
    # of the counted shingles, those of one class alone come first
    early = F.filter("s", lambda x: x["at"] < F.col("low"))
    ranked = F.array_sort(F.transform(early, lambda x: F.struct(x["c"], x["token"])))
    alone = F.col("low") - F.size(early)
    places = F.concat(
        F.transform(ranked, lambda x, i: F.struct(x["token"].alias("token"), (alone + i).alias("pos"))),
        F.transform(F.filter("s", lambda x: x["at"] >= F.col("low")), lambda x: F.struct(x["token"].alias("token"), x["at"].alias("pos"))),
    )
    rows = shared.where(F.size("s") > 0).join(info, "node").where((F.col("size") - F.size("s") < F.col("prefix"))).select("node", "n", "prefix", "q", F.explode(places).alias("p")).where("p.pos < prefix")
    a = F.struct("n", F.col("p.pos").alias("pos"), *[F.col("q")[i].alias(f"q{i}") for i in range(PARITIES // 64)])
    lists = C.written(rows.select(F.col("p.token").alias("token"), "node", a.alias("a")), "prefixes")
    both = lists.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    out = C.written(lists.join(both, "token"), "lists")
    C.dropped(lists, count)
    return out


def _sets_of(docs: DataFrame, text_col: str, k: int, wanted: DataFrame) -> DataFrame:
    """(node, n, tokens) of the classes (node, tkey); one text of each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("tkey")).join(wanted, "tkey").dropDuplicates(["node"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in C.chunks(batch, "text"):
                h, offs = sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(offs), pa.int32()), pa.ListArray.from_arrays(offs.astype(np.int32), pa.array(h.view(np.int64)))], names=["node", "n", "tokens"])

    return texts.mapInArrow(run, "node long, n int, tokens array<long>")


def _rooted(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> DataFrame:
    """(id, tkey, n, node, root) of every row; root is one of the component's sets; texts without words have none."""
    members = C.written(_signed(docs, id_col, text_col, k, num, den), "members")
    # one text's columns for each set: those of a row that has them
    one = F.max_by(F.struct("low", "own", "q", "tkey"), F.size("own"))
    classes = members.where("n > 0").groupBy("s1", "s2").agg(F.any_value("n").alias("n"), one.alias("o")).select("s1", "s2", "n", "o.*", F.monotonically_increasing_id().alias("node"))
    classes = C.written(classes, "classes")
    lists = _lists(classes, num, den)
    sets_ = C.written(_sets_of(docs, text_col, k, classes.select("node", "tkey").join(lists.select("node").distinct(), "node", "left_semi")), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda s: sets_.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("tokens").alias(f"t{s}"))
        near = pairs.join(side("x"), "x").join(side("y"), "y")
        near = near.where((num + den) * F.size(F.array_intersect("tx", "ty")) >= num * (F.col("nx") + F.col("ny")))
        return near.select(F.col("x").alias("u"), F.col("y").alias("v"))

    roots = components.linked(lists, verified, fits(num, den))
    C.dropped(lists, sets_)
    nodes = classes.select("s1", "s2", "node").join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return members.select("id", "tkey", "s1", "s2", "n").join(nodes, ["s1", "s2"], "left").drop("s1", "s2")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id, n_shingles, component_id) of every row; num / den is the least similarity."""
    members = _rooted(docs, id_col, text_col, k, num, den)
    least = members.where("n > 0").groupBy("root").agg(F.min("id").alias("least"))
    out = members.join(least, "root", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of docs, one of each component: the smallest by (id, hash of text, other columns), a null id last; textless rows all stay."""
    members = _rooted(docs, id_col, text_col, k, num, den)
    own, own_id, own_key = C.free(docs.columns, "key", "first_id", "first_key")
    # ids may be null or repeat: id and text name the row, and rows equal in both are of one component
    first = members.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "tkey")).alias("m")).select(F.col("m.id").alias(own_id), F.col("m.tkey").alias(own_key))
    rest = F.trim(F.translate(F.coalesce(F.col(text_col), F.lit("")), "\t\n\r\x0b\x0c", "     ")) == ""
    keyed = docs.where(~rest).withColumn(own, F.unhex(F.md5(F.col(text_col).cast("binary"))))
    kept = keyed.join(first, keyed[id_col].eqNullSafe(F.col(own_id)) & (F.col(own) == F.col(own_key)), "left_semi")
    one = kept.groupBy(id_col, own).agg(F.min(F.struct(*[F.col(c) for c in [text_col, *[c for c in docs.columns if c not in (text_col, id_col)]]])).alias("r"))
    one = one.select(*[F.col(id_col) if c == id_col else F.col(f"r.{c}").alias(c) for c in docs.columns])
    return docs.where(rest).unionByName(one)
