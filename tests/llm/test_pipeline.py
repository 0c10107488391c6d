"""The corpus pipeline: every stage, on the rows that the stage before kept, against a plain version of its own."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caseflow.llm import columnar, line_dedup, pieces, toxicity
from caseflow.llm.queries import piece_model_path

BAD = ["vileword", "grossword", "foulword"]
ITEM = " ".join(f"exam{i}" for i in range(20))


def documents(seed: int = 4) -> list[tuple]:
    """Toxic texts, repeated and near-equal lines, near copies, benchmark passages, and awkward rows: the columns of documents and one of a clashing name."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    texts = []
    for i in range(120):
        lines = [" ".join(word() for _ in range(rng.randint(8, 14))) for _ in range(3)]
        if i % 3 == 0:
            lines[1] += " " + rng.choice(BAD)
        if i % 10 == 1:
            lines.append("this line of a notice stands below very many of these documents")
        if i % 20 == 2:
            lines.append("this line of a notice stands below very many of those documents")
        if i % 15 == 4:
            lines.insert(1, ITEM)
        texts.append("\n".join(lines))
    long = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts += long + [t.rsplit(" ", 1)[0] + " changed" for t in long] + [long[0].replace(" ", "  ")]
    rows = [(i, t, "en", "s", len(t), f"own{i}") for i, t in enumerate(texts)]
    rows += [(900, None, None, None, None, None), (901, "", "en", "s", 0, "x"), (902, " \n\t", "en", "s", 3, "x"), (None, "a text without any number", None, None, 25, None), (903, "twice " * 30, "en", "s", 180, "y"), (903, "twice " * 30, "en", "s", 180, "y")]
    rows += [(904, "onelongword" * 4000, "en", "s", 44000, "z"), (905, "vileword", "en", "s", 8, "z")]
    return rows


def grams(items, k):
    return frozenset(tuple(items[i : i + k]) for i in range(max(1, len(items) - k + 1))) if items else frozenset()


def close(a, b):
    return 5 * len(a & b) >= 4 * len(a | b) if a and b else False


def groups(sets):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(sets)
    for i, x in enumerate(keys):
        for y in keys[i + 1 :]:
            if close(sets[x], sets[y]):
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return find


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows after each stage, by name; the input as "input"."""
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _words string").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], 0, int(any(b in (r[1] or "") for b in BAD))) for r in rows if r[0] is not None and r[0] < 905]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("q1", ITEM), ("q2", None)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    out, docs = {"input": rows}, spark.read.parquet(f"{d}/documents.parquet")
    for name, f in corpus_pipeline.STAGES:
        docs = columnar.written(f(spark, docs, d), name)
        out[name] = [tuple(r) for r in docs.collect()]
        out[f"{name} columns"] = docs.columns
    out["run"] = [tuple(r) for r in corpus_pipeline.run(spark, d).collect()]
    empty = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, d)
    out["empty"] = empty.count()
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "lines", "near_duplicates", "benchmark", "pieces"]
    own = ["doc_id", "text", "lang", "source", "n_chars", "_words"]
    assert all(stages[f"{n} columns"] == own for n in ("toxicity", "lines", "near_duplicates", "benchmark"))
    assert stages["pieces columns"] == [*own, "ids", "n_tokens", "round_trip"]
    assert stages["empty"] == 0


def test_toxic_documents_go(stages):
    toxic = lambda t: any(b in (t or "") for b in BAD)
    kept, rows = Counter(stages["toxicity"]), Counter(stages["input"])
    assert not kept - rows
    gone = list((rows - kept).elements())
    assert sum(toxic(r[1]) for r in gone) >= 0.8 * sum(toxic(r[1]) for r in stages["input"])
    assert sum(not toxic(r[1]) for r in gone) <= 0.05 * len(stages["input"])


def test_one_line_of_each_group_stays(stages):
    before = [(r, (r[1] or "").split("\n")) for r in stages["toxicity"]]
    places = {}
    for r, lines in before:
        for n, x in enumerate(lines):
            if re.search(r"[^\x20\x09-\x0D]", x):
                places[(r[0] is not None, r[0] or 0, n)] = x
    distinct = {x: grams(x, 4) for x in places.values()}
    find = groups(distinct)
    first = {}
    for k in sorted(places):
        first.setdefault(find(places[k]), k)
    want = Counter()
    for r, lines in before:
        left = [x for n, x in enumerate(lines) if x not in distinct or first[find(x)] == (r[0] is not None, r[0] or 0, n)]
        want[(r[0], None if r[1] is None else "\n".join(left), *r[2:])] += 1
    got = Counter(stages["lines"])
    assert len(distinct) < len(places) and sum((got - want).values()) <= 1  # recall of the bands is 0.99


def test_one_document_of_each_group_stays(stages):
    rows = stages["lines"]
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower()) for i, r in enumerate(rows)}
    sets = {i: grams(w, 5) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset()) for i, w in words.items()}
    find = groups(sets)
    roots = {find(i) for i in words if words[i]}
    kept = stages["near_duplicates"]
    assert not Counter(kept) - Counter(rows)
    left = Counter(kept)
    ids = [next(i for i, r in enumerate(rows) if r == k) for k in left if re.search(r"[^\x20\x09-\x0D]", k[1] or "")]
    assert sorted(find(i) for i in ids) == sorted(roots) and len(roots) < sum(bool(w) for w in words.values())
    assert sum(left[r] for r in left if not (r[1] or "").strip()) == sum(not w for w in words.values())


def test_contaminated_documents_go(stages):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    item = grams(word(ITEM), 13)

    def bad(t):
        w, hit = word(t), set()
        for a in range(len(w) - 12):
            if tuple(w[a : a + 13]) in item:
                hit |= set(range(a, a + 13))
        return bool(hit) and 20 * len(hit) >= len(w)

    before, got = Counter(stages["near_duplicates"]), Counter(stages["benchmark"])
    assert got == Counter({r: n for r, n in before.items() if not bad(r[1])}) and got != before


def test_ids_are_the_librarys(stages):
    library = pieces._library(piece_model_path())
    got = Counter((*r[:-3], tuple(r[-3]), *r[-2:]) for r in stages["pieces"])
    want = Counter()
    for r in stages["benchmark"]:
        ids = tuple(library.encode(r[1] or ""))
        want[(*r, ids, len(ids), library.decode(list(ids)) == (r[1] or "").replace(pieces.MARK, " "))] += 1
    assert got == want


def test_run_applies_all_stages(stages):
    plain = lambda rows: Counter(map(str, rows))
    assert plain(stages["run"]) == plain(stages["pieces"])


def test_texts_go_to_python_once_and_by_bytes(spark):
    """A task's memory outside the heap: batches of a few MB, and no second copy of the text beside the one that is kept."""
    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.concat("id", F.lit(" good vileword ")), 300).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).where("doc_id < 40")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"])

    got = [r["size"] for r in corpus_pipeline.stage(lambda s, d, _: d.mapInArrow(sizes, "size long"))(spark, docs, "").collect()]
    assert sum(got) > 20_000_000 and max(got) < 6_000_000
    machine = toxicity.fit(docs, labels)
    once = toxicity.score(docs, machine, dict.fromkeys(docs.columns))
    sent = lambda df: df._jdf.queryExecution().optimizedPlan().children().head().output().size()
    twice = toxicity.score(docs, machine, {c: F.col(c) for c in docs.columns})
    assert (sent(once), sent(twice)) == (2, 3)
    assert once.orderBy("doc_id").collect() == twice.orderBy("doc_id").collect()
    rows, text, gone = line_dedup._joined(docs.limit(20), "doc_id", "text", docs.columns)
    assert rows.columns == ["doc_id", "text", gone] and text == "text"
