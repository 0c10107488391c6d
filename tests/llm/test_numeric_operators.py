"""Whitening, token counts and alignment against brute-force versions, and their defined edge cases."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from caseflow.llm import alignment, queries, transducer, whitening
from tests.session import SMALL

AWKWARD = [
    (90001, None), (90002, ""), (90003, " "), (90004, "a  b "), (90005, "x ▁ y"), (90006, "<|endoftext|> hi<|endoftext|>"), (90006, "<|endoftext|> hi<|endoftext|>"), (None, "hello world"), (None, None),
    (90007, "é漢字\x00\n\t tail  "), (90008, "  lead"), (90009, "a" * 3000), (90010, "\n" * 700 + "x"), (90011, "I'll we've they're 'tis 'r 'l 'v it's"), (90012, "<|endoftext"), (90013, " 　\x85  1½٣"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1) for i, t in AWKWARD]
    df = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "text", "'clash' as id", "1 as n_a")
    return df.unionByName(spark.createDataFrame(rows, "doc_id long, text string, id string, n_a int")).repartition(3).cache()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_model_path())


# --- whitening ------------------------------------------------------------------------------------------------------


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, component int, n long")


def by_numpy(rows):
    """{id: (deviation, whitened by component up to sign)}, explained, n."""
    x = np.array([[math.floor(1024 * c) + 100000 for c in r[1]] for r in rows], np.float64)
    n, total = len(x), [sum(int(v) for v in col) for col in x.T]
    mean = np.array([t / n for t in total])
    e, u = np.linalg.eigh((x - mean).T @ (x - mean) / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(8, int((e > len(e) * 2.0**-52 * e[0]).sum()))
    w = (x - mean) @ u[:, :k] / np.sqrt(e[:k])
    dev = [sum((n * int(v) - t) ** 2 for v, t in zip(r, total, strict=True)) for r in x]
    return {r[0]: (d, v) for r, d, v in zip(rows, dev, w, strict=True)}, e[:k] / e.sum(), n


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(12, 12)) * np.logspace(0, -3, 12)
    rows = [(i, np.float32(v).tolist(), 0, 0) for i, v in enumerate(rng.normal(size=(300, 12)) @ mix.T * 4)]
    bad = [(1000, None, 0, 0), (1001, [1.0] * 11 + [None], 0, 0), (1002, [float("nan")] * 12, 0, 0), (1003, [float("-inf")] * 12, 0, 0), (1004, [], 0, 0), (1005, [1.0] * 5, 0, 0)]
    got = whitening.whiten(vectors(spark, rows + bad).repartition(4)).collect()
    want, explained, n = by_numpy(rows)
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {n}
    mine = defaultdict(dict)
    for r in got:
        mine[r["vec_id"]][r["component"]] = r
    matrix = np.array([[mine[i][k]["whitened"] for k in range(1, 9)] for i in range(300)])
    theirs = np.array([want[i][1] for i in range(300)])
    sign = np.sign((matrix * theirs).sum(0))
    assert np.abs(matrix * sign - theirs).max() < 1e-6
    assert all(mine[i][1]["deviation"] == want[i][0] == int(mine[i][8]["deviation_exact"]) for i in range(300))
    assert np.allclose([mine[0][k]["explained"] for k in range(1, 9)], explained, rtol=1e-9)
    (error,) = {r["identity_error"] for r in got}
    assert error < 1e-9 and np.abs(np.cov(matrix.T, bias=True) - np.eye(8)).max() < 1e-9


def test_whitening_edges(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None, 0, 0), (2, [], 0, 0)])).collect() == []
    # one vector, or equal ones, have no direction
    assert whitening.whiten(vectors(spark, [(1, [0.5, 1.0], 0, 0)] * 3)).collect() == []
    # repeated rows count and return, a null id is carried, a constant dimension gives no component, doubles are taken
    rows = [(1, [0.5, 1.0, 7.0], 0, 0)] * 2 + [(None, [-0.5, 2.0, 7.0], 0, 0), (4, [3.0, 1.0, 7.0], 0, 0)]
    got = whitening.whiten(vectors(spark, rows, "double")).collect()
    assert Counter((r["vec_id"], r["component"]) for r in got) == {(1, 1): 2, (1, 2): 2, (None, 1): 1, (None, 2): 1, (4, 1): 1, (4, 2): 1}
    assert sum(r["explained"] for r in got if r["vec_id"] == 4) == pytest.approx(1)
    # entries of any finite size; the sum of squares leaves 64 bits
    got = whitening.whiten(vectors(spark, [(1, [1e38, 0.0], 0, 0), (2, [-1e38, 1.0], 0, 0), (3, [0.0, 5.0], 0, 0)])).collect()
    assert got and all(r["deviation"] is None and int(r["deviation_exact"]) > 1 << 63 for r in got if r["vec_id"] != 3)


def test_jacobi_keeps_small_eigenvalues():
    # a graded matrix, whose small eigenvalues a solver relative to the largest one loses
    d = np.diag(10.0 ** -np.arange(0, 16, 2))
    a = d @ (np.ones((8, 8)) * 0.3 + np.eye(8) * 0.7) @ d
    values, u = whitening.jacobi(a)
    from fractions import Fraction

    exact = [[Fraction(x) for x in row] for row in a.tolist()]
    # the product of all eigenvalues is the determinant, by exact elimination
    det = Fraction(1)
    for i in range(8):
        det *= exact[i][i]
        for j in range(i + 1, 8):
            f = exact[j][i] / exact[i][i]
            exact[j] = [x - f * y for x, y in zip(exact[j], exact[i], strict=True)]
    assert (values > 0).all() and float(np.prod(values) / float(det)) == pytest.approx(1, rel=1e-12)
    assert np.abs(u.T @ u - np.eye(8)).max() < 1e-14 and (np.diff(values) <= 0).all()
    assert whitening.jacobi(np.zeros((0, 0)))[0].shape == (0,) and whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


# --- token counts ---------------------------------------------------------------------------------------------------


def test_counts_equal_the_library(spark, docs, library):
    got = Counter(map(tuple, transducer.count_tokens(docs, queries.byte_model_path()).collect()))
    want = Counter()
    for i, t in docs.select("doc_id", "text").collect():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 512] += 1
    assert got == want
    assert transducer.count_tokens(docs.limit(0), queries.byte_model_path()).collect() == []


def test_machines_on_random_texts(library):
    rng = random.Random(11)
    alphabet = [*"aaabcdesstrevmldl''''    \n\t!?.,12½é中 　́", "<|endoftext|>", "<|endof", "'re", "'ll", " the", "ing", "\U0001f600", "\x1c"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    # pieces over many chunks, whose maps have to be composed
    texts += ["a" * 1000, " " * 999 + "x", "ab" * 700, "".join(rng.choice("abc") for _ in range(5000)), "' " * 300]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    classes = transducer.spread(transducer.class_table(queries.byte_model_path()))
    machine = transducer.machine(queries.byte_model_path())
    want = [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert transducer.token_counts(data, offsets, classes, machine).tolist() == want
    machine._reset()
    assert transducer.token_counts(data, offsets, classes, machine).tolist() == want
    # any length of chunk gives the same cuts and counts
    kinds = np.frombuffer(rng.randbytes(5000), np.uint8) % 11
    first = transducer.run_chunks(kinds, 5000)
    assert all((transducer.run_chunks(kinds, c) == first).all() for c in (1, 3, 64, 256))
    spans = np.array([0, 1000]), np.array([1000, 1000 + len(raw[3])])
    assert len({tuple(machine.counts(data, *spans, chunk=c).tolist()) for c in (1, 7, 64, 10_000)}) == 1


def test_classes_are_those_of_the_library(library):
    classes = transducer.spread(transducer.class_table(queries.byte_model_path()))
    cut = library.pre_tokenizer.pre_tokenize_str
    rng = random.Random(2)
    for c in [*range(0x3000), *(rng.randrange(0x3000, 0x110000) for _ in range(4000))]:
        if 0xD800 <= c < 0xE000:
            continue
        ch, kind = chr(c), classes[c]
        assert (len(cut(f"b{ch}")) == 1) == (kind <= transducer.LL), hex(c)
        assert (len(cut(f"2{ch}")) == 1) == (kind == transducer.DIGIT), hex(c)
        assert (len(cut(f"{ch}{ch}b")) == 2 and kind != transducer.OTHER and kind != transducer.APOSTROPHE) == (kind in (transducer.DIGIT, transducer.BLANK)) or kind <= transducer.LL, hex(c)


# --- alignment ------------------------------------------------------------------------------------------------------


def aligned(rows, library):
    """The rows of align(), text by text with both libraries."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())
    signs = transducer.byte_signs()
    a_bytes = {i: bytes(signs[c] for c in s) for s, i in library.get_vocab().items() if s != "<|endoftext|>"}
    b_bytes = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    library.encode_special_tokens = True
    found, count = [], Counter()
    for i, t in rows:
        a, b = ([], []) if not t else (library.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t))
        whole = (" " + (t or "")).encode()
        if b"".join(a_bytes[x] for x in a) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        ends = lambda ids, size: dict(zip(np.cumsum([len(size(x)) for x in ids]).tolist(), range(1, len(ids) + 1), strict=True))
        ea, eb = ends(a, a_bytes.get), ends(b, b_bytes)
        common = sorted(set(ea) & set(eb))
        links = [(a[ea[e] - 1], b[eb[e] - 1]) for e in common]
        cuts = [(0, 0), *((ea[e], eb[e]) for e in common)]
        groups = ";".join(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])) for (i, j), (k, m) in zip(cuts, cuts[1:], strict=False))
        count.update(links)
        found.append((i, len(a), len(b), len(common), links, hashlib.sha256(groups.encode()).hexdigest() if a else ""))
    library.encode_special_tokens = False
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return Counter((i, na, nb, g, len(ln), sum(count[p] == best[p[1]] for p in ln), sum(count[p] for p in ln), sha) for i, na, nb, g, ln, sha in found)


@pytest.mark.parametrize("hot", [alignment.HOT, 100_000])
def test_alignment_equals_brute_force(spark, docs, library, monkeypatch, hot):
    # with 100,000 parts, every id is dealt to several tasks; small blocks hold a few documents each
    monkeypatch.setattr(alignment, "HOT", hot)
    if hot > 1000:
        monkeypatch.setattr(alignment, "BLOCK_BYTES", 20_000)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    rows = rows if hot < 1000 else rows[:60]
    df = docs if hot < 1000 else spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = alignment.align(df, queries.byte_model_path(), queries.piece_model_path())
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == aligned(rows, library)


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, queries.byte_model_path(), queries.piece_model_path()).collect() == []
    nothing = spark.createDataFrame([(1, None), (None, ""), (1, None)], "doc_id long, text string")
    assert Counter(map(tuple, alignment.align(nothing, queries.byte_model_path(), queries.piece_model_path()).collect())) == {(1, 0, 0, 0, 0, 0, 0, ""): 2, (None, 0, 0, 0, 0, 0, 0, ""): 1}
