"""Probe training against numpy; the embedding cache: what is encoded, what is refused, what is chosen."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.operators import feature_cache as C
from caseflow.operators import probe as P
from caseflow.operators import selection as S

CLASSES = ["a", "b", "c"]


def data(n=240, d=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * [1, 2, 3, 0.1, 1] + [0, 5, 0, 0, -1]
    y = np.stack([x[:, 0] + x[:, 2] > 0.5, x[:, 1] > 6, np.zeros(n, bool)], 1).astype(float)
    return x, y, rng.integers(0, 2, size=(n, 3)).astype(float)


def by_numpy(x, y, m, lift, epochs, rate):
    """Adam on the weighted mean loss, all rows at once."""
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    z = np.hstack([z, np.ones((len(z), 1))])
    w, a, b, history = np.zeros((3, z.shape[1])), 0.0, 0.0, []
    for t in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-z @ w.T))
        history.append(float((m * -(lift * y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / m.sum()))
        g = ((m * ((1 - y) * p - lift * y * (1 - p))).T @ z) / m.sum()
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        w = w - rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return w, history


@pytest.mark.parametrize("parts", [1, 7])
def test_training_equals_numpy(spark, parts):
    x, y, m = data()
    df = spark.createDataFrame([(a.tolist(), b.tolist(), c.tolist()) for a, b, c in zip(x, y, m, strict=True)], "x array<double>, y array<double>, m array<double>").repartition(parts)
    lift = P.positive_weights(df, "y", "m")
    assert np.allclose(lift, np.clip((m.sum(0) - (m * y).sum(0)) / np.maximum((m * y).sum(0), 1), 1, 200))
    head = P.train(df, "x", "y", CLASSES, mask="m", positive=lift, epochs=12, rate=0.05)
    w, history = by_numpy(x, y, m, lift, 12, 0.05)
    assert np.abs(np.hstack([head.weights, head.bias[:, None]]) - w).max() < 1e-6 and np.allclose(head.history, history, atol=1e-9)
    plain = P.train(df, "x", "y", CLASSES, epochs=3)
    # the third class has no positives: all its gradients but the bias's are rounding, which Adam's scaling makes large
    assert np.abs(np.hstack([plain.weights, plain.bias[:, None]]) - by_numpy(x, y, np.ones_like(y), np.ones(3), 3, 0.01)[0])[:2].max() < 1e-9


def test_probe_by_surgeon(spark, tmp_path):
    x, y, _ = data(300)
    rows = [(f"S{i % 5}A{i}" if i % 50 else f"Clip{i}", a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = P.surgeon_split(spark.createDataFrame(rows, "case_id string, x array<double>, y array<double>"), "case_id", train=["S0", "S1", "S2"], val=["S3"], test=["S4"])
    assert {(r[0][:2], r[1]) for r in df.select("case_id", "split").collect()} == {("S0", "train"), ("S1", "train"), ("S2", "train"), ("S3", "val"), ("S4", "test")}
    with pytest.raises(ValueError):
        P.surgeon_split(df, "case_id", train=["S1"], test=["S1"])
    head, scores = P.train_probe(df, "x", "y", CLASSES, epochs=60, rate=0.1)
    got = {(r["split"], r["class"]): r for r in scores.collect()}
    assert got["test", "a"]["f1"] > 0.85 and got["test", "b"]["f1"] > 0.85 and got["val", "c"]["f1"] is None and head.thresholds[2] == 0.5
    # thresholds: the first of the best, by hand
    z = [(r["scores"], r["y"]) for r in P.predict(df, "x", head).where("split = 'val'").collect()]

    def f1(k, t):
        tp, fp, fn = (sum((s[k] >= t) == p and (y[k] > 0.5) == q for s, y in z) for p, q in ((True, True), (True, False), (False, True)))
        return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else -1

    assert head.thresholds[:2] == [max(P.THRESHOLDS, key=lambda t: (round(f1(k, t), 6), -t)) for k in (0, 1)]
    P.save(head, spark, f"{tmp_path}/head")
    again = P.load(spark, f"{tmp_path}/head")
    assert again.classes == CLASSES and np.array_equal(again.weights, head.weights) and again.thresholds == head.thresholds
    spark.createDataFrame([(head.to_json().replace("0.5", "0.6"), "x")], "head string, sha256 string").write.parquet(f"{tmp_path}/other")
    with pytest.raises(ValueError):
        P.load(spark, f"{tmp_path}/other")
    nothing = spark.createDataFrame([], "x array<double>, y array<double>")
    with pytest.raises(ValueError):
        P.train(nothing, "x", "y", CLASSES)
    assert P.predict(spark.createDataFrame([(None,)], "x array<double>"), "x", head).first()["scores"] is None


def frames(spark, n=10, images=6):
    rows = [(1, i * 1000, f"f{i}", hashlib.sha256(f"image {i % images}".encode()).hexdigest(), f"image {i % images}") for i in range(n)]
    return spark.createDataFrame(rows, "case_id int, t_ms long, frame_id string, image_sha256 string, content string").repartition(2)


class Encoder:
    """Features from the bytes' hash; counts what it was asked to encode."""

    def __init__(self):
        self.asked = []

    def __call__(self, images):
        self.asked += [r[0] for r in images.select("content").collect()]
        value = lambda k: F.conv(F.substring("image_sha256", k, 4), 16, 10).cast("double") / 65535
        regions = F.array(*[F.array(value(k), value(k + 4), F.lit(0.5)) for k in (9, 21, 33)])
        return images.select("image_sha256", F.array(value(1), value(5), F.lit(0.3)).alias("whole"), regions.alias("regions"), value(50).alias("clarity"))


def test_the_cache_encodes_once(spark, tmp_path):
    path, encode, one, other = f"{tmp_path}/cache", Encoder(), C.fingerprint({"model": "x", "side": 224}), C.fingerprint({"side": 256, "model": "x"})
    assert one == C.fingerprint({"side": 224, "model": "x"}) != other
    run = C.fill(frames(spark), path, one, encode)
    assert sorted(encode.asked) == [f"image {i}" for i in range(6)]
    got = C.with_features(frames(spark), path, one, run).collect()
    assert len(got) == 10 and not any(r["cache_hit"] for r in got) and len({tuple(r["whole"]) for r in got}) == 6
    # a second run computes nothing, a larger one what is new, another encoder everything
    encode.asked = []
    C.fill(frames(spark), path, one, encode)
    assert encode.asked == []
    more = frames(spark, 10, 8)
    later = C.fill(more, path, one, encode)
    assert sorted(encode.asked) == ["image 6", "image 7"]
    assert {(r["frame_id"], r["cache_hit"]) for r in C.with_features(more, path, one, later).collect()} == {(f"f{i}", i % 8 < 6) for i in range(10)}
    C.fill(frames(spark), path, other, encode)
    assert len(encode.asked) == 8
    # two runs that wrote the same image are one row; the older stays what it was
    C.read(spark, f"{tmp_path}/none", one)
    both = spark.read.schema(C.CACHE).parquet(path).where(F.col("fingerprint") == one).cache()
    both.count()
    both.limit(3).write.mode("append").partitionBy("fingerprint").parquet(path)
    assert C.read(spark, path, one).count() == 8


def test_what_is_refused(spark, tmp_path):
    key, encode = C.fingerprint({}), Encoder()
    bad = frames(spark).withColumn("content", F.when(F.col("frame_id") == "f3", "other").otherwise(F.col("content")))
    with pytest.raises(Exception, match="not what its hash says: f3"):
        C.select_candidates(bad, "case_id", "t_ms", f"{tmp_path}/a", key, encode, 3).collect()
    C.fill(frames(spark), f"{tmp_path}/b", key, encode)
    rows = spark.read.schema(C.CACHE).parquet(f"{tmp_path}/b").cache()
    rows.withColumn("clarity", F.col("clarity") + (F.col("clarity") == F.lit(rows.agg(F.max("clarity")).first()[0])).cast("int")).write.partitionBy("fingerprint").parquet(f"{tmp_path}/c")
    with pytest.raises(Exception, match="not what it was written as"):
        C.read(spark, f"{tmp_path}/c", key).collect()
    with pytest.raises(Exception, match="not in the cache"):
        C.with_features(frames(spark, 10, 8), f"{tmp_path}/b", key, "").collect()
    # a row of this encoder under another one's name
    rows.withColumn("fingerprint", F.lit("f" * 64)).write.partitionBy("fingerprint").parquet(f"{tmp_path}/d")
    with pytest.raises(Exception, match="not what it was written as"):
        C.read(spark, f"{tmp_path}/d", "f" * 64).collect()
    # two valid rows of one image that differ
    again = rows.withColumn("clarity", F.col("clarity") + 1).withColumn("row_sha256", C._row_hash(F.col("fingerprint")))
    rows.unionByName(again).write.partitionBy("fingerprint").parquet(f"{tmp_path}/e")
    with pytest.raises(Exception, match="differ"):
        C.read(spark, f"{tmp_path}/e", key).collect()


def test_candidates(spark, tmp_path):
    key = C.fingerprint({})
    got = C.select_candidates(frames(spark, 12, 12), "case_id", "t_ms", f"{tmp_path}/s", key, Encoder(), 5).orderBy("t_ms").collect()
    rows = C.with_features(frames(spark, 12, 12), f"{tmp_path}/s", key, "").orderBy("t_ms").collect()
    protected, chosen = S.choose(np.array([r["t_ms"] for r in rows], float), np.array([r["whole"] for r in rows], np.float32), np.array([r["regions"] for r in rows], np.float32), S.midranks(np.array([r["clarity"] for r in rows])), 5)
    assert [r["frame_id"] for r in got] == [rows[i]["frame_id"] for i in chosen] and [r["protected"] for r in got] == [i in protected for i in chosen] and not any(r["cache_hit"] for r in got)
    assert all(r["cache_hit"] for r in C.select_candidates(frames(spark, 12, 12), "case_id", "t_ms", f"{tmp_path}/s", key, Encoder(), 5).collect())


def test_candidates_look_up_features_once(spark, tmp_path):
    """The cache is joined once, and what belongs to a frame comes out as it went in: large numbers, null, several frames at a time, no case."""
    key, big = C.fingerprint({}), 2**53 + 1
    own = F.when(F.col("t_ms") == 3000, None).otherwise(F.lit(big) + F.col("t_ms"))
    x = frames(spark, 12, 12).withColumn("frame_id", own)
    x = x.union(x.where("t_ms in (0, 5000)").withColumn("frame_id", F.lit(-1).cast("long"))).union(x.withColumn("case_id", F.lit(None).cast("int")))
    got = C.select_candidates(x, "case_id", "t_ms", f"{tmp_path}/s", key, Encoder(), 14)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_sha256") == C.read(spark, f"{tmp_path}/s", key)._jdf.queryExecution().optimizedPlan().toString().count("row_sha256")
    rows = got.collect()
    assert {r["case_id"] for r in rows} == {1} and {r["t_ms"] for r in rows} == {i * 1000 for i in range(12)}
    # two frames at each of two times, all chosen: each comes with the other too
    assert sorted(r["frame_id"] or 0 for r in rows) == sorted([-1] * 4 + [0] + [big + i * 1000 for i in range(12) if i != 3] + [big, big + 5000])
