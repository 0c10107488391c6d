"""Embeddings: the cache that keeps what it computes, candidates chosen over it, probes trained on the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import feature_cache as C
from caseflow.operators import probe as P
from caseflow.operators import selection as S
from caseflow.plans.event_queries import FRAMES, frames
from caseflow.plans.registry import place, query, table

IDENTITY = {"model": "table", "regions": 4}
CLASSES = ["low", "odd", "high"]


def _images(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose image is one of the embeddings, by event number: its bytes are its name."""
    n = table(spark, d, "embeddings").agg((F.max("vec_id") + 1).alias("n"))  # one row
    name = F.concat(F.lit("image:"), (F.col("event_id") % F.col("n")).cast("string"))
    x = frames(spark, d).join(F.broadcast(n)).withColumn("content", name)
    return x.select("case_id", F.col("frame_index").cast("long").alias("frame_index"), F.col("event_id").alias("frame_id"), F.sha2("content", 256).alias("image_sha256"), "content")


def _encoder(spark: SparkSession, d: str) -> C.Encode:
    """The table's vectors as the encoder: unit vectors of the whole and of its quarters, the variance as clarity."""
    e = table(spark, d, "embeddings").select(F.concat(F.lit("image:"), F.col("vec_id").cast("string")).alias("content"), "embedding")
    unit = lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(S.dot(v, v)), F.lit(1e-12)))
    size = F.expr("size(embedding) div 4")
    regions = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: unit(F.slice("embedding", i * size + 1, size)))
    return lambda images: images.join(e, "content").select("image_sha256", unit(F.col("embedding")).alias("whole"), regions.alias("regions"), S.variance("embedding").alias("clarity"))


@query(
    f"""WITH {FRAMES}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), v AS (SELECT vec_id, round(list_aggregate(embedding::DOUBLE[], 'var_pop'), 4) AS clarity FROM embeddings)
SELECT case_id, frame_index, sha256('image:' || (event_id % n)) AS image_sha256, event_id % n % 3 = 0 AS cache_hit, clarity FROM frames, n JOIN v ON vec_id = event_id % n"""
)
def embedding_cache_runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over one cache: the first encodes every third image, the second finds those and encodes the others, each once however many frames show it."""
    path, key, encode, x = place(spark, "cache"), C.fingerprint(IDENTITY), _encoder(spark, d), _images(spark, d)
    C.fill(C.verified(x.where("split(content, ':')[1] % 3 = 0")), path, key, encode)
    run = C.fill(C.verified(x), path, key, encode)
    return C.with_features(x, path, key, run).select("case_id", "frame_index", "image_sha256", "cache_hit", F.round("clarity", 4).alias("clarity"))


@query()
def candidate_selection(spark: SparkSession, d: str) -> DataFrame:
    """Six frames of each case, chosen from cached features of all its frames."""
    got = C.select_candidates(_images(spark, d), "case_id", "frame_index", place(spark, "cache"), C.fingerprint(IDENTITY), _encoder(spark, d), 6)
    return got.select("case_id", "frame_index", "frame_id", "protected", "image_sha256")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of ten surgeons' cases and what their label says of them: below 3, odd, above 6."""
    k = F.col("label")
    case = F.concat(F.lit("S"), F.col("vec_id") % 10, F.lit("A"), F.col("vec_id"))
    rows = table(spark, d, "embeddings").where("embedding is not null and label is not null")
    x = rows.select(case.alias("case_id"), F.col("embedding").alias("x"), F.array((k < 3).cast("double"), (k % 2).cast("double"), (k > 6).cast("double")).alias("y"))
    return P.surgeon_split(x, "case_id", train=[f"S{i}" for i in range(6)], val=["S6", "S7"], test=["S8", "S9"])


@query()
def probe_scores(spark: SparkSession, d: str) -> DataFrame:
    """A probe's F1 by split and class: trained on six surgeons, thresholds from two, tested on two."""
    _, scores = P.train_probe(labelled(spark, d), "x", "y", CLASSES, epochs=40, rate=0.01)
    return scores


@query(
    """WITH e AS (SELECT vec_id % 10 < 6 AS t, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS dim FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
n AS (SELECT count(*) FILTER (label < 3) AS a, count(*) FILTER (label % 2 = 1) AS b, count(*) FILTER (label > 6) AS c, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id % 10 < 6)
SELECT dim::BIGINT AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v) + 1e-6, 6) AS std, NULL AS class, NULL::DOUBLE AS positive FROM e WHERE t GROUP BY dim
UNION ALL SELECT NULL, NULL, NULL, unnest(['low', 'odd', 'high']), unnest([round(least(200.0, greatest(1.0, (n - a) / greatest(a, 1)::DOUBLE)), 6), round(least(200.0, greatest(1.0, (n - b) / greatest(b, 1)::DOUBLE)), 6), round(least(200.0, greatest(1.0, (n - c) / greatest(c, 1)::DOUBLE)), 6)]) FROM n"""
)
def probe_scale(spark: SparkSession, d: str) -> DataFrame:
    """What training starts from: mean and deviation of each dimension, and the weight of each class's positives."""
    train = labelled(spark, d).where("split = 'train'")
    mean, std = P.standardisation(train, "x")
    rows = [(i, float(m), float(s), None, None) for i, (m, s) in enumerate(zip(mean, std, strict=True))]
    rows += [(None, None, None, c, float(w)) for c, w in zip(CLASSES, P.positive_weights(train, "y"), strict=True)]
    r6 = lambda c: F.round(c, 6).alias(c)
    return spark.createDataFrame(rows, "dim long, mean double, std double, class string, positive double").select("dim", r6("mean"), r6("std"), "class", r6("positive"))
