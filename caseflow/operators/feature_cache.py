"""An embedding cache that keeps what it computes, and candidate selection over it.

The cache is a table partitioned by the encoder's fingerprint, one row an image hash, and each row carries a hash of all that it
holds. Only images that an encoder has not seen are encoded, each distinct one once; the rows are appended, so that what other runs
wrote meanwhile stays. Two runs may write the same image: reading takes equal rows for one. A row whose content is not
what its hash says, or two rows of one image that differ, are refused: the read fails.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import selection

#: What an encoder gives for an image: a vector of the whole, one of each region, and how clear it is.
FEATURES = "whole array<float>, regions array<array<float>>, clarity double"
CACHE = f"image_sha256 string, {FEATURES}, run string, row_sha256 string, fingerprint string"
#: (image_sha256, content) of images to encode -> (image_sha256, whole, regions, clarity).
Encode = Callable[[DataFrame], DataFrame]


def fingerprint(identity: dict) -> str:
    """Hash of an encoder's identity: anything that changes its output (weights, preprocessing, device) belongs into it."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _row_hash(key: Column) -> Column:
    return F.sha2(F.to_json(F.struct(key.alias("fingerprint"), "image_sha256", "whole", "regions", "clarity", "run")), 256)


def read(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(image_sha256, whole, regions, clarity, run) of an encoder's images; none where there is no cache yet."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE).drop("row_sha256", "fingerprint")
    good = F.coalesce(F.col("row_sha256") == _row_hash(F.col("fingerprint")), F.lit(False))
    checked = rows.where(F.col("fingerprint") == key).withColumn("whole", F.when(good, F.col("whole")).otherwise(F.raise_error(F.concat(F.lit("cache row is not what it was written as: "), F.coalesce("image_sha256", F.lit("null"))))))
    # rows of one image, of several runs: one of them, if they agree
    what = F.sha2(F.to_json(F.struct("whole", "regions", "clarity")), 256)
    one = checked.groupBy("image_sha256").agg(F.min_by(F.struct("whole", "regions", "clarity", "run"), "run").alias("r"), (F.min(what) == F.max(what)).alias("same"))
    same = F.when(F.col("same"), F.col("r.clarity")).otherwise(F.raise_error(F.concat(F.lit("cache rows of one image differ: "), "image_sha256")))
    return one.select("image_sha256", "r.whole", "r.regions", same.alias("clarity"), "r.run")


def verified(frames: DataFrame, content: str = "content") -> DataFrame:
    """frames whose content is what image_sha256 says; another or none fails the read, naming frame_id."""
    ok = F.coalesce(F.sha2(F.col(content), 256) == F.col("image_sha256"), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("image is missing or not what its hash says: "), F.coalesce(F.col("frame_id").cast("string"), F.lit("null"))))
    return frames.withColumn("image_sha256", F.when(ok, F.col("image_sha256")).otherwise(wrong))


def fill(frames: DataFrame, path: str, key: str, encode: Encode, run: str | None = None) -> str:
    """Encodes the distinct images (image_sha256, content) of frames that the cache lacks and appends them; returns the run's id, which the new rows carry."""
    spark, run = frames.sparkSession, run or uuid.uuid4().hex
    known = read(spark, path, key).select("image_sha256")
    missing = frames.join(known, "image_sha256", "left_anti").groupBy("image_sha256").agg(F.any_value("content").alias("content"))
    new = encode(missing).select("image_sha256", F.col("whole").cast("array<float>"), F.col("regions").cast("array<array<float>>"), F.col("clarity").cast("double"), F.lit(run).alias("run"))
    new.withColumn("row_sha256", _row_hash(F.lit(key))).withColumn("fingerprint", F.lit(key)).write.mode("append").partitionBy("fingerprint").parquet(path)
    return run


def with_features(frames: DataFrame, path: str, key: str, run: str) -> DataFrame:
    """frames without content, with their images' features and cache_hit: whether another run than this one had encoded the image.

    Frames with the same pixels share one row of the cache and keep their own places in time. A frame whose image the cache lacks fails the read.
    """
    cache = read(frames.sparkSession, path, key)
    x = frames.drop("content").join(cache, "image_sha256", "left")
    there = F.when(F.col("whole").isNotNull(), F.col("run") != run).otherwise(F.raise_error(F.concat(F.lit("image is not in the cache: "), F.coalesce("image_sha256", F.lit("null")))))
    return x.withColumn("cache_hit", there).drop("run")


def select_features(frames: DataFrame, case: str, order: str, budget: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(case, order, protected, kept columns) of the frames chosen from features, see selection.choose(): a choice depends on those before, so one case is one task.

    Every frame of the case at a chosen frame's time comes out with it; frames without a case or a time never do.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    out = [case, order, "protected", *keep]

    def run(table: pa.Table) -> pa.Table:
        t = table.column(order).to_pandas().to_numpy()
        table = table.take(pa.array(np.argsort(t, kind="stable")))
        pdf, t = table.select(["whole", "regions", "clarity"]).to_pandas(), np.sort(t)
        whole, regions = np.array(pdf["whole"].tolist(), np.float32), np.array([np.stack(r) for r in pdf["regions"]], np.float32)
        protected, chosen = selection.choose(t.astype(np.float64), whole, regions, selection.midranks(pdf["clarity"].to_numpy()), budget)
        low, high = (np.searchsorted(t, t[chosen], side) for side in ("left", "right"))
        of = np.repeat(np.arange(len(chosen)), high - low)
        own = low[of] + np.arange(len(of)) - np.searchsorted(of, of)
        got = table.take(pa.array(own)).append_column("protected", pa.array(np.isin(chosen, protected)[of], pa.bool_()))
        return got.filter(pc.and_(got.column(case).is_valid(), got.column(order).is_valid())).select(out)

    schema = ", ".join(f"`{c}` {kinds.get(c, 'boolean')}" for c in out)
    return frames.select(case, order, *keep, "whole", "regions", "clarity").groupBy(case).applyInArrow(run, schema)


def select_candidates(frames: DataFrame, case: str, order: str, path: str, key: str, encode: Encode, budget: int) -> DataFrame:
    """(case, order, protected, frame_id, image_sha256, cache_hit) of each case's chosen frames; new images are encoded first.

    frames: (case, order, frame_id, image_sha256, content); order is the time. Of frames of a case at one time, all or none are chosen.
    """
    x = verified(frames)
    run = fill(x, path, key, encode)
    # what belongs to a frame goes along with its features: looking it up afterwards would join the frames with the cache once more
    return select_features(with_features(x, path, key, run), case, order, budget, ("frame_id", "image_sha256", "cache_hit"))
