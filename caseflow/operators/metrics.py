"""Metrics: nearest-rank percentiles, grouped accuracy, F1, thresholds, boxes and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.graph import cut_lineage


def nearest_rank(rows: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Count, mean, max and nearest-rank percentiles (position half-even(q * (n - 1))), rounded to 2 places.

    Ranks come from a window by key, not from a collected list, so that a group may be of any size.
    """
    w = Window.partitionBy(*keys)
    x = rows.where(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    at = lambda q: F.max(F.when(F.col("__i") == F.bround(q * (F.col("__n") - 1)).cast("int"), F.col(value)))
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 2).alias("mean"), F.round(F.max(value), 2).alias("max"), *[F.round(at(q), 2).alias(name) for name, q in qs.items()])


def accuracy(grades: DataFrame, answerer: str, template: str) -> DataFrame:
    """Accuracy by answerer, and by answerer and template (template null: overall)."""
    x = grades.groupingSets([[answerer], [answerer, template]], answerer, template)
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"), F.round(F.avg(F.col("correct").cast("int")), 3).alias("accuracy"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2 tp / (2 tp + fp + fn), null if there is nothing to find and nothing was found."""
    return F.round(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), 6)


def confusion(rows: DataFrame, keys: list[str], predicted: Column, actual: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if(predicted & actual).alias("tp"), F.count_if(predicted & ~actual).alias("fp"), F.count_if(~predicted & actual).alias("fn")).withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def sweep(rows: DataFrame, keys: list[str], score: str, actual: Column, thresholds: list[float]) -> DataFrame:
    """(keys, threshold, f1): the first threshold of the best F1. The thresholds are a parameter: rows are exploded once each."""
    x = rows.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    c = confusion(x.withColumn("__p", F.col(score) >= F.col("threshold")), [*keys, "threshold"], F.col("__p"), actual)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("f1"), "threshold")) if keys else F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("f1"), "threshold"))
    return c.withColumn("__best", best).where("__best = 1").select(*keys, "threshold", "f1")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); 0 if both are empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    return F.coalesce(w * h / F.nullif(area(a) + area(b) - w * h, F.lit(0.0)), F.lit(0.0))


def point_to_box(x: Column, y: Column, box: Column, aspect: float) -> Column:
    """Distance of a point to a box, x scaled by the aspect ratio; 0 inside."""
    dx = F.greatest(box["x1"] - x, F.lit(0.0), x - box["x2"]) * aspect
    dy = F.greatest(box["y1"] - y, F.lit(0.0), y - box["y2"])
    return F.sqrt(dx * dx + dy * dy)


def crop(box: Column, window: Column) -> Column:
    """A box in a crop's own coordinates, clipped to it; null if they do not meet."""
    clip = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    w, h = window["x2"] - window["x1"], window["y2"] - window["y1"]
    out = F.struct(
        clip((box["x1"] - window["x1"]) / w).alias("x1"), clip((box["y1"] - window["y1"]) / h).alias("y1"),
        clip((box["x2"] - window["x1"]) / w).alias("x2"), clip((box["y2"] - window["y1"]) / h).alias("y2"),
    )
    return F.when((out["x2"] > out["x1"]) & (out["y2"] > out["y1"]), out)


def scalar_paths(rows: DataFrame, key: list[str], value: str, leave: tuple[str, ...] = ()) -> DataFrame:
    """(key, path, scalar) of all scalars in nested objects, nulls included: names with blanks for _ and - and a capital, joined by ` / `.

    value is a variant; lists, and what they hold, are left out, and so are the top-level names in `leave`. Objects are opened level by level, as many rounds as the deepest nesting.
    Where two names of one object read alike, the later one in order of names stands.
    """
    spark = rows.sparkSession
    label = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 20)))
    kind = F.schema_of_variant("v")
    level, out, depth = rows.select(*key, F.lit("").alias("__path"), F.col(value).alias("v")).where(kind.startswith("OBJECT")), None, 0
    while True:
        each = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(*key, "__path", F.col("key").alias("__name"), F.col("value").alias("v")) if not set(key) & {"key", "value", "pos"} else None
        if each is None:
            raise ValueError("key columns may not be named key, value or pos")
        if not depth and leave:
            each = each.where(~F.col("__name").isin(*leave))
        name = label(F.translate("__name", "_-", "  "))
        each = each.withColumn("__path", F.when(F.col("__path") == "", name).otherwise(F.concat_ws(" / ", "__path", name)))
        each = cut_lineage(each)
        found = each.where(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")).groupBy(*key, F.col("__path").alias("path")).agg(F.max_by(F.col("v").cast("string"), "__name").alias("scalar"))
        out = found if out is None else out.unionByName(found)
        level, depth = each.where(kind.startswith("OBJECT")).select(*key, "__path", "v"), depth + 1
        if level.isEmpty():
            return out
