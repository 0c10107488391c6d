"""Linear probes over embeddings: standardisation, multi-label logistic heads, thresholds, scores by split.

A head is trained by full gradients: each epoch the tasks sum the gradient of their rows, the executors add the sums by cell, and the driver, which
sees as many numbers as the head has weights, takes one Adam step and sends the weights out again. Rows are never gathered, and the result
depends on how they are partitioned only by the rounding of sums.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.operators import metrics

#: Thresholds that are tried.
THRESHOLDS = [round(0.1 + 0.05 * i, 2) for i in range(17)]
_BETA1, _BETA2, _EPS = 0.9, 0.999, 1e-8


@dataclass
class Head:
    """Weights (class, dimension) and biases over standardised features."""

    classes: list[str]
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    thresholds: list[float] = field(default_factory=list)
    history: list[float] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Head:
        return cls(**{k: np.array(v) if k in ("mean", "std", "weights", "bias") else v for k, v in json.loads(text).items()})


def save(head: Head, spark: SparkSession, path: str) -> None:
    """One row: the head as JSON and its hash. An existing head is not replaced."""
    text = head.to_json()
    spark.createDataFrame([(text, hashlib.sha256(text.encode()).hexdigest())], "head string, sha256 string").coalesce(1).write.mode("error").parquet(path)


def load(spark: SparkSession, path: str) -> Head:
    text, sha = spark.read.parquet(path).first()
    if hashlib.sha256(text.encode()).hexdigest() != sha:
        raise ValueError(f"the head at {path} changed since it was trained")
    return Head.from_json(text)


def surgeon_split(rows: DataFrame, case: str, **parts: list[str]) -> DataFrame:
    """rows of cases named like S1A2 with the split of their surgeon (S1); others, and surgeons of no part, go."""
    names = [s for part in parts.values() for s in part]
    if len(names) != len(set(names)):
        raise ValueError("a surgeon may be in one split only")
    of = F.create_map(*[F.lit(x) for name, part in parts.items() for s in part for x in (s, name)]) if names else F.create_map().cast("map<string,string>")
    who = F.nullif(F.regexp_extract(case, r"^(S\d+)A\d+\z", 1), F.lit(""))
    return rows.withColumn("split", F.try_element_at(of, who)).where("split is not null")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return pc.list_flatten(batch.column(name)).to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, cells, size: int) -> np.ndarray:
    """The sum over all rows of cells(batch), an array of `size` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total, some = total + cells(batch), True
        if some:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(np.arange(size)), "v": pa.array(total)})

    out = np.zeros(size)
    for cell, v in rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v")).collect():
        out[cell] = v
    return out


def standardisation(rows: DataFrame, features: str) -> tuple[np.ndarray, np.ndarray]:
    """(mean, population deviation + 1e-6) of each dimension; the second pass is centred."""
    first = rows.select(features).where(F.col(features).isNotNull()).limit(1).first()
    if first is None:
        raise ValueError("no rows to train on")
    d = len(first[0])
    x = rows.select(F.col(features).cast("array<double>").alias("x")).where("x is not null")
    s = _summed(x, lambda b: np.append(_matrix(b, "x").sum(0), b.num_rows), d + 1)
    mean = s[:d] / s[d]
    spread = _summed(x, lambda b: ((_matrix(b, "x") - mean) ** 2).sum(0), d)
    return mean, np.sqrt(spread / s[d]) + 1e-6


def positive_weights(rows: DataFrame, targets: str, mask: str | None = None) -> np.ndarray:
    """Negatives over positives of each class among the rows that its mask counts, between 1 and 200."""
    x = rows.select(targets, *([mask] if mask else []))
    k = len(x.first()[0])
    s = _summed(x, lambda b: np.concatenate([(_matrix(b, targets) * (_matrix(b, mask) if mask else 1)).sum(0), _matrix(b, mask).sum(0) if mask else np.full(k, b.num_rows)]), 2 * k)
    return np.clip((s[k:] - s[:k]) / np.maximum(s[:k], 1), 1, 200)


def train(rows: DataFrame, features: str, targets: str, classes: list[str], mask: str | None = None, positive: np.ndarray | None = None, scale: tuple[np.ndarray, np.ndarray] | None = None, epochs: int = 40, rate: float = 0.01) -> Head:
    """A head from rows of features and targets (arrays, one 0 or 1 a class), by the mean logistic loss over all rows and classes.

    mask: an array of weights by class; loss and mean count them (cells of a frame whose class is absent weigh 0). positive: weight of
    each class's positives. scale: mean and deviation, else those of the rows. Weights start at zero, so that nothing is drawn. Of a class without
    positives (or negatives) all gradients but the bias's are rounding, which Adam's scaling makes large: its small weights mean nothing.
    """
    mean, std = scale or standardisation(rows, features)
    d, k = len(mean), len(classes)
    lift = np.ones(k) if positive is None else positive
    x = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(targets).cast("array<double>").alias("y"), *([F.col(mask).cast("array<double>").alias("m")] if mask else []))
    theta, first, second, history = np.zeros((k, d + 1)), np.zeros((k, d + 1)), np.zeros((k, d + 1)), []
    context = rows.sparkSession.sparkContext
    for epoch in range(1, epochs + 1):
        ship = context.broadcast(theta)

        def cells(batch: pa.RecordBatch, ship=ship) -> np.ndarray:
            own = ship.value
            z = np.hstack([(_matrix(batch, "x") - mean) / std, np.ones((batch.num_rows, 1))])
            y, m = _matrix(batch, "y"), _matrix(batch, "m") if mask else np.ones((batch.num_rows, k))
            logit = z @ own.T
            p = 1 / (1 + np.exp(-logit))
            soft = np.logaddexp(0, -logit)  # -log p, and -log(1 - p) is that plus the logit
            loss = m * (lift * y * soft + (1 - y) * (soft + logit))
            slope = m * (p * (lift * y + 1 - y) - lift * y)
            return np.concatenate([(slope.T @ z).reshape(-1), [loss.sum(), m.sum()]])

        s = _summed(x, cells, k * (d + 1) + 2)
        ship.unpersist()
        weight = max(s[-1], 1.0) if s[-1] == 0 else s[-1]
        gradient = s[:-2].reshape(k, d + 1) / weight
        history.append(float(s[-2] / weight))
        first = _BETA1 * first + (1 - _BETA1) * gradient
        second = _BETA2 * second + (1 - _BETA2) * gradient**2
        theta = theta - rate * (first / (1 - _BETA1**epoch)) / (np.sqrt(second / (1 - _BETA2**epoch)) + _EPS)
    return Head(classes, mean, std, theta[:, :d], theta[:, d], [0.5] * k, history)


def predict(rows: DataFrame, features: str, head: Head, out: str = "scores") -> DataFrame:
    """rows with each class's probability, an array; null where the features are."""
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != out), T.StructField(out, T.ArrayType(T.DoubleType()))])
    ship = rows.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = ship.value
        for batch in batches:
            column = batch.column(features)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            given = pa.RecordBatch.from_arrays([column.drop_null()], names=["x"])
            z = (_matrix(given, "x") - h.mean) / h.std if given.num_rows else np.zeros((0, len(h.mean)))
            p = 1 / (1 + np.exp(-(z @ h.weights.T + h.bias)))
            scores = iter(p.tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in schema.names[:-1]), pa.array([next(scores) if t else None for t in there], pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _by_class(scored: DataFrame, targets: str, classes: list[str]) -> DataFrame:
    """A row for each row and class: score and whether it is so."""
    names = F.array(*[F.lit(c) for c in classes])
    each = F.arrays_zip(names.alias("class"), F.col("scores").alias("score"), (F.col(targets)).alias("actual"))
    return scored.where("scores is not null").withColumn("__e", F.explode(each)).select(*[c for c in scored.columns if c not in ("scores", targets)], F.col("__e.class").alias("class"), F.col("__e.score").alias("score"), (F.col("__e.actual") > 0.5).alias("actual"))


def best_thresholds(scored: DataFrame, targets: str, classes: list[str]) -> list[float]:
    """The first threshold of the best F1 of each class; 0.5 where a class is neither there nor found at any, or there are no rows."""
    found = {r["class"]: r for r in metrics.sweep(_by_class(scored, targets, classes), ["class"], "score", F.col("actual"), THRESHOLDS).collect()}
    return [found[c]["threshold"] if c in found and found[c]["f1"] is not None else 0.5 for c in classes]


def scores_by(scored: DataFrame, targets: str, head: Head, keys: list[str]) -> DataFrame:
    """(keys, class, n, tp, fp, fn, f1) by the head's thresholds."""
    limit: Column = F.element_at(F.create_map(*[F.lit(x) for c, t in zip(head.classes, head.thresholds, strict=True) for x in (c, float(t))]), F.col("class"))
    x = _by_class(scored, targets, head.classes).withColumn("__p", F.col("score") >= limit)
    n = x.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("n"))
    return metrics.confusion(x, [*keys, "class"], F.col("__p"), F.col("actual")).join(n, [*keys, "class"])


def train_probe(rows: DataFrame, features: str, targets: str, classes: list[str], epochs: int = 40, rate: float = 0.01) -> tuple[Head, DataFrame]:
    """(head, its scores by split and class) from rows with a split: trained on `train`, thresholds from `val`, from `train` where that is empty."""
    head = train(rows.where("split = 'train'"), features, targets, classes, epochs=epochs, rate=rate)
    scored = predict(rows, features, head)
    for name in ("val", "train"):
        part = scored.where(F.col("split") == name)
        if not part.isEmpty():
            head.thresholds = best_thresholds(part, targets, classes)
            break
    return head, scores_by(scored, targets, head, ["split"])
