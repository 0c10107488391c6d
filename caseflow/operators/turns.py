"""What a student has seen by each turn of a conversation, and the rules that hang on it.

The set that is visible at a turn is all frames of the turns until then. It is kept as each frame's first turn, one row a frame, not as a set a
turn: whether something was visible is then a comparison, and a turn's manifest is right if all it names was visible and it names as many as were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.contracts import all_of, violation


def first_seen(images: DataFrame, record: str) -> DataFrame:
    """(record, frame_id, frame_index, first): the turn of each frame's first image. images: (record, turn, position, frame_id, frame_index)."""
    return images.groupBy(record, "frame_id").agg(F.min("frame_index").alias("frame_index"), F.min("turn").alias("first"))


def visible_counts(turns: DataFrame, seen: DataFrame, record: str) -> DataFrame:
    """turns with n_visible and last_visible: how many frames are visible at each turn, and the largest of their numbers."""
    new = seen.groupBy(record, F.col("first").alias("turn")).agg(F.count(F.lit(1)).alias("__n"), F.max("frame_index").alias("__last"))
    w = Window.partitionBy(record).orderBy("turn")
    x = turns.join(new, [record, "turn"], "left")
    return x.withColumn("n_visible", F.coalesce(F.sum("__n").over(w), F.lit(0))).withColumn("last_visible", F.max("__last").over(w)).drop("__n", "__last")


def unseen(cited: DataFrame, seen: DataFrame, record: str) -> DataFrame:
    """Rows (record, turn, frame_id, ...) of frames that are not visible at their turn."""
    # by a table of the frames of a task's records: the cited rows, which are many more, are not sorted
    x = cited.join(seen.select(record, "frame_id", "first").hint("shuffle_hash"), [record, "frame_id"], "left")
    return x.where(F.coalesce(F.col("first") > F.col("turn"), F.lit(True))).drop("first")


def _rule(rows: DataFrame, record: str, rule: str, key: Column, message: str) -> DataFrame:
    return violation(rows, F.col(record), rule, F.concat_ws(":", F.col("turn").cast("string"), key.cast("string")), message)


def _differ(named: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    a, b = named.select(*keys).distinct(), actual.select(*keys).distinct()
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def violations(turns: DataFrame, images: DataFrame, record: str, manifest: DataFrame | None = None, annotations: DataFrame | None = None, evidence: DataFrame | None = None, claims: tuple[DataFrame, DataFrame] | None = None, reviews: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(record_id, rule_id, key, message) of a record's turns that break a rule; key is the turn and what it is about.

    turns: (record, turn, cutoff_index, causal, mode). images: (record, turn, position, frame_id, frame_index; null where the image is no frame of the record).
    manifest: (record, turn, frame_id) the frames a turn says the student has seen. annotations: (record, turn, annotation_id, kind, frame_id) supplied ones, a
    row a frame. evidence: (record, turn, claim_id, frame_id) what expressed claims and their supports rest on. claims, reviews: (named, actual) pairs of (record, turn, id).
    """
    seen = first_seen(images.where("frame_index is not null"), record)
    counted = visible_counts(turns, seen, record)
    w = Window.partitionBy(record).orderBy("turn")
    own = Window.partitionBy(record, "turn").orderBy("position")
    falling = turns.withColumn("__before", F.lag("cutoff_index").over(w)).where("cutoff_index < __before")
    unsorted = images.where("frame_index is not null").withColumn("__before", F.lag("frame_index").over(own)).where("frame_index < __before")
    at = F.lit("")
    found = [
        _rule(falling, record, "cutoff", at, "the cutoff falls"),
        _rule(images.where("frame_index is null"), record, "image", F.col("position"), "the image is no frame of the record"),
        _rule(unsorted, record, "order", F.col("position"), "images are not in order of time"),
        _rule(counted.where("causal and last_visible > cutoff_index"), record, "future", F.col("last_visible"), "a later frame than the cutoff is visible"),
        _rule(turns.where("causal and not (mode <=> 'causal_prefix')"), record, "mode", at, "a causal record has a retrospective turn"),
    ]
    if manifest is not None:
        named = manifest.select(record, "turn", "frame_id")
        n = named.distinct().groupBy(record, "turn").agg(F.count(F.lit(1)).alias("__n"))
        short = counted.join(n, [record, "turn"], "left").where(F.coalesce("__n", F.lit(0)) < F.col("n_visible"))
        found += [_rule(unseen(named, seen, record).distinct(), record, "manifest", F.col("frame_id"), "the manifest names a frame that is not visible"), _rule(short, record, "manifest", at, "the manifest leaves out visible frames")]
    if annotations is not None:
        outcome = annotations.join(turns.select(record, "turn", "causal"), [record, "turn"]).where("causal and kind = 'outcome'").select(record, "turn", "annotation_id").distinct()
        late = unseen(annotations.where("frame_id is not null"), seen, record).select(record, "turn", "annotation_id").distinct()
        found += [_rule(outcome, record, "outcome", F.col("annotation_id"), "an outcome is supplied to a causal student"), _rule(late, record, "annotation", F.col("annotation_id"), "an annotation of a frame that is not visible")]
    if evidence is not None:
        found.append(_rule(unseen(evidence, seen, record).select(record, "turn", "claim_id").distinct(), record, "evidence", F.col("claim_id"), "a claim rests on a frame that is not visible"))
    for rule, pair in (("claims", claims), ("reviews", reviews)):
        if pair is not None:
            found.append(_rule(_differ(*pair, [record, "turn", "id"]), record, rule, F.col("id"), f"the turn's {rule} are not the actual ones"))
    return all_of(*found)
