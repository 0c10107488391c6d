"""Human curation as a log of requests: each is taken or refused on the version that the ones before it left, also within one batch.

Only requests that were taken are kept (the history); what is shown, the overlay, follows from the history. A request made on another version than
the current one is a conflict, and changes nothing; a request that is in the history already is not taken again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import fold
from caseflow.operators.graph import cut_lineage

KEY = ["review_identity", "frame_id"]
#: at: when the request was made, the version that it makes; given: whether `expected`, the version it was made on, counts (null: none yet).
REQUEST = "review_identity string, frame_id string, at string, action string, text string, given boolean, expected string"
ACTIONS, TEXT_LIMIT = ("edit", "delete", "restore"), 100_000


def overlay(history: DataFrame) -> DataFrame:
    """(key, created_at, updated_at, deleted, text, changes) of each curated frame, from its taken requests; text is null until one is given."""
    x = history.groupBy(*KEY).agg(
        F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.max_by(F.col("action") == "delete", F.when(F.col("action") != "edit", F.col("at"))).alias("deleted"),
        F.max_by("text", F.when(F.col("action") == "edit", F.col("at"))).alias("text"), F.count(F.lit(1)).alias("changes"),
    )
    return x.withColumn("deleted", F.coalesce("deleted", F.lit(False)))


class _Frame:
    """What the next request of a frame is held against."""

    def __init__(self) -> None:
        self.version: str | None = None
        self.deleted = False


def _decide(state: _Frame, row: dict) -> tuple[str | None]:
    if row["__stored"]:
        state.version, state.deleted = row["at"], row["__deleted"]
        return ("stored",)
    action, text = row["action"], row["text"]
    if action not in ACTIONS:
        return ("unknown_action",)
    if (action == "edit") != (text is not None) or (text is not None and len(text) > TEXT_LIMIT):
        return ("text",)
    if row["given"] and row["expected"] != state.version:
        return ("conflict",)
    if state.version is not None and row["at"] <= state.version:
        return ("not_later",)
    if action == "edit" and state.deleted:
        return ("deleted",)
    state.version, state.deleted = row["at"], state.deleted if action == "edit" else action == "delete"
    return (None,)


def decide(history: DataFrame, requests: DataFrame) -> DataFrame:
    """requests, but for those of the history, with rule_id: null where one is taken, else why not.

    unknown_action; text (an edit without or with too long a text, another action with one); conflict (made on another version); not_later (as old
    as the current version, or older); deleted (an edit of a deleted frame: restore it first). A frame's requests are held one after another, by time.
    """
    new = requests.join(history.select(*KEY, "at"), [*KEY, "at"], "left_anti").withColumn("__stored", F.lit(False))
    old = overlay(history).select(*KEY, F.col("updated_at").alias("at"), F.col("deleted").alias("__deleted"), F.lit(True).alias("__stored")).join(new.select(*KEY).distinct(), KEY, "left_semi")
    both = new.unionByName(old, allowMissingColumns=True).withColumn("__first", ~F.col("__stored"))
    reads = ["at", "action", "text", "given", "expected", "__stored", "__deleted"]
    return fold.scan(both, KEY, ["__first", "at"], reads, _Frame, _decide, "rule_id string").where("not __stored").drop("__stored", "__deleted", "__first")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The history at a path; empty where nothing was taken yet. A request that two writers took is one."""
    try:
        return spark.read.schema(REQUEST).parquet(path).dropDuplicates([*KEY, "at"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REQUEST)


def commit(path: str, requests: DataFrame) -> DataFrame:
    """Appends the requests that are taken to the history at the path, and returns those that are not, with their rule_id. A batch that is committed again changes nothing."""
    spark = requests.sparkSession
    names = [c.split(" ")[0] for c in REQUEST.split(", ")]
    # checkpointed: what was read of the history must not be read again once it has grown
    decided = cut_lineage(decide(read(spark, path), requests.select(*names)))
    refused = decided.where("rule_id is not null")
    decided.where("rule_id is null").select(*names).write.mode("append").parquet(path)
    return refused
