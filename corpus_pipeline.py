"""The corpus pipeline: five stages, each over all rows that the one before kept.

toxicity drops the documents that the factorisation machine marks as toxic (learned from the labels, as in query
op10); lines drops repeated lines and keeps every document; near_duplicates keeps one document of each component of
5-word shingle sets of similarity 0.8 or more (texts without words all stay); benchmark drops documents of which 5
per cent or more of the words are benchmark passages of 13 words; pieces adds each text's ids and whether they decode
to the text. Every stage but the last returns the columns of documents, and is written as Parquet and read again.

Defined results: a null text stays null, is neither toxic for its lack of words nor a near duplicate nor contaminated, and has no ids; so does an empty
one, and a text may become empty in the stage lines; ids may be null or repeat, and rows equal in all columns stay one in
near_duplicates, if they have words; further columns pass through, whatever their names, unless they are called ids, n_tokens or round_trip; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import columnar, decontaminate, line_dedup, ngram_join, pieces, toxicity
from caseflow.llm.queries import piece_model_path, remainder, table


#: Bytes of an Arrow batch: of 10,000 texts, Spark's own bound, each task would hold some 100 MB outside the heap, in and out.
BATCH_BYTES = "4m"


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage deletes the intermediate tables of the one before, unless docs still reads them: its result has been stored by then. Texts go to Python by BATCH_BYTES."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        with columnar.scratch(docs, "corpus_pipeline"):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    return toxicity.score(docs, machine, dict.fromkeys(docs.columns)).where("predicted = 0").select(*docs.columns)


@stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, shingle=line_dedup.FINE)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_component(docs)


@stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with ids, n_tokens and round_trip: the ids decode to the text, word-start marks read as spaces."""
    path = piece_model_path()
    own = [c for c in docs.columns if c not in ("ids", "n_tokens", "round_trip")]
    decoded = columnar.free([*own, "ids"], "decoded")[0]
    out = pieces.encode_and_decode(docs.select(*own), path, decoded_col=decoded)
    plain = F.translate(F.coalesce("text", F.lit("")), pieces.MARK, " ")
    return out.select(*own, "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col(decoded) == plain).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("lines", dedup_lines), ("near_duplicates", drop_near_duplicates), ("benchmark", drop_benchmark), ("pieces", encode)]

#: SQL can express neither the learned stage nor signatures: tests/llm/test_pipeline.py holds every stage, on what the one before kept, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = columnar.written(stage(spark, docs, sf_dir), name)
    return docs
