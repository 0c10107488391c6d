"""Streaming: windows, sessions, deduplication, and the keyed detector as a stateful operator.

The stateful operator and the batch form share one rule, so a replayed stream gives what the batch query gives.
Late rows (before a key's last time) are refused by the operator and come out as dead letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, glob: str = "*.parquet", files_per_trigger: int = 8) -> DataFrame:
    """Events of a directory's Parquet files, with an event-time column `at` that takes a watermark."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", glob).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums by event type and window."""
    x = stream.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "event_type")
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of a user: events less than `gap` apart."""
    x = stream.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("s"), "user_id")
    return x.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n")


def deduplicated(stream: DataFrame, key: list[str], late: str) -> DataFrame:
    """First row of each key within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(key)


def detector(stream: DataFrame, enter: int, leave: int) -> DataFrame:
    """Hysteresis entries and exits of every label of a case, as the rows arrive.

    stream: (case_id, t_ms, labels array<string>, order long), in time order by case. State: the last time and, for
    each label, its run length, whether it is in view, and the times of the current run. type "late" marks a refused
    row.
    """
    keep = max(enter, leave)
    out = "case_id long, label string, type string, t_ms long, onset_ms long, order long"
    state_type = "last_ms long, labels array<string>, visible array<boolean>, present array<boolean>, runs array<int>, times array<array<long>>"

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, known = -1, {}
        if state.exists:
            last, labels, visible, present, runs, times = state.get
            known = {k: [v, p, r, list(t)] for k, v, p, r, t in zip(labels, visible, present, runs, times, strict=True)}
        rows = []
        for row in pd.concat(list(pdfs)).sort_values(["t_ms", "order"]).itertuples():
            if row.t_ms < last:
                rows.append((key[0], None, "late", row.t_ms, row.t_ms, row.order))
                continue
            last = row.t_ms
            seen = set(row.labels)
            for label in sorted(seen | set(known)):
                s = known.setdefault(label, [False, False, 0, []])
                here = label in seen
                s[2] = s[2] + 1 if here == s[1] and s[2] else 1
                s[3] = (s[3] if s[2] > 1 else [])[-(keep - 1) :] + [row.t_ms] if keep > 1 else [row.t_ms]
                s[1] = here
                need = enter if here else leave
                if here != s[0] and s[2] >= need:
                    s[0] = here
                    rows.append((key[0], label, "entered" if here else "left", row.t_ms, s[3][-need], row.order))
        names = sorted(known)
        state.update((last, names, [known[k][0] for k in names], [known[k][1] for k in names], [known[k][2] for k in names], [known[k][3] for k in names]))
        yield pd.DataFrame(rows, columns=["case_id", "label", "type", "t_ms", "onset_ms", "order"])

    return stream.groupBy("case_id").applyInPandasWithState(step, out, state_type, "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into Parquet files and reads them."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_table(stream: DataFrame, checkpoint: str, key: list[str], path: str) -> DataFrame:
    """Runs an updating aggregate to its end, watermark or not: every micro-batch is written, the last value of a key wins."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("append").parquet(path)

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in key]
    x = stream.sparkSession.read.parquet(path).groupBy(*key).agg(F.max_by(F.struct(*rest), "__batch").alias("r"))
    return x.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])
