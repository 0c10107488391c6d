"""Readers: JSON records, strict CSV with physical line numbers, release directories, label tables, log segments."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions import text as X


def read_records(spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = False) -> DataFrame:
    """JSON lines, or one document or array per file; anything that does not fit the schema raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", multi_line).json(path)


def strict_json(raw: Column) -> Column:
    """Variant of a JSON text; null if it is not one whole value, repeats a key, or holds NaN or an infinity, spelled out or as a number beyond the doubles."""
    bare = F.regexp_replace(raw, r'"(?:[^"\\]++|\\.)*+"', '""')
    huge = F.exists(F.regexp_extract_all(bare, F.lit(r"(-?[0-9.]+[eE][+-]?[0-9]+|[0-9.]{300,})"), F.lit(1)), lambda n: F.abs(n.try_cast("double")) == float("inf"))
    # the parser stops after a whole value: what follows shows only inside an array with an end of its own
    both = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"end"]')))
    alone = (F.try_variant_get(both, "$[1]", "string") == "end") & F.try_variant_get(both, "$[2]", "variant").isNull()
    return F.when(~bare.rlike(r"NaN|Infinity|\bINF\b") & ~huge & alone, F.try_variant_get(both, "$[0]", "variant"))


# --- CSV with line ends inside quotes, in any number of splits --------------------------------------------------------

#: A line that starts outside quotes and ends inside: whole fields, then one whose quote stays open. A quote opens a field only at its start.
_OPEN = r'(?s)^(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+|),)*+"(?:[^"]++|"")*+$'


def _line_states(lines: DataFrame) -> DataFrame:
    """Adds inside: whether a line starts inside quotes; and line, its number in the file.

    A line is a map from the state it starts in (outside, inside) to the one it ends in; both are told by one look at it (inside: as if a quote stood before it).
    A line whose map is constant sets the state, others keep or flip it. Maps compose, so each block of a file is summed up as one map and a number of lines first, the
    blocks' maps are scanned in order, and then each line is placed within its block.
    """
    ends = lambda c: c.rlike(_OPEN)
    x = lines.withColumn("__out", ends(F.col("value"))).withColumn("__in", ends(F.concat(F.lit('"'), "value")))
    x = x.withColumn("__sets", F.when(F.col("__out") == F.col("__in"), F.col("__out"))).withColumn("__flips", (F.col("__out") & ~F.col("__in")).cast("int"))

    def scanned(df: DataFrame, keys: list[str], order: str, sets: str, flips: str, count: Column | None) -> DataFrame:
        """Before each row: the last value that was set (null: none), flips since then, rows or lines so far."""
        w = Window.partitionBy(*keys).orderBy(order)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("__run", F.count(sets).over(before)).withColumn("__last", F.last(sets, ignorenulls=True).over(before))
        # flips that come after the last row that sets: running flips less those until it
        df = df.withColumn("__total", F.coalesce(F.sum(F.when(F.col(sets).isNull(), F.col(flips)).otherwise(0)).over(before), F.lit(0)))
        until = F.when(F.col(sets).isNotNull(), F.col("__total"))
        df = df.withColumn("__since", F.col("__total") - F.coalesce(F.last(until, ignorenulls=True).over(before), F.lit(0)))
        return df if count is None else df.withColumn("__before", F.coalesce(F.sum(count).over(before), F.lit(0)))

    state = lambda last, since: last.cast("int").bitwiseXOR(since.cast("int") % 2)
    x = scanned(x, ["path", "block"], "seq", "__sets", "__flips", None).withColumn("__line", F.row_number().over(Window.partitionBy("path", "block").orderBy("seq")))
    # a block as one line: what its last line ends in, where any line sets it, else whether all flips together turn it over
    last = F.max_by(F.struct("__sets", "__flips", "__last", "__since"), "seq").alias("l")
    blocks = x.groupBy("path", "block").agg(last, F.count(F.lit(1)).alias("n"), F.count("__sets").alias("k"), F.sum(F.when(F.col("__sets").isNull(), F.col("__flips")).otherwise(0)).alias("f"))
    end = F.coalesce(F.col("l.__sets").cast("int"), state(F.col("l.__last"), F.col("l.__since") + F.col("l.__flips")))
    blocks = blocks.select("path", "block", "n", F.when(F.col("k") > 0, end).alias("__sets"), (F.col("f") % 2).alias("__flips"))
    blocks = scanned(blocks, ["path"], "block", "__sets", "__flips", F.col("n"))
    entry = blocks.select("path", "block", F.col("__before").alias("__offset"), state(F.coalesce("__last", F.lit(0)), F.col("__since")).alias("__entry"))
    x = x.join(entry, ["path", "block"])
    inside = state(F.coalesce(F.col("__last").cast("int"), F.col("__entry")), F.col("__since")) == 1
    return x.select("path", (F.col("__line") + F.col("__offset")).alias("line"), "value", inside.alias("inside"))


def csv_with_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(path, ordinal, line, columns...) of CSV files: ordinal counts records from 2 (the header is 1), line is the
    physical line on which the record ends. A byte-order mark is skipped; a missing or repeated header column and a
    ragged row raise, empty lines are records without a row.

    Files may be split anywhere: lines are read in parallel, whether a line starts inside quotes follows from a scan over the blocks
    of its file, and only records of several lines are put together. Lines end with a line feed, with or without a carriage return before it.
    """
    schema = T.StructType.fromDDL("path string, ordinal long, line long, " + ", ".join(f"`{c}` string" for c in columns))
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    x = _line_states(lines)
    # records are numbered by their starts: by block of lines first, so that no window spans a file
    span = 1 << 16
    x = x.withColumn("__part", F.floor(F.col("line") / span)).withColumn("__start", (~F.col("inside")).cast("long"))
    per = x.groupBy("path", "__part").agg(F.sum("__start").alias("__n"))
    per = per.withColumn("__offset", F.coalesce(F.sum("__n").over(Window.partitionBy("path").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    x = x.join(per, ["path", "__part"]).withColumn("ordinal", F.col("__offset") + F.sum("__start").over(Window.partitionBy("path", "__part").orderBy("line")))
    records = x.groupBy("path", "ordinal").agg(F.max("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "value"))).alias("parts"))
    records = records.select("path", "ordinal", "line", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("record"))
    head = records.where("ordinal = 1").select("path", F.regexp_replace("record", "^\\uFEFF", "").alias("header"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, known = [], {}
            for name, n, line, record, first in zip(*(batch.column(c).to_pylist() for c in ("path", "ordinal", "line", "record", "header")), strict=True):
                if name not in known:
                    header = _fields(first)
                    if len(set(header)) != len(header) or set(columns) - set(header):
                        raise ValueError(f"{name}: header {header}")
                    known[name] = len(header), [header.index(c) for c in columns]
                row = _fields(record) if n > 1 else []
                if row and len(row) != known[name][0]:
                    raise ValueError(f"{name}: line {line} has {len(row)} fields")
                if row:
                    rows.append((name, n, line, *(row[i] for i in known[name][1])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k in (1, 2) else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], names=schema.names)

    return records.join(head, "path").mapInArrow(run, schema)


def _fields(record: str) -> list[str]:
    return next(csv.reader(io.StringIO(record, newline="")), [])


def outcome_violations(outcomes: DataFrame, key: str, leak: str, numbers: list[str]) -> DataFrame:
    """(key, problem): repeated keys, leak other than Y, N or empty, numbers that are not finite and at least 0."""
    outcomes = outcomes.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    checks = [F.when(F.col("__n") > 1, "repeated key"), F.when(~F.coalesce(F.col(leak).isin("Y", "N", ""), F.lit(False)), "leak")]
    for c in numbers:
        v = F.expr(f"try_cast(`{c}` as double)")
        checks.append(F.when((F.col(c) != "") & (v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf"))), c))
    x = outcomes.withColumn("problem", F.explode(F.filter(F.array(*checks), lambda p: p.isNotNull())))
    return x.select(key, "problem")


def outcome(leak: Column) -> Column:
    """Y, N and empty as true, false and null."""
    return F.when(leak == "Y", True).when(leak == "N", False)


def frame_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, case_id, frame_index, t_ms) of files named <case>_frame_<number>.jpeg; gaps in the numbers stay, 1 fps."""
    pattern = r"([A-Za-z0-9]+)_frame_(\d+)\.jpe?g$"
    x = paths.select(path, F.regexp_extract(path, pattern, 1).alias("case_id"), F.regexp_extract(path, pattern, 2).alias("n")).where("n != ''")
    return x.select(path, "case_id", F.col("n").cast("int").alias("frame_index"), ((F.col("n").cast("long") - 1) * 1000).alias("t_ms"))


def release_violations(frames: DataFrame) -> DataFrame:
    """(case_id, problem): numbers of a released case that do not run 1, 2, 3, ... without gap or repeat."""
    x = frames.groupBy("case_id").agg(F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi"), F.count(F.lit(1)).alias("n"), F.count_distinct("frame_index").alias("k"))
    problem = F.when(F.col("lo") != 1, "does not start at 1").when(F.col("n") != F.col("k"), "repeated").when(F.col("hi") != F.col("n"), "gap")
    return x.withColumn("problem", problem).where("problem is not null").select("case_id", "problem")


def label_rows(points: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Points and boxes as one table of normalised geometry: (trial_frame, label, kind, x1, y1, x2, y2, source_table).

    Corners are put in order, divided by the size and clamped to [0, 1]; equal corners are a point; rows with a blank
    label or a corner that is not a number have no geometry but keep their frame (annotated without a finding).
    Repeated rows count once.
    """
    both = points.withColumn("source_table", F.lit("tool_tips")).unionByName(boxes.withColumn("source_table", F.lit("bbox")))

    def number(c: str, size: int) -> Column:
        # least and greatest pass over nulls, and take NaN for large
        v = F.expr(f"try_cast(`{c}` as double)")
        return F.when(v.isNotNull() & ~F.isnan(v), F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / size)))

    x = both.select("trial_frame", "label", "source_table", *[number(c, width if c[0] == "x" else height).alias(c) for c in ("x1", "y1", "x2", "y2")])
    x = x.withColumn("valid", ~X.blank(F.col("label")) & F.forall(F.array("x1", "y1", "x2", "y2"), lambda v: v.isNotNull()))
    low, high = (lambda a, b: F.when(F.col("valid"), F.least(a, b))), (lambda a, b: F.when(F.col("valid"), F.greatest(a, b)))
    out = x.select(
        "trial_frame", F.when(F.col("valid"), F.col("label")).alias("label"), "source_table",
        low("x1", "x2").alias("x1"), low("y1", "y2").alias("y1"), high("x1", "x2").alias("x2"), high("y1", "y2").alias("y2"),
    )
    kind = F.when((F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2")), "point").when(F.col("x1").isNotNull(), "box")
    return out.withColumn("kind", kind).dropDuplicates()


def log_fields(lines: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """First capture of each named pattern in every log line, null where it does not occur."""
    return lines.select("*", *[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).alias(k) for k, p in patterns.items()])
