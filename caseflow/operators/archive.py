"""Archive records as relations: label joins, exact outcomes, availability, rounds of review, arithmetic and split contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import text as X
from caseflow.operators import graph as G

# --- labels and outcomes ------------------------------------------------------------------------------------------


def mapped(rows: DataFrame, raw: str, names: dict[str, str], out: str = "label") -> DataFrame:
    """rows with the name of each raw label, stripped of white space and lower-cased; null where it is unknown."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return rows.withColumn(out, F.element_at(table, F.lower(X.strip(F.col(raw)))))


def label_counters(rows: DataFrame, group: list[str], label: str, valid: Column) -> DataFrame:
    """(group, known, unknown, invalid): rows by whether the label is known; invalid ones count as nothing else."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.groupBy(*group).agg(
        F.count_if(ok & F.col(label).isNotNull()).alias("known"), F.count_if(ok & F.col(label).isNull()).alias("unknown"), F.count_if(~ok).alias("invalid")
    )


def not_exactly_one(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """(left key, n): keys of left that have no row or several rows in right."""
    n = right.groupBy(F.col(right_key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    x = left.select(left_key).join(n, F.col(left_key) == F.col("__k"), "left")
    return x.select(left_key, F.coalesce("__n", F.lit(0)).cast("long").alias("n")).where("n != 1")


def availability(frames: DataFrame, labels: DataFrame | None, key: str, label: str) -> DataFrame:
    """(key, status, reason): whether a frame has a label that isn't blank, and why not. No row is no negative label."""
    if labels is None:
        return frames.select(key, F.lit("unavailable").alias("status"), F.lit("table_unavailable").alias("reason"))
    by = labels.groupBy(key).agg(F.bool_or(~X.blank(F.col(label))).alias("given"))
    x = frames.select(key).join(by, key, "left")
    reason = F.when(F.col("given"), F.lit(None)).when(F.col("given").isNull(), "no_matching_source_rows").otherwise("blank_placeholder_rows")
    return x.select(key, F.when(F.col("given"), "provided").otherwise("unavailable").alias("status"), reason.alias("reason"))


def best_region(items: DataFrame, keys: list[str], preferred: Column, x0: str, y0: str, x1: str, y1: str, tie: list[str]) -> DataFrame:
    """One row of each key: a preferred box if there is one, of these the one of the largest area; boxes without area never count."""
    w, h = F.col(x1) - F.col(x0), F.col(y1) - F.col(y0)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(preferred), F.desc(w * h), *tie))
    return items.where((w > 0) & (h > 0)).withColumn("__place", place).where("__place = 1").drop("__place")


def bounding_box(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, x0, y0, x1, y1) of keys with two points at least."""
    box = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys)
    box = box.agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"), F.count(F.lit(1)).alias("__n"))
    return box.where("__n >= 2").drop("__n")


# --- selection helpers ------------------------------------------------------------------------------------------------


def hash_shuffle(rows: DataFrame, case: str, item: str, chronological: list[str], prefix: str) -> DataFrame:
    """Adds salt and position: items of a case by sha256 of prefix, case, salt and item, repeated items by that of their place too.

    The salt is the first, from 0, whose order is neither the chronological one nor its reverse; cases of fewer than three items
    have no such order and keep salt 0. Each round looks at the cases that are still open, of three different items one in
    three, and is checkpointed, so that no round computes those before it again.
    """
    at = F.row_number().over(Window.partitionBy(case).orderBy(*chronological))
    rest, salt, out = rows.withColumn("__at", at).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(case))), 0, None
    while True:
        of = lambda *more: F.sha2(F.concat_ws(":", F.lit(prefix), F.col(case).cast("string"), F.lit(str(salt)), F.col(item).cast("string"), *more), 256)  # noqa: B023, E731
        x = rest.withColumn("salt", F.lit(salt)).withColumn("position", F.row_number().over(Window.partitionBy(case).orderBy(of(), of(F.col("__at").cast("string")))))
        forth = F.count_if(F.col("position") == F.col("__at")).over(Window.partitionBy(case))
        back = F.count_if(F.col("position") + F.col("__at") == F.col("__n") + 1).over(Window.partitionBy(case))
        x = G.cut_lineage(x.withColumn("__open", (F.col("__n") > 2) & ((forth == F.col("__n")) | (back == F.col("__n")))))
        done = x.where("not __open")
        out = done if out is None else out.unionByName(done)
        rest = x.where("__open").drop("salt", "position", "__open")
        salt += 1
        if rest.isEmpty():
            return out.drop("__at", "__n", "__open")


def stratified(frames: DataFrame, case: str, index: str, item: str, count: int, seed: str) -> DataFrame:
    """(case, k, item): one item of each of `count` consecutive slices [k n / count, (k + 1) n / count), by a hash of seed, k and item.

    index counts from 0. A slice without frames, where n < count, has no row.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(case))
    # slice k holds index i exactly if floor(k n / count) <= i < floor((k + 1) n / count)
    k = F.floor((F.col(index) * count + count - 1) / F.col("__n")).cast("long")
    x = frames.withColumn("__n", n).withColumn("k", k)
    x = x.withColumn("k", F.when(F.floor(F.col("k") * F.col("__n") / count) > F.col(index), F.col("k") - 1).otherwise(F.col("k")))
    rank = F.sha2(F.concat_ws(":", F.lit(seed), F.col("k").cast("string"), F.col(item).cast("string")), 256)
    return x.groupBy(case, "k").agg(F.min_by(item, rank).alias(item))


def stride(rows: DataFrame, keys: list[str], order: list[str], step: int) -> DataFrame:
    """Every step-th row of each key, the first included."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("__at", at).where(F.col("__at") % step == 0).drop("__at")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by a total order; a partial maximum by key, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


# --- rounds and references --------------------------------------------------------------------------------------------


def progress(rows: DataFrame, case: str, round_: str, item: str) -> DataFrame:
    """(case, round, new, so_far): distinct items that a round brings first, and all until then; every round has a row."""
    first = rows.where(F.col(item).isNotNull()).groupBy(case, item).agg(F.min(round_).alias(round_))
    new = first.groupBy(case, round_).agg(F.count(F.lit(1)).alias("new"))
    x = rows.select(case, round_).distinct().join(new, [case, round_], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return x.withColumn("so_far", F.sum("new").over(Window.partitionBy(case).orderBy(round_)))


def undecided(introduced: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): items introduced without a decision, and decisions about items that were not introduced."""
    a, b = introduced.select(*keys).distinct(), decided.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("problem", F.lit("undecided")).union(b.join(a, keys, "left_anti").withColumn("problem", F.lit("not_introduced")))


def wide_moments(rows: DataFrame, keys: list[str], t: str, most: float) -> DataFrame:
    """(keys, span) of groups whose members lie further apart than `most`."""
    return rows.groupBy(*keys).agg((F.max(t) - F.min(t)).alias("span")).where(F.col("span") > most)


def outside_request(rows: DataFrame, t: str, start: str, end: str) -> DataFrame:
    """Rows whose time is not inside their own request, ends included; an unknown time or end is outside."""
    return rows.where(~F.coalesce(F.col(t).between(F.col(start), F.col(end)), F.lit(False)))


# --- contracts --------------------------------------------------------------------------------------------------------


def arithmetic(rows: DataFrame, key: str, observed: Column, expected: Column, difference: Column, tolerance: float) -> DataFrame:
    """(key, off): rows whose difference is not observed - expected, within the tolerance; unknown numbers are violations with a null."""
    off = difference - (observed - expected)
    return rows.select(key, off.alias("off")).where(F.col("off").isNull() | (F.abs("off") > tolerance))


def measurement_bounds(rows: DataFrame, key: list[str], unit: Column, value: Column, denominator: Column) -> DataFrame:
    """(key, rule_id): fractions without denominator or outside [0, 1], counts that are no whole numbers."""
    fraction = (unit == "fraction") & (denominator.isNull() | value.isNull() | ~value.between(0, 1))
    count = (unit == "count") & (value.isNull() | (value != F.floor(value)))
    return rows.withColumn("rule_id", F.when(fraction, "fraction").when(count, "count")).where("rule_id is not null").select(*key, "rule_id")


def split_disagreement(rows: DataFrame, group: str, partition: str, manifest: DataFrame) -> DataFrame:
    """(group, partition, assigned) of rows whose partition differs from the manifest's (group, assigned), or whose group it lacks; partition `unassigned` needs none.

    Where both have a column `strategy`, the manifest has to group as the row says.
    """
    how = [c for c in ("strategy",) if c in rows.columns and c in manifest.columns]
    x = rows.where(~F.col(partition).eqNullSafe(F.lit("unassigned"))).select(group, partition, *how).distinct()
    x = x.join(manifest.withColumnsRenamed({c: f"__{c}" for c in how}), group, "left")
    wrong = ~F.col(partition).eqNullSafe(F.col("assigned"))
    for c in how:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return x.where(wrong).select(group, partition, "assigned")


def mixed(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, n): columns that have several values in one export."""
    many = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"__{c}").alias("n")) for c in columns])
    x = rows.groupBy(*keys).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"__{c}") for c in columns])
    return x.select(*keys, F.explode(many).alias("m")).select(*keys, "m.*").where("n > 1")


def rows_differ(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, same): whether rows of one key agree in all columns, nulls included."""
    other = right.select(F.col(key).alias("__k"), F.struct(*columns).alias("__r"))
    return left.join(other, F.col(key) == F.col("__k")).select(key, F.struct(*columns).eqNullSafe(F.col("__r")).alias("same"))


# --- columns ----------------------------------------------------------------------------------------------------------


def humanized(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def slug(text: Column, most: int = 80) -> Column:
    """Runs of anything but letters, digits, dot, dash and underscore become one dash; dots, dashes and underscores go from the ends; then it is cut. `record` where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), r"^[._-]+|[._-]+\z", "")
    return F.coalesce(F.nullif(F.substring(bare, 1, most), F.lit("")), F.lit("record"))


def filled(template: str, values: dict[str, Column]) -> Column:
    """The template with {name} replaced by its value as it is, by `unknown` where there is none or it is null, and its first letter large.

    Values are not looked into: braces in them stay.
    """
    first, *parts = template.split("{")
    pieces = [F.lit(first)]
    for part in parts:
        name, _, rest = part.partition("}")
        pieces += [F.coalesce(values[name].cast("string"), F.lit("unknown")) if name in values else F.lit("unknown"), F.lit(rest)]
    out = F.concat(*pieces)
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30))


def crops(width: Column, height: Column) -> Column:
    """Up to four overlapping windows of three fifths of width and height, rounded up, as structs; none that is the whole picture."""
    w, h = F.floor((3 * width + 4) / 5).cast("int"), F.floor((3 * height + 4) / 5).cast("int")
    w, h = F.least(width, w), F.least(height, h)
    box = lambda x, y: F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))
    zero = F.lit(0)
    every = F.array_distinct(F.array(box(zero, zero), box(width - w, zero), box(zero, height - h), box(width - w, height - h)))
    return F.filter(every, lambda b: ~((b["x0"] == 0) & (b["y0"] == 0) & (b["x1"] == width) & (b["y1"] == height)))


def status(protected: Column, decision: Column, candidate: Column) -> Column:
    """A frame's state: selected if protected or kept, dropped if a decision says so, else candidate or source."""
    return F.when(protected | (decision == "keep"), "selected").when(decision == "drop", "dropped").when(candidate, "candidate").otherwise("source")


def inventory_hash(rows: DataFrame, keys: list[str], entry: list[str]) -> DataFrame:
    """(keys, n, sha256) of each key's entries in order: entries are joined by colons, lines by line ends.

    A key's inventory is one row's array: for lists that fit into a row.
    """
    lines = F.array_sort(F.collect_list(F.concat_ws(":", *[F.col(c).cast("string") for c in entry])))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"))
