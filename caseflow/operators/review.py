"""Reviewed material as relations: scoring of detections, probe targets, answers and their stored form, output rules, audits, jobs and frozen tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import text as X
from caseflow.operators import graph as G
from caseflow.operators import metrics as M

# --- time -----------------------------------------------------------------------------------------------------------


def pairs(frames: DataFrame, case: str, index: str, fps: float) -> DataFrame:
    """(case, pair, first, last, padded, label) of frames 2k and 2k + 1, counted from 0; a last frame without a partner stands twice.

    The label is the mean of both times to one decimal, halves to even.
    """
    x = frames.groupBy(case, F.floor(F.col(index) / 2).alias("pair")).agg(F.min(index).alias("first"), F.max(index).alias("last"))
    label = F.format_string("<%.1f seconds>", F.bround((F.col("first") + F.col("last")) / F.lit(2.0 * fps), 1))
    return x.select(case, "pair", "first", "last", (F.col("first") == F.col("last")).alias("padded"), label.alias("label"))


def extent(frames: DataFrame, case: str, order: str, pts: str, duration: str) -> DataFrame:
    """(case, extent, basis): first to last time stamp and the last frame's duration: its own if positive, else the interval before it, else 0."""
    x = frames.withColumn("__before", F.lag(pts).over(Window.partitionBy(case).orderBy(order)))
    x = x.groupBy(case).agg(F.max_by(F.struct(F.col(pts).alias("pts"), F.col(duration).alias("own"), F.col("__before").alias("before")), order).alias("l"), F.min_by(pts, order).alias("first"))
    own, before = F.col("l.own"), F.col("l.before")
    basis = F.when(own > 0, "own_duration").when(before.isNotNull(), "previous_interval").otherwise("unknown")
    length = F.when(own > 0, own).otherwise(F.coalesce(F.col("l.pts") - before, F.lit(0)))
    return x.select(case, (F.col("l.pts") - F.col("first") + length).alias("extent"), basis.alias("basis"))


# --- scoring --------------------------------------------------------------------------------------------------------


def macro_f1(rows: DataFrame, keys: list[str], label: str, predicted: Column, actual: Column) -> DataFrame:
    """(keys, classes, f1_macro): mean of the classes' F1, each rounded to four places; classes that are neither predicted nor there don't count.

    The mean is taken of whole ten-thousandths and rounded half up, so it depends neither on order nor on binary fractions.
    """
    x = M.confusion(rows, [*keys, label], predicted, actual)
    f = F.round(20000 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))).cast("long")
    x = x.withColumn("__f1", f).groupBy(*keys).agg(F.count("__f1").alias("classes"), F.sum("__f1").alias("__s"))
    mean = F.floor((2 * F.col("__s") + F.col("classes")) / F.nullif(2 * F.col("classes"), F.lit(0))) / 10000
    return x.select(*keys, "classes", mean.alias("f1_macro"))


def matched_errors(truth: DataFrame, found: DataFrame, on: list[str], keys: list[str], aspect: float) -> DataFrame:
    """(keys, matched, tip_error, mean_iou) of detections of one frame and label; tips (x, y) and boxes (x1, y1, x2, y2) may be null on either side.

    Distances are in heights: x is stretched by the aspect. Without a pair, a mean is null.
    """
    t, g = truth.select(*on, *[k for k in keys if k not in on], F.col("tip").alias("__t"), F.col("box").alias("__b")), found.select(*on, F.col("tip").alias("__gt"), F.col("box").alias("__gb"))
    x = t.join(g, on)
    tip = F.hypot((F.col("__t.x") - F.col("__gt.x")) * aspect, F.col("__t.y") - F.col("__gt.y"))
    box = F.when(F.col("__b").isNotNull() & F.col("__gb").isNotNull(), M.iou(F.col("__b"), F.col("__gb")))
    return x.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"), F.round(F.avg(tip), 4).alias("tip_error"), F.round(F.avg(box), 4).alias("mean_iou"))


def grid(width: Column, height: Column, side: int = 224, patch: int = 14) -> Column:
    """(cols, rows): the shorter side has side / patch cells, the longer one in proportion, halves to even."""
    short = F.lit(side // patch)
    long_ = lambda a, b: F.greatest(F.lit(1), F.bround(short * a / b).cast("int"))
    return F.when(width >= height, F.struct(long_(width, height).alias("cols"), short.alias("rows"))).otherwise(F.struct(short.alias("cols"), long_(height, width).alias("rows")))


def box_cells(rows: DataFrame, keys: list[str], box: Column, cols: int, lines: int) -> DataFrame:
    """(keys, row, col) of the cells whose centre lies in a box of fractions; of a box that holds no centre, the cell of its own centre."""
    x = rows.select(*keys, box.alias("__b"))
    inside = lambda n, lo, hi: F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: ((i + 0.5) / n >= lo) & ((i + 0.5) / n <= hi))
    x = x.withColumn("__c", inside(cols, F.col("__b.x1"), F.col("__b.x2"))).withColumn("__r", inside(lines, F.col("__b.y1"), F.col("__b.y2")))
    at = lambda n, lo, hi: F.least(F.floor((lo + hi) / 2 * n).cast("int"), F.lit(n - 1))
    none = (F.size("__c") == 0) | (F.size("__r") == 0)
    x = x.select(
        *keys,
        F.when(none, F.array(at(cols, F.col("__b.x1"), F.col("__b.x2")))).otherwise(F.col("__c")).alias("__c"),
        F.when(none, F.array(at(lines, F.col("__b.y1"), F.col("__b.y2")))).otherwise(F.col("__r")).alias("__r"),
    )
    return x.select(*keys, "__c", F.explode("__r").alias("row")).select(*keys, "row", F.explode("__c").alias("col"))


# --- answers and their stored form ----------------------------------------------------------------------------------


def stored_claims(claims: DataFrame, answer: str, order: str, cited: str, cap: int) -> DataFrame:
    """claims with claim_id (c1, c2, ... within an answer), cited without repetitions, and flags: what had to be changed, and a full answer."""
    by = Window.partitionBy(answer)
    x = claims.withColumn("claim_id", F.format_string("c%d", F.row_number().over(by.orderBy(order)))).withColumn("__n", F.count(F.lit(1)).over(by))
    flags = F.array_compact(F.array(F.when(F.size(F.array_distinct(cited)) < F.size(cited), "duplicate_citations_removed"), F.when(F.col("__n") == cap, "claim_cap_reached")))
    return x.withColumn("flags", flags).withColumn(cited, F.array_distinct(cited)).drop("__n")


def claim_text(support: Column, category: Column, statement: Column, cited: Column, uncertainty: Column) -> Column:
    """A claim as its reviewer sees it; the last line only if something is uncertain."""
    plain = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    head = F.concat(plain(support), F.lit(" · "), plain(category), F.lit(": "), statement)
    return F.concat_ws("\n", head, F.concat(F.lit("Evidence: "), F.array_join(cited, ", ")), F.when(uncertainty != "", F.concat(F.lit("Uncertainty: "), uncertainty)))


def frame_caption(frame: Column, index: Column, t_ms: Column, basis: Column) -> Column:
    timing = F.when(basis == "unavailable", "acquisition timestamp unavailable").otherwise(F.concat(F.lit("timestamp "), t_ms.cast("string"), F.lit(" ms ("), basis, F.lit(")")))
    return F.concat(frame.cast("string"), F.lit("; released frame index "), index.cast("string"), F.lit("; "), timing, F.lit("."))


def rejected_items(items: DataFrame, run: str, order: str, item: str, uncertain: Column, explanation: str) -> DataFrame:
    """(run, order, rule_id): the first rule that an output's item breaks: invalid_id, duplicate_id (of an earlier one), unexplained."""
    earlier = F.row_number().over(Window.partitionBy(run, item).orderBy(order)) > 1
    rule = F.when(~F.coalesce(F.col(item).rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]*\z"), F.lit(False)), "invalid_id").when(earlier, "duplicate_id")
    rule = rule.when(uncertain & X.blank(F.col(explanation)), "unexplained")
    return items.withColumn("rule_id", rule).where("rule_id is not null").select(run, order, "rule_id")


def claim_collisions(events: DataFrame, questions: DataFrame, run: str, event: str, uncertainty: str, question: str) -> DataFrame:
    """(run, claim_id, n): claim ids that a run would generate more than once: an event's, its uncertainty's, an answer's."""
    ids = events.select(run, F.col(event).alias("claim_id"))
    ids = ids.unionByName(events.where(~X.blank(F.col(uncertainty))).select(run, F.concat(event, F.lit(".uncertainty")).alias("claim_id")))
    ids = ids.unionByName(questions.select(run, F.concat(question, F.lit(".answer")).alias("claim_id")))
    return ids.groupBy(run, "claim_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def rejected_searches(searches: DataFrame, run: str, order: str, text: str, start: str, end: str, low: int, high: int) -> DataFrame:
    """(run, order, rule_id): outside (not low <= start <= end <= high) or duplicate of an earlier text and interval within the bounds."""
    ok = F.coalesce((F.col(start) >= low) & (F.col(start) <= F.col(end)) & (F.col(end) <= high), F.lit(False))
    x = searches.withColumn("__ok", ok)
    again = F.row_number().over(Window.partitionBy(run, X.folded(X.strip(F.col(text))), start, end).orderBy(order)) > 1
    return x.withColumn("rule_id", F.when(~F.col("__ok"), "outside").when(again, "duplicate")).where("rule_id is not null").select(run, order, "rule_id")


# --- audits, jobs, frozen tables ------------------------------------------------------------------------------------


def request_audit(rounds: DataFrame, keys: list[str], start: str, end: str, ready: Column, most: int, span: Column) -> DataFrame:
    """(keys, rule_id): rounds that ask too often, ask although they are ready, or ask for an empty or too long interval; a round may break several."""
    asked = F.col(start).isNotNull()
    x = rounds.groupBy(*keys).agg(
        F.count_if(asked).alias("n"), F.bool_or(ready).alias("ready"), F.count_if(asked & ~F.coalesce(F.col(start) < F.col(end), F.lit(False))).alias("empty"), F.count_if(asked & (F.col(end) - F.col(start) > span)).alias("long")
    )
    rules = F.array_compact(F.array(F.when(F.col("n") > most, "too_many"), F.when(F.col("ready") & (F.col("n") > 0), "ready_and_asking"), F.when(F.col("empty") > 0, "empty_interval"), F.when(F.col("long") > 0, "too_long")))
    return x.select(*keys, F.explode(rules).alias("rule_id"))


def job_state(jobs: DataFrame, attempts: DataFrame, job: str, order: str, status: str) -> DataFrame:
    """(job, state, attempts): done if any attempt was accepted, else what its newest attempt left: failed, interrupted (no status), or pending without one."""
    by = attempts.groupBy(job).agg(F.bool_or(F.col(status) == "accepted").alias("__done"), F.max_by(F.coalesce(F.col(status), F.lit("interrupted")), order).alias("__last"), F.count(F.lit(1)).alias("__n"))
    state = F.when(F.col("__done"), "done").otherwise(F.coalesce("__last", F.lit("pending")))
    return jobs.select(job).distinct().join(by, job, "left").select(job, state.alias("state"), F.coalesce("__n", F.lit(0)).cast("long").alias("attempts"))


def frozen_differences(saved: DataFrame, rebuilt: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, side): rows, as often as they are too many, of a saved table or of the one that is rebuilt from its inputs."""
    n = lambda df, sign: df.select(*columns, F.lit(sign).cast("long").alias("__n"))
    # one pass over both tables: how much oftener one of them has a row
    x = n(saved, 1).unionByName(n(rebuilt, -1)).groupBy(*columns).agg(F.sum("__n").alias("__n")).where("__n != 0")
    side = F.when(F.col("__n") > 0, "saved").otherwise("rebuilt").alias("side")
    return x.select(*columns, side, F.explode(F.sequence(F.lit(1), F.abs("__n"))).alias("__i")).drop("__i")


def overlay(rows: DataFrame, notes: DataFrame, key: str, revision: str, columns: list[str]) -> DataFrame:
    """rows with the columns of the notes on their own revision; notes on another one are stale and don't count."""
    n = notes.select(F.col(key).alias("__k"), F.col(revision).alias("__v"), *columns)
    return rows.join(n, (F.col(key) == F.col("__k")) & (F.col(revision) == F.col("__v")), "left").drop("__k", "__v")


def causal_violations(asked: DataFrame, edges: DataFrame, assets: DataFrame, roles: list[str], annotations: DataFrame | None = None) -> DataFrame:
    """(node, dst, rule_id): inputs, direct or not, of the asked assets (node, cutoff) that they may not have. An asset is an input of its own.

    edges: src is derived from dst. assets: (node, role, frame), one row a frame of the asset; with a column `image`, an image needs a known frame.
    annotations: (node, kind, frame), what an asset was made from besides assets. Rules: role (a forbidden one), future_frame (after the cutoff),
    unknown_frame (an image without), outcome (made from an annotation of that kind), future_annotation (of a frame after the cutoff, or unknown); of a frame or an annotation the first of its rules.
    Only what the asked assets reach is followed.
    """
    start = asked.select("node").distinct()
    pairs = G.reached(start, edges).withColumnsRenamed({"src": "node"}).join(asked.select("node", "cutoff"), "node")
    image = F.coalesce(F.col("image"), F.lit(False)) if "image" in assets.columns else F.lit(False)
    x = pairs.join(assets.withColumn("__image", image).select(F.col("node").alias("dst"), "role", "frame", "__image"), "dst")
    rule = F.when(F.col("role").isin(roles), "role").when(F.col("frame") > F.col("cutoff"), "future_frame").when(F.col("__image") & F.col("frame").isNull(), "unknown_frame")
    found = x.withColumn("rule_id", rule)
    if annotations is not None:
        y = pairs.join(annotations.select(F.col("node").alias("dst"), "kind", F.col("frame").alias("__f")), "dst")
        late = F.coalesce(F.col("__f") > F.col("cutoff"), F.lit(True))
        rule = F.when(F.col("kind") == "outcome", "outcome").when(late, "future_annotation")
        found = found.unionByName(y.withColumn("rule_id", rule), allowMissingColumns=True)
    return found.where("rule_id is not null").select("node", "dst", "rule_id").distinct()
