"""Annotations of evidence packets: view labels, claim rules, captions, citation verdicts, worksheet approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.contracts import VIOLATIONS, all_of, violation


def view_labels(views: DataFrame, packet: str, target: str, frame: str, order: str, role: str) -> DataFrame:
    """Adds view_label: T for the full target view, T1, T2, ... for its crops, B1, ... before and A1, ... after it, in order."""
    side = F.when(F.col(frame) == F.col(target), "T").when(F.col(frame) < F.col(target), "B").otherwise("A")
    x = views.withColumn("__side", side).withColumn("__full", (F.col("__side") == "T") & (F.col(role) == "full"))
    place = F.row_number().over(Window.partitionBy(packet, "__side", "__full").orderBy(frame, order))
    return x.withColumn("view_label", F.when(F.col("__full"), "T").otherwise(F.concat("__side", place.cast("string")))).drop("__side", "__full")


def claim_violations(claims: DataFrame, packets: DataFrame, packet: str) -> DataFrame:
    """Rules of claims (claim_id, category, support, uncertainty, views array<string>) in packets (target_views, context_views,
    frames_of map<view, frame>, poor boolean, questions long): a rule's row for each claim or packet that breaks it.
    """
    x = claims.join(packets, packet)
    v = F.col("views")
    frames = F.array_distinct(F.transform(v, lambda i: F.element_at("frames_of", i)))
    known = F.map_keys("frames_of")
    check = lambda rows, bad, rule, message: violation(rows.where(F.coalesce(bad, F.lit(True))), F.col(packet), rule, F.col("claim_id"), message)
    dupes = claims.groupBy(packet, "claim_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return all_of(
        check(x, F.size(F.array_except(v, known)) > 0, "unknown_view", "cites a view that the packet does not have"),
        check(x, ~F.arrays_overlap(v, F.col("target_views")), "target", "does not cite the target frame"),
        check(x, (F.col("support") == "visible") & (F.size(F.array_except(v, F.col("target_views"))) > 0), "visible", "visible in the target, but cites other frames"),
        check(x, (F.col("category") == "action") & ((F.size(frames) < 2) | ~F.arrays_overlap(v, F.col("context_views"))), "action", "an action needs two frames and context"),
        check(x, (F.col("category") == "step") & (F.coalesce(F.trim("uncertainty"), F.lit("")) == ""), "step", "a step needs its uncertainty"),
        violation(dupes, F.col(packet), "unique_claim", F.col("claim_id"), "claim id is not unique"),
        violation(packets.where("poor and questions = 0"), F.col(packet), "poor_question", F.lit(""), "a poor view needs a question"),
    ).select(*VIOLATIONS)


def captions(claims: DataFrame, packet: str) -> DataFrame:
    """(packet, visible_caption, inferred_caption): statements by support, in the order of claim ids."""
    item = F.struct("claim_id", "support", "statement")
    x = claims.groupBy(packet).agg(F.array_sort(F.collect_list(item)).alias("c"))
    text = lambda support: F.array_join(F.transform(F.filter("c", lambda i: i["support"] == support), lambda i: i["statement"]), " ")
    return x.select(packet, text("visible").alias("visible_caption"), text("inferred").alias("inferred_caption"))


def citation_verdicts(claims: DataFrame, log: DataFrame, now: str, subjects: Column) -> DataFrame:
    """(case_id, claim_id, reasons): why a claim's citations do not hold; empty if they do.

    claims: (case_id, claim_id, cites array<string>, now); log: (case_id, event_id, t_ms, subject, object). Reasons: no_citation,
    unknown, future, and wrong_subject where the claim mentions labels (`subjects`) of which no cited event speaks.
    """
    x = claims.withColumn("__subjects", subjects).withColumn("cite", F.explode_outer("cites"))
    e = log.select("case_id", F.col("event_id").alias("cite"), "t_ms", "subject", "object")
    x = x.join(e, ["case_id", "cite"], "left")
    ok = F.col("t_ms").isNotNull() & (F.col("t_ms") <= F.col(now))
    reason = F.when(F.col("cite").isNull(), "no_citation").when(F.col("t_ms").isNull(), "unknown").when(F.col("t_ms") > F.col(now), "future")
    about = F.array_contains("__subjects", F.col("subject")) | F.coalesce(F.array_contains("__subjects", F.col("object")), F.lit(False))
    x = x.groupBy("case_id", "claim_id").agg(
        F.array_sort(F.collect_set(reason)).alias("r"), F.coalesce(F.bool_or(ok & about), F.lit(False)).alias("about"), F.coalesce(F.bool_or(ok), F.lit(False)).alias("any"), F.coalesce(F.bool_or(F.size("__subjects") > 0), F.lit(False)).alias("asks")
    )
    wrong = F.when(F.col("any") & F.col("asks") & ~F.col("about"), F.array(F.lit("wrong_subject"))).otherwise(F.lit([]).cast("array<string>"))
    return x.select("case_id", "claim_id", F.concat("r", wrong).alias("reasons"))


def approved(notes: DataFrame, curation: DataFrame) -> DataFrame:
    """Notes (review_identity, frame_id, status, needs_recheck, curation_updated_at) that may be exported: reviewed, not to be
    checked again, and made on the curation (review_identity, frame_id, updated_at, deleted) as it now is."""
    c = curation.select("review_identity", "frame_id", "updated_at", "deleted")
    x = notes.join(c, ["review_identity", "frame_id"], "left")
    return x.where((F.col("status") == "reviewed") & ~F.coalesce("needs_recheck", F.lit(False)) & F.col("curation_updated_at").eqNullSafe(F.col("updated_at")) & ~F.coalesce("deleted", F.lit(False))).select(*notes.columns)


def upsert_curation(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new overlay, conflicts): a change applies if it was made on the stored version (`expected` equals updated_at, null for none)."""
    keys = ["review_identity", "frame_id"]
    x = changes.join(current.select(*keys, F.col("updated_at").alias("__stored")), keys, "left")
    good = x.where(F.col("expected").eqNullSafe(F.col("__stored")))
    new = good.select(*current.columns)
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new), x.where(~F.col("expected").eqNullSafe(F.col("__stored"))).drop("__stored")


def encode_misses(frames: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """Distinct image hashes that the embedding cache lacks for this encoder: what an encoder has to be run on, once each."""
    known = cache.where(F.col("fingerprint") == fingerprint).select("image_sha256")
    return frames.select("image_sha256").distinct().join(known, "image_sha256", "left_anti")


def with_embeddings(frames: DataFrame, cache: DataFrame, fingerprint: str) -> DataFrame:
    """frames with the cached embedding of their image, null where it is still missing."""
    return frames.join(cache.where(F.col("fingerprint") == fingerprint).select("image_sha256", "embedding"), "image_sha256", "left")
