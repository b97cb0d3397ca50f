"""Decision rules on scored pairs (q, c, p) and set-level corrections of what they choose."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flat(scored: DataFrame, threshold: float = 0.67) -> DataFrame:
    return scored.where(F.col("p") >= threshold)


def rescue(scored: DataFrame, threshold: float, least: float) -> DataFrame:
    """Pairs over the threshold; where an entity has none, its best if that reaches ``least``."""
    w = Window.partitionBy("q")
    best, rn = F.max("p").over(w), F.row_number().over(w.orderBy(F.desc("p"), "c"))
    out = scored.withColumn("_b", best).withColumn("_r", rn)
    return out.where((F.col("p") >= threshold) | ((F.col("_r") == 1) & (F.col("_b") < threshold) & (F.col("_b") >= least))).drop("_b", "_r")


def rank_aware(scored: DataFrame, base: float, step: float) -> DataFrame:
    """The j-th best (from 0) must reach base + j * step, at most .999; the first that fails ends the list.

    Bounds are taken to nine places, so that a score equal to one reaches it.
    """
    rn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("p"), "c"))
    ranked = scored.withColumn("_r", rn).withColumn("_ok", (F.col("p") >= F.least(F.round(F.lit(base) + (F.col("_r") - 1) * step, 9), F.lit(0.999))).cast("int"))
    held = F.min("_ok").over(Window.partitionBy("q").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("_h", held).where("_h = 1").drop("_r", "_ok", "_h")


def exclusive(scored: DataFrame) -> DataFrame:
    """Each record goes to its best-scoring entity; of equals to the least."""
    rn = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("p"), "q"))
    return scored.withColumn("_r", rn).where("_r = 1").drop("_r")


def contested(chosen: DataFrame) -> DataFrame:
    """``c, n_claims`` of records that more than one entity claims."""
    return chosen.groupBy("c").agg(F.count(F.lit(1)).alias("n_claims")).where("n_claims > 1")


def resolve_conflicts(claims: DataFrame) -> DataFrame:
    """One claim (q, c, score or null, containment) for each record.

    A claim without a score was sure enough not to need one and wins; among those the largest containment, among
    scored ones the largest score; of equals the greatest q.
    """
    order = Window.partitionBy("c").orderBy(F.col("score").isNull().desc(), F.coalesce("score", "containment").desc(), F.col("q").desc())
    return claims.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def blend(scored: DataFrame, low: float = 0.05, high: float = 0.95, weight: float = 0.6) -> DataFrame:
    """Within the band the second score ``ce`` is mixed in (p = w * ce + (1 - w) * p); elsewhere p stays."""
    band = (F.col("p") >= low) & (F.col("p") < high) & F.col("ce").isNotNull()
    return scored.withColumn("p", F.when(band, weight * F.col("ce") + (1 - weight) * F.col("p")).otherwise(F.col("p")))


def splice(entities: DataFrame, fresh: DataFrame, fallback: DataFrame) -> DataFrame:
    """``q, ids``: fresh lists where an entity was scored anew (an empty list too), else those of the fallback.

    ``fresh``: q, ids for every entity scored again; an entity that now has no match has an empty string there.
    """
    new = fresh.select("q", F.col("ids").alias("_new"))
    old = fallback.select("q", F.col("ids").alias("_old"))
    return entities.select("q").join(new, "q", "left").join(old, "q", "left").select("q", F.coalesce("_new", "_old", F.lit("")).alias("ids"))


def submission(entities: DataFrame, chosen: DataFrame) -> DataFrame:
    """``source1_entity_id, matched_entity_ids`` with a row for every entity, ids sorted and comma-joined."""
    lists = chosen.groupBy("q").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("ids"))
    return entities.select("q").join(lists, "q", "left").select(F.col("q").alias("source1_entity_id"), F.coalesce("ids", F.lit("")).alias("matched_entity_ids"))


def submission_faults(rows: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """``fault, n``: missing and repeated entities, ids of a wrong source, unknown and repeated ids."""
    long = rows.select(F.col("source1_entity_id").alias("q"), F.explode(F.filter(F.split("matched_entity_ids", ","), lambda x: x != "")).alias("c"))
    count = lambda df, name: df.agg(F.lit(name).alias("fault"), F.count(F.lit(1)).alias("n"))
    return (
        count(entities.select("q").join(rows.select(F.col("source1_entity_id").alias("q")), "q", "left_anti"), "missing entity")
        .union(count(rows.groupBy("source1_entity_id").count().where("count > 1"), "repeated entity"))
        .union(count(long.where(~F.col("c").rlike("^S[23]-")), "wrong source"))
        .union(count(long.join(records.select(F.col("entity_id").alias("c")), "c", "left_anti"), "unknown id"))
        .union(count(long.groupBy("q", "c").count().where("count > 1"), "repeated id"))
    )


def prune(scored: DataFrame, k: int) -> DataFrame:
    """The best ``k`` candidates of each entity."""
    rn = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("p"), "c"))
    return scored.withColumn("_r", rn).where(F.col("_r") <= k).drop("_r")
