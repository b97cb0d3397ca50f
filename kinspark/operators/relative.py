"""Features of a candidate among all candidates of its entity: window functions over one partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.functions import similarity as sim

BASE = ("addr_idf_overlap", "name_jw", "addr_jac3", "name_jac3", "num_jac")
KEY = "addr_idf_overlap"
ANCHORS = 4


def relative_features(pairs: DataFrame, base: tuple[str, ...] = BASE, key: str = KEY) -> DataFrame:
    """Adds, over each entity's whole candidate set, rank, gap, share and z of each column in ``base``, and counts by ``key``.

    All windows have one partitioning (a single shuffle); those without order share one pass, each rank has its
    own sort. Ties go to the lesser candidate.
    """
    w = Window.partitionBy("q")
    n = F.count(F.lit(1)).over(w)
    out = pairs
    made = {}
    for v in base:
        best, mean, spread = F.max(v).over(w), F.avg(v).over(w), F.stddev_pop(v).over(w)
        made[f"{v}_rank"] = (F.row_number().over(w.orderBy(F.desc(v), "c")) - 1) / F.greatest(n - 1, F.lit(1))
        made[f"{v}_gap_best"] = best - F.col(v)
        made[f"{v}_over_best"] = F.when(best > 0, F.col(v) / best).otherwise(0.0)
        made[f"{v}_z"] = F.when(spread > 1e-6, (F.col(v) - mean) / spread).otherwise(0.0)
    strong = F.sum((F.col(key) >= 0.9).cast("int")).over(w)
    made |= {
        "n_cands": n.cast("double"),
        "n_strong": F.sum((F.col(key) > 0.5).cast("int")).over(w).cast("double"),
        "best_overall": F.max(key).over(w),
        "mean_overall": F.avg(key).over(w),
        "is_argmax": (F.row_number().over(w.orderBy(F.desc(key), "c")) == 1).cast("double"),
        "addr_strong_n": strong.cast("double"),
        "addr_strong_sole": ((F.col(key) >= 0.9) & (strong == 1)).cast("double"),
    }
    return out.select("*", *(c.alias(name) for name, c in made.items()))


def cross_source(pairs: DataFrame, records: DataFrame, key: str = KEY, anchors: int = ANCHORS, default: float = 8.0) -> DataFrame:
    """``q, c, cross_addr, cross_name``: best agreement with the other source's candidates among the entity's few best.

    ``pairs``: q, c, source and ``key``; ``records``: entity_id, tn, ta (token arrays) and idf (map). The self-join
    is on q with at most ``anchors`` rows a side, so it grows with the candidates only.
    """
    order = Window.partitionBy("q").orderBy(F.desc(key), "c")
    top = pairs.select("q", "c", "source", F.row_number().over(order).alias("rn")).where(F.col("rn") <= anchors)
    forms = records.select(F.col("entity_id").alias("c"), "tn", "ta", "idf")
    left = pairs.select("q", "c", "source").join(forms, "c")
    right = top.join(forms, "c").select(F.col("q").alias("q2"), F.col("source").alias("s2"), F.col("tn").alias("tn2"), F.col("ta").alias("ta2"), F.col("idf").alias("idf2"))
    idf = (F.col("idf"), F.col("idf2"))
    met = left.join(right, (F.col("q") == F.col("q2")) & (F.col("source") != F.col("s2")), "left")
    zero = F.lit(0.0)
    return met.groupBy("q", "c").agg(
        F.max(F.coalesce(sim.idf_overlap(F.col("ta"), F.col("ta2"), idf, default), zero)).alias("cross_addr"),
        F.max(F.coalesce(sim.idf_overlap(F.col("tn"), F.col("tn2"), idf, default), zero)).alias("cross_name"),
    )


def cross_rank(pairs: DataFrame) -> DataFrame:
    w = Window.partitionBy("q")
    return pairs.withColumn("cross_addr_rank", (F.row_number().over(w.orderBy(F.desc("cross_addr"), "c")) - 1) / F.greatest(F.count(F.lit(1)).over(w) - 1, F.lit(1)))


def stacked_features(scored: DataFrame, p: str = "p") -> DataFrame:
    """Second-level features of out-of-fold scores within each entity."""
    w = Window.partitionBy("q")
    best = F.max(p).over(w)
    return scored.select(
        "*",
        (F.row_number().over(w.orderBy(F.desc(p), "c")) - 1).cast("double").alias("sc_rank"),
        (best - F.col(p)).alias("sc_gap_best"),
        F.when(best > 0, F.col(p) / best).otherwise(0.0).alias("sc_over_best"),
        ((F.col(p) - F.avg(p).over(w)) / (F.stddev_pop(p).over(w) + 1e-6)).alias("sc_z"),
        F.sum((F.col(p) > 0.5).cast("int")).over(w).cast("double").alias("sc_n_conf"),
        best.alias("sc_best"),
    )


def mirror_features(scored: DataFrame, p: str = "p") -> DataFrame:
    """The same seen from the record: rank of the entity among those that claim it, and their number."""
    w = Window.partitionBy("c")
    return scored.select("*", F.row_number().over(w.orderBy(F.desc(p), "q")).alias("claim_rank"), F.count(F.lit(1)).over(w).alias("n_claims"))
