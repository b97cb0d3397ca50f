"""Metrics as aggregations: set F0.5 for each entity, ranking, classification, regression and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BETA2 = 0.25


def f_half(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of one set: both empty 1, nothing shared 0."""
    p, r = tp / n_pred, tp / n_true
    return F.when((n_pred == 0) & (n_true == 0), 1.0).when(tp == 0, 0.0).otherwise((1 + BETA2) * p * r / (BETA2 * p + r))


def per_entity(chosen: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """``q, tp, n_pred, n_true`` for every entity of ``queries``."""
    pred = chosen.select("q", "c").distinct()
    counts = pred.groupBy("q").agg(F.count(F.lit(1)).alias("n_pred"))
    true = truth.groupBy("q").agg(F.count(F.lit(1)).alias("n_true"))
    hits = pred.join(truth.select("q", "c"), ["q", "c"]).groupBy("q").agg(F.count(F.lit(1)).alias("tp"))
    return queries.select("q").join(counts, "q", "left").join(true, "q", "left").join(hits, "q", "left").fillna(0)


def macro_f_half(chosen: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    return per_entity(chosen, truth, queries).agg(F.round(F.avg(f_half(F.col("tp"), F.col("n_pred"), F.col("n_true"))), 6).alias("macro_f05"))


def report(chosen: DataFrame, candidates: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: micro and macro quality, singletons, blocking recall, ceiling, efficiency and the limiting stage."""
    own = per_entity(chosen, truth, queries).alias("o")
    cand = per_entity(candidates, truth, queries).select("q", F.col("tp").alias("ctp"), F.col("n_pred").alias("n_cand"))
    t, p, n = F.col("tp"), F.col("n_pred"), F.col("n_true")
    single = (n == 0).cast("int")
    out = own.join(cand, "q").agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum("tp").alias("tp"),
        (F.sum("n_pred") - F.sum("tp")).alias("fp"),
        (F.sum("n_true") - F.sum("tp")).alias("fn"),
        F.round(F.coalesce(F.try_divide(F.sum("tp"), F.sum("n_pred")), F.lit(0.0)), 6).alias("micro_precision"),
        F.round(F.coalesce(F.try_divide(F.sum("tp"), F.sum("n_true")), F.lit(0.0)), 6).alias("micro_recall"),
        F.round(F.avg(f_half(t, p, n)), 6).alias("macro_f05"),
        F.sum(single).alias("singletons"),
        F.round(F.avg((p == 0).cast("double")), 6).alias("left_empty"),
        F.sum(F.when((n == 0) & (p > 0), 1).otherwise(0)).alias("singletons_hit"),
        F.round(F.coalesce(F.try_divide(F.sum("ctp"), F.sum("n_true")), F.lit(0.0)), 6).alias("blocking_recall"),
        F.round(F.avg(f_half(F.col("ctp"), F.col("ctp"), n)), 6).alias("ceiling"),
    )
    return out.withColumn("efficiency", F.round(F.col("macro_f05") / F.col("ceiling"), 6)).withColumn("limiting_stage", F.when(1 - F.col("ceiling") > F.col("ceiling") - F.col("macro_f05"), "blocking").otherwise("matching"))


def threshold_sweep(scored: DataFrame, thresholds: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """``th, macro_f05, n_pred`` for each threshold (column th; a few numbers, which come to the driver).

    Pairs are counted once, by entity and the highest threshold they reach. An entity's counts at a threshold are
    sums over its bins from there up, taken within its one row, so that no pair is copied per threshold.
    """
    ths = sorted({r["th"] for r in thresholds.select("th").collect()})
    bins = sum((F.when(F.col("p") >= th, 1).otherwise(0) for th in ths), F.lit(0))
    labelled = scored.join(truth.select("q", "c", F.lit(1).alias("y")), ["q", "c"], "left").withColumn("bin", bins).where("bin > 0")
    counts = labelled.groupBy("q").agg(*(F.sum(F.when(F.col("bin") > i, n).otherwise(0)).alias(f"{name}{i}") for i in range(len(ths)) for name, n in (("n", F.lit(1)), ("t", F.when(F.col("y").isNotNull(), 1).otherwise(0)))))
    true = truth.groupBy("q").agg(F.count(F.lit(1)).alias("n_true"))
    full = queries.select("q").join(true, "q", "left").join(counts, "q", "left").fillna(0)
    each = full.agg(*(x for i in range(len(ths)) for x in (F.avg(f_half(F.col(f"t{i}"), F.col(f"n{i}"), F.col("n_true"))).alias(f"f{i}"), F.sum(f"n{i}").alias(f"s{i}"))))
    return each.select(F.explode(F.array(*(F.struct(F.lit(th).alias("th"), F.round(f"f{i}", 6).alias("macro_f05"), F.col(f"s{i}").alias("n_pred")) for i, th in enumerate(ths)))).alias("x")).select("x.*")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first of the best."""
    return sweep.agg(F.max_by("th", F.struct("macro_f05", -F.col("th"))).alias("th"), F.max("macro_f05").alias("macro_f05"))


def f_half_value(tp: float, n_pred: float, n_true: float) -> float:
    if n_pred == 0 and n_true == 0:
        return 1.0
    return 0.0 if tp == 0 else (1 + BETA2) * (tp / n_pred) * (tp / n_true) / (BETA2 * tp / n_pred + tp / n_true)


def break_even(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """The confidence from which one more prediction raises expected F0.5: loss over gain plus loss."""
    now = f_half(tp, n_pred, n_true)
    gain = f_half(tp + 1, n_pred + 1, n_true) - now
    loss = now - f_half(tp, n_pred + 1, n_true)
    return F.when(gain + loss > 0, loss / (gain + loss)).otherwise(1.0)


def _running(scored: DataFrame, score: str, label: str, by: tuple[str, ...], ascending: bool) -> DataFrame:
    """``by..., n, pos`` of each distinct score and ``n_before, pos_before`` of all scores before it.

    Scores are counted by value first; running sums then go over steps of 1/1024 (as many rows as steps) and,
    within each step, over its own values, so that no task gets all values.
    """
    values = scored.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos")).withColumn("_step", F.floor(F.col(score) * 1024))
    way = (lambda c: F.col(c)) if ascending else (lambda c: F.col(c).desc())
    whole = Window.partitionBy(*by).orderBy(way("_step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = values.groupBy(*by, "_step").agg(F.sum("n").alias("sn"), F.sum("pos").alias("sp"))
    zero = F.lit(0)
    steps = steps.select(*by, "_step", F.coalesce(F.sum("sn").over(whole), zero).alias("sn"), F.coalesce(F.sum("sp").over(whole), zero).alias("sp"))
    inner = Window.partitionBy(*by, "_step").orderBy(way(score)).rowsBetween(Window.unboundedPreceding, -1)
    own = values.withColumn("_n", F.coalesce(F.sum("n").over(inner), zero)).withColumn("_p", F.coalesce(F.sum("pos").over(inner), zero))
    return own.join(steps, [*by, "_step"]).select(*by, "n", "pos", (F.col("_n") + F.col("sn")).alias("n_before"), (F.col("_p") + F.col("sp")).alias("pos_before"))


def auc(scored: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rank AUC with tied scores at their average rank."""
    ranked = _running(scored, score, label, by, True).withColumn("_r", F.col("n_before") + (F.col("n") + 1) / 2)
    made = ranked.groupBy(*by).agg(F.sum("pos").alias("n1"), (F.sum("n") - F.sum("pos")).alias("n0"), F.sum(F.col("_r") * F.col("pos")).alias("s"))
    return made.select(*by, F.round(F.try_divide(F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1").cast("double") * F.col("n0")), 6).alias("auc"))


def average_precision(scored: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over true rows of the precision at their score."""
    at = _running(scored, score, label, by, False)
    precision = (F.col("pos_before") + F.col("pos")) / (F.col("n_before") + F.col("n"))
    return at.groupBy(*by).agg(F.round(F.try_divide(F.sum(precision * F.col("pos")), F.sum("pos")), 6).alias("average_precision"))


def loss_decomposition(chosen: DataFrame, candidates: DataFrame, truth: DataFrame, queries: DataFrame) -> DataFrame:
    """What F0.5 loses to blocking, to rejected true candidates and to false positives, by counterfactuals."""
    own = per_entity(chosen, truth, queries)
    cand = per_entity(candidates, truth, queries).select("q", F.col("tp").alias("ctp"))
    t, p, n, c = F.col("tp"), F.col("n_pred"), F.col("n_true"), F.col("ctp")
    made = own.join(cand, "q").agg(F.avg(f_half(t, p, n)).alias("now"), F.avg(f_half(t, t, n)).alias("pure"), F.avg(f_half(c, c, n)).alias("ceiling"))
    return made.select(F.round(1 - F.col("ceiling"), 6).alias("blocking_miss"), F.round(F.col("ceiling") - F.col("pure"), 6).alias("matcher_reject"), F.round(F.col("pure") - F.col("now"), 6).alias("false_positive"))


def calibration(scored: DataFrame, truth: DataFrame, width: float = 0.1) -> DataFrame:
    """``band, n, share_true``."""
    labelled = scored.join(truth.select("q", "c", F.lit(1).alias("y")), ["q", "c"], "left")
    band = F.least(F.floor(F.col("p") / width), F.lit(int(1 / width) - 1)).cast("int")
    return labelled.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count("y") / F.count(F.lit(1)), 6).alias("share_true"))


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    """rmse, mae, rmsle, mape, smape, r2 and the capped score; mape over rows with |y| > 1e-9, null if there is none."""
    a, e = F.col(y).cast("double"), F.col(p).cast("double")
    log = F.log1p(F.greatest(e, F.lit(0.0))) - F.log1p(a)
    size = F.abs(a) + F.abs(e)
    mape = F.avg(F.when(F.abs(a) > 1e-9, F.abs((a - e) / a))) * 100
    return df.agg(
        F.round(F.sqrt(F.avg((a - e) * (a - e))), 6).alias("rmse"),
        F.round(F.avg(F.abs(a - e)), 6).alias("mae"),
        F.round(F.sqrt(F.avg(log * log)), 6).alias("rmsle"),
        F.round(mape, 6).alias("mape"),
        F.round(F.avg(F.when(size > 0, 2 * F.abs(a - e) / size).otherwise(0.0)) * 100, 6).alias("smape"),
        F.round(1 - F.sum((a - e) * (a - e)) / (F.var_pop(a) * F.count(a)), 6).alias("r2"),
        F.round(F.greatest(F.lit(0.0), 100 - mape), 6).alias("capped_score"),
    )


def classification(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy and macro, micro and weighted F1 of class labels, from one confusion table; a class never met scores 0."""
    pairs = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    sides = pairs.select(F.col("y").alias("k"), hit.alias("tp"), F.col("n").alias("true"), F.lit(0).alias("pred")).unionAll(pairs.select(F.col("p").alias("k"), F.lit(0).alias("tp"), F.lit(0).alias("true"), F.col("n").alias("pred")))
    each = sides.groupBy("k").agg(F.sum("tp").alias("tp"), F.sum("true").alias("true"), F.sum("pred").alias("pred"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("true") + F.col("pred")), F.lit(0.0))
    micro = F.sum("tp") / F.sum("true")
    return each.agg(F.round(micro, 6).alias("accuracy"), F.round(F.avg(f1), 6).alias("f1_macro"), F.round(micro, 6).alias("f1_micro"), F.round(F.sum(f1 * F.col("true")) / F.sum("true"), 6).alias("f1_weighted"))


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return df.agg(F.round(-F.avg(F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q))), 6).alias("log_loss"))


def extraction(df: DataFrame, y: str, p: str) -> DataFrame:
    """Extraction counts and F1 of trimmed strings: a wrong value that isn't empty counts as false positive only."""
    a, e = F.trim(F.coalesce(F.col(y), F.lit(""))), F.trim(F.coalesce(F.col(p), F.lit("")))
    count = lambda test: F.sum(test.cast("int")).cast("long")
    made = df.agg(count((e != "") & (a == e)).alias("tp"), count((e != "") & (a != e)).alias("fp"), count((e == "") & (a != "")).alias("fn"), count((e == "") & (a == "")).alias("tn"))
    return made.withColumn("f1", F.round(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6))


def mean_average_precision(predicted: DataFrame, actual: DataFrame, k: int = 10) -> DataFrame:
    """MAP@k of ranked lists: ``predicted`` has q, rank (from 1), item; ``actual`` has q, item.

    A repeated item counts where it is first; an entity without actual items counts 0.
    """
    first = predicted.where(F.col("rank") <= k).groupBy("q", "item").agg(F.min("rank").alias("rank"))
    hits = first.join(actual.distinct(), ["q", "item"])
    n = F.row_number().over(Window.partitionBy("q").orderBy("rank"))
    sums = hits.select("q", (n / F.col("rank")).alias("x")).groupBy("q").agg(F.sum("x").alias("s"))
    sizes = actual.distinct().groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(sums, "q", "left").agg(F.round(F.avg(F.coalesce("s", F.lit(0.0)) / F.least("n", F.lit(k))), 6).alias("map_at_k"))


#: name: (frame of one row from (df, y, p), the column to read, whether more is better)
METRICS = {
    **{n: (regression, n, up) for n, up in (("rmse", False), ("mae", False), ("rmsle", False), ("mape", False), ("smape", False), ("r2", True), ("capped_score", True))},
    **{n: (classification, n, True) for n in ("accuracy", "f1_macro", "f1_micro", "f1_weighted")},
    "log_loss": (log_loss, "log_loss", False),
    "auc": (lambda df, y, p: auc(df, p, y), "auc", True),
    "average_precision": (lambda df, y, p: average_precision(df, p, y), "average_precision", True),
    "extraction_f1": (extraction, "f1", True),
}


def score(name: str, df: DataFrame, y: str, p: str) -> float:
    """The named metric as a number; KeyError for a name that isn't known."""
    build, column, _ = METRICS[name]
    return build(df, y, p).first()[column]
