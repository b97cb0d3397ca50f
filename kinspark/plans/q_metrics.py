"""Queries of metrics and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.operators import decide, metrics, profile
from kinspark.plans import bridge as b
from kinspark.plans.q_blocking import EVERY, GRAMS
from kinspark.plans.q_text import _script

TH = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)


def _queries(spark, d) -> DataFrame:
    return b.entities(spark, d).where("source = 'S1'").select(F.col("entity_id").alias("q"))


def _chosen(spark, d) -> DataFrame:
    return decide.flat(b.scores(spark, d), 0.4)


def er_pipeline_macro_f05(spark, d) -> DataFrame:
    """End to end: normalise, block, score, threshold, one owner a record, macro F0.5."""
    chosen = decide.exclusive(decide.flat(b.scores(spark, d).select("q", "c", "p"), 0.4))
    return metrics.macro_f_half(chosen, b.truth(spark, d), _queries(spark, d))


def er_macro_f05(spark, d) -> DataFrame:
    return metrics.macro_f_half(_chosen(spark, d), b.truth(spark, d), _queries(spark, d))


def er_ceiling(spark, d) -> DataFrame:
    hit = b.pairs(spark, d).select("q", "c").join(b.truth(spark, d), ["q", "c"], "left_semi")
    return metrics.macro_f_half(hit, b.truth(spark, d), _queries(spark, d))


def er_eval_report(spark, d) -> DataFrame:
    return metrics.report(_chosen(spark, d), b.pairs(spark, d).select("q", "c"), b.truth(spark, d), _queries(spark, d))


def _sweep(spark, d) -> DataFrame:
    return metrics.threshold_sweep(b.scores(spark, d).select("q", "c", "p"), spark.createDataFrame([(t,) for t in TH], "th double"), b.truth(spark, d), _queries(spark, d))


def er_threshold_sweep(spark, d) -> DataFrame:
    return _sweep(spark, d)


def er_best_threshold(spark, d) -> DataFrame:
    return metrics.best_threshold(_sweep(spark, d))


def er_break_even(spark, d) -> DataFrame:
    grid = spark.range(0, 5).select(F.col("id").alias("tp")).join(F.broadcast(spark.range(0, 3).select(F.col("id").alias("extra"))), F.lit(True)).join(F.broadcast(spark.range(1, 7).select(F.col("id").alias("n_true"))), F.lit(True))
    rows = grid.select("tp", (F.col("tp") + F.col("extra")).alias("n_pred"), "n_true").where("tp < n_true and n_pred > 0")
    return rows.select("tp", "n_pred", "n_true", F.round(metrics.break_even(F.col("tp"), F.col("n_pred"), F.col("n_true")), 6).alias("confidence"))


def _labelled(spark, d) -> DataFrame:
    return b.scores(spark, d).join(b.truth(spark, d).withColumn("y", F.lit(1)), ["q", "c"], "left").fillna(0, ["y"]).select("q", "c", "source", "p", "y")


def er_labelled_pairs(spark, d) -> DataFrame:
    return _labelled(spark, d).select("q", "c", "y")


def er_auc(spark, d) -> DataFrame:
    return metrics.auc(_labelled(spark, d), "p", "y", ("source",))


def er_average_precision(spark, d) -> DataFrame:
    return metrics.average_precision(_labelled(spark, d), "p", "y", ("source",))


def er_loss_decomposition(spark, d) -> DataFrame:
    return metrics.loss_decomposition(_chosen(spark, d), b.pairs(spark, d).select("q", "c"), b.truth(spark, d), _queries(spark, d))


def er_calibration(spark, d) -> DataFrame:
    return metrics.calibration(b.scores(spark, d).select("q", "c", "p"), b.truth(spark, d))


def _lines(spark, d) -> DataFrame:
    x = b.read(spark, d, "lineitem")
    return x.select(F.col("l_extendedprice").alias("y"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"), "l_returnflag", "l_linestatus", "l_tax", "l_quantity")


def metric_regression(spark, d) -> DataFrame:
    return metrics.regression(_lines(spark, d), "y", "p")


def metric_classification(spark, d) -> DataFrame:
    guess = F.when(F.col("l_tax") > 0.05, "N").when(F.col("l_quantity") > 30, "R").otherwise("A")
    return metrics.classification(_lines(spark, d).withColumn("guess", guess), "l_returnflag", "guess")


def metric_logloss(spark, d) -> DataFrame:
    own = _lines(spark, d).select((F.col("l_linestatus") == "O").cast("int").alias("y"), (F.lit(0.1) + F.col("l_tax") * 8).alias("p"))
    return metrics.log_loss(own, "y", "p")


def metric_extraction_f1(spark, d) -> DataFrame:
    own = b.read(spark, d, "customer").select(F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_mktsegment")).alias("y"), F.when(F.col("c_nationkey") % 5 == 0, "").when(F.col("c_nationkey") % 3 == 0, "BUILDING").otherwise(F.concat(F.lit(" "), "c_mktsegment")).alias("p"))
    return metrics.extraction(own, "y", "p")


def metric_mapk(spark, d) -> DataFrame:
    """Customers' orders by price as the list, those of status F as the wanted ones."""
    from pyspark.sql import Window

    o = b.read(spark, d, "orders")
    ranked = o.select(F.col("o_custkey").alias("q"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"), F.col("o_orderkey").alias("item"))
    return metrics.mean_average_precision(ranked, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("item")))


def dq_profile(spark, d) -> DataFrame:
    return profile.file_profile(b.entities(spark, d))


def dq_country_mix(spark, d) -> DataFrame:
    return profile.country_mix(b.entities(spark, d))


def dq_truth_structure(spark, d) -> DataFrame:
    return profile.truth_structure(b.truth(spark, d), _queries(spark, d))


def dq_pair_similarity(spark, d) -> DataFrame:
    return profile.pair_similarity(b.truth(spark, d), b.normalised(spark, d))


def dq_integrity(spark, d) -> DataFrame:
    return profile.integrity(b.truth(spark, d), b.entities(spark, d))


def dq_script_hist(spark, d) -> DataFrame:
    return profile.script_histogram(b.entities(spark, d))


def dq_script_mix(spark, d) -> DataFrame:
    return profile.script_mix(b.entities(spark, d))


def dq_truth_sizes(spark, d) -> DataFrame:
    return profile.truth_sizes(b.truth(spark, d), _queries(spark, d))


def dq_pair_quantiles(spark, d) -> DataFrame:
    return profile.pair_quantiles(b.truth(spark, d), b.normalised(spark, d))


def dq_unlike_pairs(spark, d) -> DataFrame:
    return profile.unlike_pairs(b.truth(spark, d), b.normalised(spark, d))


def dq_script_agreement(spark, d) -> DataFrame:
    return profile.script_agreement(b.truth(spark, d), b.entities(spark, d))


def er_reachability_levels(spark, d) -> DataFrame:
    """Shares of true pairs within reach of three similarities of folded forms."""
    return profile.reachability(b.truth(spark, d), b.normalised(spark, d))


def dq_feature_auc(spark, d) -> DataFrame:
    """AUC and class means of each feature."""
    from kinspark.plans.q_features import feature_frame

    names = ["name_jac_tok", "addr_jac_tok", "name_contain", "addr_contain", "name_jac3", "addr_jac3"]
    labelled = feature_frame(spark, d, ("sets",)).join(b.truth(spark, d).withColumn("y", F.lit(1)), ["q", "c"], "left").fillna(0, ["y"])
    long = labelled.select("y", *(F.round(n, 6).alias(n) for n in names)).unpivot(["y"], names, "feature", "v")
    means = long.groupBy("feature").agg(F.round(F.avg(F.when(F.col("y") == 1, F.col("v"))), 6).alias("mean_pos"), F.round(F.avg(F.when(F.col("y") == 0, F.col("v"))), 6).alias("mean_neg"))
    return metrics.auc(long, "v", "y", ("feature",)).join(means, "feature")


QUERIES = {
    f.__name__: f
    for f in (
        er_pipeline_macro_f05, er_macro_f05, er_ceiling, er_eval_report, er_threshold_sweep, er_best_threshold, er_break_even, er_labelled_pairs, er_auc, er_average_precision, er_loss_decomposition, er_calibration,
        metric_regression, metric_classification, metric_logloss, metric_extraction_f1, metric_mapk, dq_profile, dq_country_mix, dq_truth_structure, dq_pair_similarity, dq_integrity, dq_script_hist, dq_script_mix, dq_truth_sizes, dq_pair_quantiles, dq_unlike_pairs, dq_script_agreement, er_reachability_levels, dq_feature_auc,
    )
}

F05 = "CASE WHEN {p} = 0 AND {t} = 0 THEN 1.0 WHEN {h} = 0 THEN 0.0 ELSE 1.25 * ({h} / {p}::DOUBLE) * ({h} / {t}::DOUBLE) / (0.25 * {h} / {p}::DOUBLE + {h} / {t}::DOUBLE) END"


def f05(h: str = "tp", p: str = "n_pred", t: str = "n_true") -> str:
    return F05.format(h=h, p=p, t=t)


def per_entity(chosen: str, name: str) -> str:
    return f"""{name} AS (SELECT e.q, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp FROM {EVERY} e LEFT JOIN (SELECT q, count(*) AS n_true FROM truth GROUP BY q) t ON t.q = e.q
  LEFT JOIN (SELECT x.q, count(*) AS n_pred, count(truth.c) AS tp FROM ({chosen}) x LEFT JOIN truth ON truth.q = x.q AND truth.c = x.c GROUP BY x.q) p ON p.q = e.q)"""


T = b.with_(b.NORM, b.TRUTH, b.PAIRS, b.SCORES)
FLAT = "SELECT q, c FROM scores WHERE p >= 0.4"
CAND = "SELECT q, c FROM pairs"
SWEEP = f""", ths AS (SELECT unnest({list(TH)})::DOUBLE AS th), sweep AS (SELECT th, round(avg({f05()}), 6) AS macro_f05, sum(n_pred)::BIGINT AS n_pred FROM (SELECT e.th, e.q, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp
  FROM (SELECT th, q FROM ths, {EVERY}) e LEFT JOIN (SELECT q, count(*) AS n_true FROM truth GROUP BY q) t ON t.q = e.q LEFT JOIN (SELECT th, s.q, count(*) AS n_pred, count(truth.c) AS tp FROM scores s JOIN ths ON p >= th LEFT JOIN truth ON truth.q = s.q AND truth.c = s.c GROUP BY ALL) p ON p.q = e.q AND p.th = e.th) GROUP BY th)"""
LAB = ", lab AS (SELECT s.*, (truth.c IS NOT NULL)::INT AS y FROM scores s LEFT JOIN truth ON truth.q = s.q AND truth.c = s.c)"
LINES = "(SELECT l_extendedprice AS y, l_extendedprice * (1 - l_discount) AS p, * FROM lineitem)"
CASES = "CASE WHEN l_tax > 0.05 THEN 'N' WHEN l_quantity > 30 THEN 'R' ELSE 'A' END"


def _auc(rows: str, by: str) -> str:
    return f"SELECT {by}, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))), 6) AS auc FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY v) + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2.0 AS r FROM ({rows})) GROUP BY {by}"


def _feature_auc() -> str:
    t1, t2, s1, s2 = (b.toks(x) for x in ("n1", "n2", "a1", "a2"))
    inside = lambda x, y: f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / least(len({x}), len({y})) END"
    g = {x: GRAMS.format(x=x) for x in ("n1", "n2", "a1", "a2")}
    parts = {"name_jac_tok": b.sql_jaccard(t1, t2), "addr_jac_tok": b.sql_jaccard(s1, s2), "name_contain": inside(t1, t2), "addr_contain": inside(s1, s2), "name_jac3": b.sql_jaccard(g["n1"], g["n2"]), "addr_jac3": b.sql_jaccard(g["a1"], g["a2"])}
    long = " UNION ALL ".join(f"SELECT q, c, '{n}' AS feature, round({x}, 6) AS v FROM pairs" for n, x in parts.items())
    return T + f", long AS (SELECT x.*, (truth.c IS NOT NULL)::INT AS y FROM ({long}) x LEFT JOIN truth ON truth.q = x.q AND truth.c = x.c) SELECT a.feature, auc, mean_pos, mean_neg FROM ({_auc('SELECT * FROM long', 'feature')}) a JOIN (SELECT feature, round(avg(v) FILTER (y = 1), 6) AS mean_pos, round(avg(v) FILTER (y = 0), 6) AS mean_neg FROM long GROUP BY feature) m USING (feature)"


ENTS = b.with_(b.ENT, b.TRUTH)
SIMILAR = (
    b.with_(b.NORM, b.TRUTH)
    + f""", m AS (SELECT truth.q, truth.c, {GRAMS.format(x='x.name_norm')} AS gn1, {GRAMS.format(x='y.name_norm')} AS gn2, {GRAMS.format(x='x.addr_norm')} AS ga1, {GRAMS.format(x='y.addr_norm')} AS ga2 FROM truth JOIN norm x ON x.entity_id = q JOIN norm y ON y.entity_id = c),
j AS (SELECT q, c, {b.sql_jaccard('gn1', 'gn2')} AS n, {b.sql_jaccard('ga1', 'ga2')} AS a FROM m) """
)
ORACLE = {
    "er_pipeline_macro_f05": T + "," + per_entity("SELECT q, c FROM (SELECT * FROM scores WHERE p >= 0.4) QUALIFY row_number() OVER (PARTITION BY c ORDER BY p DESC, q) = 1", "pe") + f" SELECT round(avg({f05()}), 6) AS macro_f05 FROM pe",
    "er_macro_f05": T + "," + per_entity(FLAT, "pe") + f" SELECT round(avg({f05()}), 6) AS macro_f05 FROM pe",
    "er_ceiling": T + "," + per_entity("SELECT q, c FROM pairs SEMI JOIN truth USING (q, c)", "pe") + f" SELECT round(avg({f05()}), 6) AS macro_f05 FROM pe",
    "er_eval_report": T
    + f""", {per_entity(FLAT, 'o')}, {per_entity(CAND, 'k')}, m AS (SELECT o.*, k.tp AS ctp FROM o JOIN k USING (q)),
r AS (SELECT count(*) AS entities, sum(tp)::BIGINT AS tp, (sum(n_pred) - sum(tp))::BIGINT AS fp, (sum(n_true) - sum(tp))::BIGINT AS fn, round(sum(tp) / sum(n_pred)::DOUBLE, 6) AS micro_precision, round(sum(tp) / sum(n_true)::DOUBLE, 6) AS micro_recall, round(avg({f05()}), 6) AS macro_f05,
  sum((n_true = 0)::INT)::BIGINT AS singletons, round(avg((n_pred = 0)::INT), 6) AS left_empty, sum((n_true = 0 AND n_pred > 0)::INT)::BIGINT AS singletons_hit, round(sum(ctp) / sum(n_true)::DOUBLE, 6) AS blocking_recall, round(avg({f05('ctp', 'ctp')}), 6) AS ceiling FROM m)
SELECT *, round(macro_f05 / ceiling, 6) AS efficiency, CASE WHEN 1 - ceiling > ceiling - macro_f05 THEN 'blocking' ELSE 'matching' END AS limiting_stage FROM r""",
    "er_threshold_sweep": T + SWEEP + " SELECT * FROM sweep",
    "er_best_threshold": T + SWEEP + " SELECT th, macro_f05 FROM sweep ORDER BY macro_f05 DESC, th LIMIT 1",
    "er_break_even": f"""WITH g AS (SELECT tp, tp + e AS n_pred, n_true FROM (SELECT unnest(range(0, 5)) AS tp), (SELECT unnest(range(0, 3)) AS e), (SELECT unnest(range(1, 7)) AS n_true) WHERE tp < n_true AND tp + e > 0),
v AS (SELECT *, {f05()} AS now, {f05('(tp + 1)', '(n_pred + 1)')} AS up, {f05('tp', '(n_pred + 1)')} AS down FROM g) SELECT tp, n_pred, n_true, round(CASE WHEN up - down > 0 THEN (now - down) / (up - down) ELSE 1.0 END, 6) AS confidence FROM v""",
    "er_labelled_pairs": T + LAB + " SELECT q, c, y FROM lab",
    "er_auc": T + LAB + " " + _auc("SELECT source, y, p AS v FROM lab", "source"),
    "er_average_precision": T + LAB + " SELECT source, round(sum(y * cum / pos::DOUBLE) / sum(y), 6) AS average_precision FROM (SELECT source, y, sum(y) OVER (PARTITION BY source ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS cum, count(*) OVER (PARTITION BY source ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS pos FROM lab) GROUP BY source",
    "er_loss_decomposition": T + f", {per_entity(FLAT, 'o')}, {per_entity(CAND, 'k')}, m AS (SELECT avg({f05('o.tp', 'o.n_pred', 'o.n_true')}) AS now, avg({f05('o.tp', 'o.tp', 'o.n_true')}) AS pure, avg({f05('k.tp', 'k.tp', 'o.n_true')}) AS ceiling FROM o JOIN k USING (q)) SELECT round(1 - ceiling, 6) AS blocking_miss, round(ceiling - pure, 6) AS matcher_reject, round(pure - now, 6) AS false_positive FROM m",
    "er_calibration": T + LAB + " SELECT least(floor(p / 0.1), 9)::INT AS band, count(*) AS n, round(avg(y), 6) AS share_true FROM lab GROUP BY 1",
    "metric_regression": f"""SELECT round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg(pow(ln(1 + greatest(p, 0)) - ln(1 + y), 2))), 6) AS rmsle, round(avg(CASE WHEN abs(y) > 1e-9 THEN abs((y - p) / y) END) * 100, 6) AS mape,
  round(avg(CASE WHEN abs(y) + abs(p) > 0 THEN 2 * abs(y - p) / (abs(y) + abs(p)) ELSE 0 END) * 100, 6) AS smape, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) AS r2, round(greatest(0, 100 - avg(CASE WHEN abs(y) > 1e-9 THEN abs((y - p) / y) END) * 100), 6) AS capped_score FROM {LINES}""",
    "metric_classification": f"""WITH x AS (SELECT l_returnflag AS y, {CASES} AS p FROM lineitem), k AS (SELECT y AS k FROM x UNION SELECT p FROM x), e AS (SELECT k, (SELECT count(*) FROM x WHERE y = k AND p = k) AS tp, (SELECT count(*) FROM x WHERE y = k) AS t, (SELECT count(*) FROM x WHERE p = k) AS n FROM k)
SELECT round(sum(tp) / sum(t)::DOUBLE, 6) AS accuracy, round(avg(2 * tp / (t + n)::DOUBLE), 6) AS f1_macro, round(sum(tp) / sum(t)::DOUBLE, 6) AS f1_micro, round(sum(2 * tp / (t + n)::DOUBLE * t) / sum(t), 6) AS f1_weighted FROM e""",
    "metric_logloss": "SELECT round(-avg(CASE WHEN l_linestatus = 'O' THEN ln(0.1 + l_tax * 8) ELSE ln(1 - (0.1 + l_tax * 8)) END), 6) AS log_loss FROM lineitem",
    "metric_extraction_f1": """WITH x AS (SELECT CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS y, CASE WHEN c_nationkey % 5 = 0 THEN '' WHEN c_nationkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS p FROM customer),
s AS (SELECT count(*) FILTER (p <> '' AND p = y) AS tp, count(*) FILTER (p <> '' AND p <> y) AS fp, count(*) FILTER (p = '' AND y <> '') AS fn, count(*) FILTER (p = '' AND y = '') AS tn FROM x) SELECT *, round(2.0 * tp / (2.0 * tp + fp + fn), 6) AS f1 FROM s""",
    "metric_mapk": """WITH r AS (SELECT o_custkey AS q, o_orderkey AS item, o_orderstatus AS st, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
h AS (SELECT q, sum(n / rank::DOUBLE) AS s FROM (SELECT q, rank, row_number() OVER (PARTITION BY q ORDER BY rank) AS n FROM r WHERE rank <= 10 AND st = 'F') GROUP BY q), a AS (SELECT q, count(*) AS n FROM r WHERE st = 'F' GROUP BY q)
SELECT round(avg(coalesce(s, 0) / least(n, 10)), 6) AS map_at_k FROM a LEFT JOIN h USING (q)""",
    "dq_profile": ENTS + "SELECT source, count(*) AS n_rows, count(DISTINCT country) AS n_countries, sum((business_name = '')::INT)::BIGINT AS empty_names, sum((business_address = '')::INT)::BIGINT AS empty_addresses, round(avg(length(business_name)), 6) AS name_mean, round(quantile_cont(length(business_name), 0.5), 6) AS name_median, max(length(business_name))::INT AS name_max, round(avg(length(business_address)), 6) AS addr_mean, round(quantile_cont(length(business_address), 0.5), 6) AS addr_median, max(length(business_address))::INT AS addr_max, (count(*) - count(DISTINCT entity_id))::BIGINT AS repeated_ids FROM ent GROUP BY source",
    "dq_country_mix": ENTS + "SELECT coalesce(source, 'all') AS source, coalesce(country, 'all') AS country, count(*) AS n_rows FROM ent GROUP BY ROLLUP (source, country)",
    "dq_truth_structure": ENTS + f"""SELECT k, entities, in_both, s2_only, s3_only, round(entities / sum(entities) OVER ()::DOUBLE, 6) AS share, round(sum(entities) OVER (ORDER BY k) / sum(entities) OVER ()::DOUBLE, 6) AS share_up_to FROM (SELECT k, count(*) AS entities, sum(s2 * s3)::BIGINT AS in_both, sum(s2 * (1 - s3))::BIGINT AS s2_only, sum(s3 * (1 - s2))::BIGINT AS s3_only FROM
  (SELECT e.q, count(truth.c) AS k, coalesce(max((truth.c LIKE 'S2%')::INT), 0) AS s2, coalesce(max((truth.c LIKE 'S3%')::INT), 0) AS s3 FROM {EVERY} e LEFT JOIN truth ON truth.q = e.q GROUP BY e.q) GROUP BY k)""",
    "dq_pair_similarity": b.with_(b.NORM, b.TRUTH)
    + f""", m AS (SELECT (x.country = y.country)::INT AS same, {GRAMS.format(x='x.name_norm')} AS gn1, {GRAMS.format(x='y.name_norm')} AS gn2, {GRAMS.format(x='x.addr_norm')} AS ga1, {GRAMS.format(x='y.addr_norm')} AS ga2 FROM truth JOIN norm x ON x.entity_id = q JOIN norm y ON y.entity_id = c),
j AS (SELECT same, {b.sql_jaccard('gn1', 'gn2')} AS n, {b.sql_jaccard('ga1', 'ga2')} AS a FROM m) SELECT count(*) AS pairs, round(avg(same), 6) AS same_country, round(avg(n), 6) AS name_mean, round(avg(a), 6) AS addr_mean, round(avg((n >= 0.5)::INT), 6) AS name_half, round(avg((a >= 0.5)::INT), 6) AS addr_half FROM j""",
    "dq_integrity": ENTS
    + """SELECT check_name, n AS faults, n = 0 AS passed FROM (SELECT 'repeated pair' AS check_name, (SELECT count(*) FROM (SELECT q, c FROM truth GROUP BY ALL HAVING count(*) > 1)) AS n UNION ALL SELECT 'wrong prefix', (SELECT count(*) FROM truth WHERE NOT regexp_matches(c, '^S[23]-')) UNION ALL SELECT 'several owners', (SELECT count(*) FROM (SELECT c FROM truth GROUP BY c HAVING count(DISTINCT q) > 1))
UNION ALL SELECT 'dangling match', (SELECT count(*) FROM truth WHERE c NOT IN (SELECT entity_id FROM ent)) UNION ALL SELECT 'dangling entity', (SELECT count(*) FROM truth WHERE q NOT IN (SELECT entity_id FROM ent)) UNION ALL SELECT 'country differs', (SELECT count(*) FROM truth JOIN ent x ON x.entity_id = q JOIN ent y ON y.entity_id = c WHERE x.country <> y.country) UNION ALL SELECT 'repeated id', (SELECT count(*) FROM (SELECT entity_id FROM ent GROUP BY 1 HAVING count(*) > 1)))""",
    "dq_feature_auc": _feature_auc(),
    "dq_script_mix": ENTS + "SELECT source, script, count(*) AS n FROM (SELECT source, " + _script("business_name") + " AS script FROM ent) GROUP BY ALL",
    "dq_truth_sizes": ENTS
    + f"""SELECT count(*) AS entities, round(avg(k), 6) AS mean, {', '.join(f"list_sort(list(k))[least(floor(count(*) * {s})::BIGINT, count(*) - 1) + 1] AS p{round(s * 100)}" for s in (0.5, 0.9, 0.99))}, max(k) AS most FROM (SELECT e.q, count(truth.c) AS k FROM {EVERY} e LEFT JOIN truth ON truth.q = e.q GROUP BY e.q)""",
    "dq_pair_quantiles": SIMILAR + "SELECT share, round(name, 6) AS name, round(addr, 6) AS addr FROM (" + " UNION ALL ".join(f"SELECT {s}::DOUBLE AS share, quantile_cont(n, {s}) AS name, quantile_cont(a, {s}) AS addr FROM j" for s in (0.01, 0.05, 0.25, 0.5, 0.75)) + ")",
    "dq_unlike_pairs": SIMILAR + "SELECT q, c, round(n, 6) AS n, round(a, 6) AS a FROM j ORDER BY greatest(round(n, 6), round(a, 6)), q, c LIMIT 10",
    "er_reachability_levels": SIMILAR
    + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS level, round(avg((n >= {t})::INT), 6) AS by_name, round(avg((a >= {t})::INT), 6) AS by_addr, round(avg((n >= {t} OR a >= {t})::INT), 6) AS by_either, round(avg((n < {t} AND a < {t})::INT), 6) AS unreachable, sum((a >= {t} AND n < {t})::INT)::BIGINT AS rescued FROM j" for t in (0.3, 0.5, 0.7)),
    "dq_script_agreement": ENTS + f"SELECT x.s AS script1, y.s AS script2, count(*) AS pairs FROM truth JOIN (SELECT entity_id, {_script('business_name')} AS s FROM ent) x ON x.entity_id = q JOIN (SELECT entity_id, {_script('business_name')} AS s FROM ent) y ON y.entity_id = c GROUP BY ALL",
    "dq_script_hist": ENTS + "SELECT script, count(*) AS n FROM (SELECT " + _script("business_name") + " AS script FROM ent) GROUP BY script",
}
