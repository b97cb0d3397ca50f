"""Queries of candidate generation, relative features and decisions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.functions import similarity as sim
from kinspark.functions import text, tokens
from kinspark.operators import blocking, decide, features, relative
from kinspark.operators.blocking import PRESETS
from kinspark.plans import bridge as b
from kinspark.plans.q_features import IDF

K = 10


def _queries(spark, d) -> DataFrame:
    return b.entities(spark, d).where("source = 'S1'").select(F.col("entity_id").alias("q"))


def _word(spark, d, name: str = "combo", k: int = K) -> DataFrame:
    return b.kept(spark, d, f"word-{name}-{k}", lambda s, x: blocking.cosine_top_k(b.normalised(s, x), replace(PRESETS["prod-word"], k=k), name))


def er_block_topk_word(spark, d) -> DataFrame:
    return _word(spark, d).select("q", "c", "source", "sim")


def er_block_topk_char3(spark, d) -> DataFrame:
    return blocking.cosine_top_k(b.normalised(spark, d), replace(PRESETS["prod-char"], k=K)).select("q", "c", "source", "sim")


def er_block_word_count(spark, d) -> DataFrame:
    return blocking.cosine_top_k(b.normalised(spark, d), replace(PRESETS["word-count"], k=K)).select("q", "c", "source", "sim")


def er_block_exact_key(spark, d) -> DataFrame:
    return blocking.exact_key(b.normalised(spark, d))


def er_block_rare_token(spark, d) -> DataFrame:
    return blocking.rare_token(b.normalised(spark, d))


def _union(spark, d) -> DataFrame:
    return blocking.union_candidates(*(_word(spark, d, n) for n in ("combo", "addr")), blocking.exact_key(b.normalised(spark, d)))


def er_block_union(spark, d) -> DataFrame:
    return _union(spark, d)


def er_block_eval(spark, d) -> DataFrame:
    return blocking.evaluate(_union(spark, d), b.truth(spark, d), _queries(spark, d))


def _level(ks: tuple[int, ...]):
    """The least of ``ks`` that takes in a rank."""
    return F.array_min(F.filter(F.array(*map(F.lit, ks)), lambda k: k >= F.col("rn"))).alias("level")


def er_block_sweep(spark, d) -> DataFrame:
    """One table of scored triples, read at several K."""
    ks = (1, 5, 10, 25, 50)
    levels = spark.createDataFrame([(level, k) for level in ks for k in ks if k >= level], "level int, k int")
    cand = _word(spark, d, k=max(ks)).select(_level(ks), "q", "c")
    return blocking.evaluate(cand, b.truth(spark, d), _queries(spark, d), ("k",), (("level",), levels))


def er_signal_union(spark, d) -> DataFrame:
    """Every combination of three signals, by a bit mask for each pair."""
    passes = {"combo": _word(spark, d), "addr": _word(spark, d, "addr"), "exact": blocking.exact_key(b.normalised(spark, d))}
    combos = spark.createDataFrame([(mask, m) for mask in range(1, 8) for m in range(1, 8) if mask & m], "mask int, combo int")
    return blocking.evaluate(blocking.signal_masks(passes), b.truth(spark, d), _queries(spark, d), ("combo",), (("mask",), combos))


def er_block_ablation(spark, d) -> DataFrame:
    """Recall lost when one pass is left out."""
    full = er_signal_union(spark, d).select("combo", "tp", "candidates")
    whole = full.where("combo = 7").select(F.col("tp").alias("all_tp"), F.col("candidates").alias("all_cand"))
    left = full.where("combo in (3, 5, 6)").join(F.broadcast(whole), F.lit(True))  # one row beside each of three
    return left.select((F.lit(7) - F.col("combo")).alias("without"), (F.col("all_tp") - F.col("tp")).alias("tp_lost"), (F.col("all_cand") - F.col("candidates")).alias("cand_saved"))


def er_block_shootout(spark, d) -> DataFrame:
    """Three ways to weigh terms, each scored once and read at several K."""
    ks, presets = (5, 25), {"word": PRESETS["prod-word"], "count": PRESETS["word-count"], "char3": PRESETS["prod-char"]}
    out = None
    for method, preset in presets.items():
        own = blocking.cosine_top_k(b.normalised(spark, d), replace(preset, k=max(ks))).select(F.lit(method).alias("method"), _level(ks), "q", "c")
        out = own if out is None else out.unionByName(own)
    levels = spark.createDataFrame([(m, level, f"{m}-{k}") for m in presets for level in ks for k in ks if k >= level], "method string, level int, setup string")
    return blocking.evaluate(out, b.truth(spark, d), _queries(spark, d), ("setup",), (("method", "level"), levels), few=True)


def er_block_floors(spark, d) -> DataFrame:
    """Two passes with a floor of similarity each, then the best five of each group."""
    return blocking.build_candidates({n: _word(spark, d, n) for n in ("combo", "addr")}, {"combo": 0.2, "addr": 0.3}, 5)


def er_reduction_ratio(spark, d) -> DataFrame:
    """The share of all comparisons that blocking saves."""
    return blocking.reduction_ratio(_union(spark, d), b.entities(spark, d))


def er_eval_by_country(spark, d) -> DataFrame:
    """Recall and size of candidates in each country."""
    return blocking.evaluate_by_country(_union(spark, d), b.truth(spark, d), b.entities(spark, d))


def er_seed_stability(spark, d) -> DataFrame:
    return blocking.seed_stability(_union(spark, d), b.truth(spark, d), spark.createDataFrame([(i,) for i in range(1, 6)], "seed int"))


def er_reachability(spark, d) -> DataFrame:
    """Share of true pairs within reach of a similarity of each signal."""
    records = b.normalised(spark, d).select("entity_id", tokens.padded_trigrams("name_norm").alias("gn"), tokens.padded_trigrams("addr_norm").alias("ga"))
    met = b.truth(spark, d).join(records.select(F.col("entity_id").alias("q"), F.col("gn").alias("gn1"), F.col("ga").alias("ga1")), "q").join(records.select(F.col("entity_id").alias("c"), F.col("gn").alias("gn2"), F.col("ga").alias("ga2")), "c")
    scored = met.select(sim.jaccard(F.col("gn1"), F.col("gn2")).alias("n"), sim.jaccard(F.col("ga1"), F.col("ga2")).alias("a"))
    share = lambda test: F.round(F.avg(test.cast("double")), 6)
    return scored.agg(F.count(F.lit(1)).alias("pairs"), share(F.col("n") >= 0.5).alias("by_name"), share(F.col("a") >= 0.5).alias("by_addr"), share((F.col("n") >= 0.5) | (F.col("a") >= 0.5)).alias("by_either"))


def er_rel_windows(spark, d) -> DataFrame:
    own = b.scores(spark, d).select("q", "c", F.col("p").alias("addr_idf_overlap"))
    made = relative.relative_features(own, ("addr_idf_overlap",))
    return made.select("q", "c", *(F.round(F.col(n).cast("double"), 8).alias(n) for n in made.columns[3:]))


def _forms(spark, d) -> DataFrame:
    records = b.normalised(spark, d)
    idf = tokens.feature_idf(records.select(text.tokens(text.combo("name_norm", "addr_norm")).alias("terms")), "terms")
    return features.record_forms(records, idf).select("entity_id", "tn", "ta", "idf")


def er_rel_cross(spark, d) -> DataFrame:
    own = b.scores(spark, d).select("q", "c", "source", F.col("p").alias("addr_idf_overlap"))
    made = relative.cross_rank(relative.cross_source(own, _forms(spark, d)))
    return made.select("q", "c", F.round("cross_addr", 6).alias("cross_addr"), F.round("cross_name", 6).alias("cross_name"))


def er_rel_mirror(spark, d) -> DataFrame:
    return relative.mirror_features(b.scores(spark, d).select("q", "c", "p"))


def er_rel_stacked(spark, d) -> DataFrame:
    made = relative.stacked_features(b.scores(spark, d).select("q", "c", "p"))
    return made.select("q", "c", *(F.round(n, 8).alias(n) for n in ("sc_rank", "sc_gap_best", "sc_over_best", "sc_n_conf", "sc_best")))


def _scores(spark, d) -> DataFrame:
    return b.scores(spark, d).select("q", "c", "p")


def er_rule_flat(spark, d) -> DataFrame:
    return decide.flat(_scores(spark, d), 0.4)


def er_rule_rescue(spark, d) -> DataFrame:
    return decide.rescue(_scores(spark, d), 0.6, 0.1)


def er_rule_rank_aware(spark, d) -> DataFrame:
    return decide.rank_aware(_scores(spark, d), 0.1, 0.05)


def er_rule_exclusive(spark, d) -> DataFrame:
    return decide.exclusive(_scores(spark, d))


def er_contested(spark, d) -> DataFrame:
    return decide.contested(decide.flat(_scores(spark, d), 0.1))


def _claims(scores: DataFrame) -> DataFrame:
    """Claims with scores left out where p is over a half, containment = p."""
    return scores.select("q", "c", F.when(F.col("p") < 0.5, F.col("p")).alias("score"), F.col("p").alias("containment"))


def er_conflict_resolve(spark, d) -> DataFrame:
    return decide.resolve_conflicts(_claims(_scores(spark, d))).select("q", "c", "score", "containment")


def er_cascade_blend(spark, d) -> DataFrame:
    return decide.blend(_scores(spark, d).withColumn("ce", 1 - F.col("p")), 0.05, 0.95, 0.6).select("q", "c", F.round("p", 6).alias("p"))


def er_submission(spark, d) -> DataFrame:
    return decide.submission(_queries(spark, d), decide.flat(_scores(spark, d), 0.4))


def er_splice(spark, d) -> DataFrame:
    everyone = _queries(spark, d)
    old = decide.submission(everyone, decide.flat(_scores(spark, d), 0.2)).select(F.col("source1_entity_id").alias("q"), F.col("matched_entity_ids").alias("ids"))
    new = decide.submission(everyone, decide.flat(_scores(spark, d), 0.4)).select(F.col("source1_entity_id").alias("q"), F.col("matched_entity_ids").alias("ids")).where("left(md5(q), 1) < '8'")
    return decide.splice(everyone, new, old)


def er_submission_faults(spark, d) -> DataFrame:
    return decide.submission_faults(er_submission(spark, d), _queries(spark, d), b.entities(spark, d))


def er_prune(spark, d) -> DataFrame:
    return decide.prune(_scores(spark, d), 3)


QUERIES = {
    f.__name__: f
    for f in (
        er_block_topk_word, er_block_topk_char3, er_block_word_count, er_block_exact_key, er_block_rare_token, er_block_union, er_block_eval, er_block_sweep, er_signal_union, er_block_ablation, er_block_shootout, er_block_floors, er_reduction_ratio, er_eval_by_country, er_seed_stability, er_reachability,
        er_rel_windows, er_rel_cross, er_rel_mirror, er_rel_stacked, er_rule_flat, er_rule_rescue, er_rule_rank_aware, er_rule_exclusive, er_contested, er_conflict_resolve, er_cascade_blend, er_submission, er_splice, er_submission_faults, er_prune,
    )
}


SIGNALS = {"combo": "trim(name_norm || ' ' || addr_norm)", "name": "name_norm", "addr": "addr_norm"}
WORDS = "list_filter(string_split({x}, ' '), lambda t: length(t) >= 2)"
CHARS = "flatten(list_transform(list_filter(string_split({x}, ' '), lambda t: t <> ''), lambda w: CASE WHEN length(w) <= 1 THEN [' ' || w || ' '] ELSE list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)) END))"


def topk_ctes(name: str, k: int, terms: str = WORDS, signal: str = "combo", min_df: int = 1, max_df: float = 0.05, binary: bool = False, threshold: str = "1e-6") -> str:
    """CTE ``name``(q, c, source, sim, rn)."""
    p = name
    weight = "1.0" if binary else "x / sqrt(sum(x * x) OVER (PARTITION BY entity_id, source))"
    keep = f"df BETWEEN {min_df} AND greatest(2.0, floor({max_df} * n))"
    return f"""
{p}_t AS (SELECT entity_id, source, country, term, count(*) AS tf FROM (SELECT entity_id, source, country, unnest({terms.format(x=SIGNALS[signal])}) AS term FROM norm) GROUP BY ALL),
{p}_n AS (SELECT country, source, count(*) AS n FROM norm WHERE source <> 'S1' GROUP BY ALL),
{p}_idf AS (SELECT country, source, term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT country, source, term, count(*) AS df FROM {p}_t WHERE source <> 'S1' GROUP BY ALL) JOIN {p}_n USING (country, source) WHERE {keep}),
{p}_c AS (SELECT *, {weight} AS w FROM (SELECT t.entity_id, t.source, t.country, t.term, tf * idf AS x FROM {p}_t t JOIN {p}_idf i ON i.country = t.country AND i.source = t.source AND i.term = t.term WHERE t.source <> 'S1')),
{p}_q AS (SELECT *, {weight} AS w FROM (SELECT t.entity_id, i.source, t.country, t.term, tf * idf AS x FROM {p}_t t JOIN {p}_idf i ON i.country = t.country AND i.term = t.term WHERE t.source = 'S1')),
{p}_s AS (SELECT a.entity_id AS q, z.entity_id AS c, a.source, round(sum(a.w * z.w), 6) AS sim FROM {p}_q a JOIN {p}_c z ON a.country = z.country AND a.source = z.source AND a.term = z.term GROUP BY ALL),
{p} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, source ORDER BY sim DESC, c) AS rn FROM {p}_s WHERE sim > {threshold}) WHERE rn <= {k})"""


EXACT = """
exact_k AS (SELECT x.entity_id AS q, y.entity_id AS c, y.source FROM (SELECT *, array_to_string(list_sort(list_filter(string_split(trim(name_norm || ' ' || addr_norm), ' '), lambda t: t <> '')), ' ') AS k FROM norm) x
  JOIN (SELECT *, array_to_string(list_sort(list_filter(string_split(trim(name_norm || ' ' || addr_norm), ' '), lambda t: t <> '')), ' ') AS k FROM norm) y ON x.country = y.country AND x.k = y.k WHERE x.source = 'S1' AND y.source <> 'S1' AND x.k <> '')"""
UNION = f", cand AS (SELECT q, c, source FROM wc WHERE rn <= {K} UNION SELECT q, c, source FROM wa WHERE rn <= {K} UNION SELECT q, c, source FROM exact_k)"


def _eval(cand: str, by: str = "") -> str:
    """Evaluation of ``cand`` (by, q, c)."""
    cols, on = (f"{by}, ", f"AND x.{by} = base.{by}") if by else ("", "")
    base = f"(SELECT DISTINCT {by} FROM ({cand})) g, " if by else ""
    return f"""SELECT {f'base.{by}, ' if by else ''}sum(tp)::BIGINT AS tp, (sum(n_true) - sum(tp))::BIGINT AS fn, round(sum(tp) / sum(n_true)::DOUBLE, 6) AS recall,
  round(avg(CASE WHEN n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_true::DOUBLE) / (0.25 + tp / n_true::DOUBLE) END), 6) AS max_macro_f05, round(avg((tp = n_true)::INT::DOUBLE), 6) AS complete_share,
  sum(n_cand)::BIGINT AS candidates, round(sum(n_cand) / count(*)::DOUBLE, 6) AS cand_per_entity
FROM (SELECT base.*, coalesce(x.n_cand, 0) AS n_cand, coalesce(x.tp, 0) AS tp FROM (SELECT {f'g.{by}, ' if by else ''}e.entity_id AS q, coalesce(t.n, 0) AS n_true FROM {base}ent e LEFT JOIN (SELECT q, count(*) AS n FROM truth GROUP BY q) t ON t.q = e.entity_id WHERE e.source = 'S1') base
  LEFT JOIN (SELECT {cols}d.q, count(*) AS n_cand, count(truth.c) AS tp FROM ({cand}) d LEFT JOIN truth ON truth.q = d.q AND truth.c = d.c GROUP BY ALL) x ON x.q = base.q {on}) base{f' GROUP BY base.{by}' if by else ''}"""


BASE = (b.NORM, b.TRUTH, topk_ctes("wc", 50), topk_ctes("wa", 50, signal="addr"), EXACT)
MASKS = f"""SELECT combo, q, c FROM (SELECT q, c, bit_or(bit) AS mask FROM (SELECT q, c, 1 AS bit FROM wc WHERE rn <= {K} UNION SELECT q, c, 2 FROM wa WHERE rn <= {K} UNION SELECT q, c, 4 FROM exact_k) GROUP BY ALL), (SELECT unnest(range(1, 8))::INT AS combo) WHERE mask & combo > 0"""
S = b.with_(b.NORM, b.PAIRS, b.SCORES)
EVERY = "(SELECT entity_id AS q FROM ent WHERE source = 'S1')"
LISTS = "SELECT e.q, coalesce(ids, '') AS ids FROM " + EVERY + " e LEFT JOIN (SELECT q, string_agg(c, ',' ORDER BY c) AS ids FROM scores WHERE p >= {t} GROUP BY q) USING (q)"


def _rel() -> str:
    v, w = "p", "OVER (PARTITION BY q)"
    r = lambda x, n: f"round(({x})::DOUBLE, 8) AS {n}"
    f = "addr_idf_overlap"
    return S + "SELECT q, c, " + ", ".join(
        (
            r(f"(row_number() OVER (PARTITION BY q ORDER BY {v} DESC, c) - 1) / greatest(count(*) {w} - 1, 1)::DOUBLE", f"{f}_rank"),
            r(f"max({v}) {w} - {v}", f"{f}_gap_best"),
            r(f"CASE WHEN max({v}) {w} > 0 THEN {v} / max({v}) {w} ELSE 0 END", f"{f}_over_best"),
            r(f"CASE WHEN stddev_pop({v}) {w} > 1e-6 THEN ({v} - avg({v}) {w}) / stddev_pop({v}) {w} ELSE 0 END", f"{f}_z"),
            r(f"count(*) {w}", "n_cands"),
            r(f"sum(({v} > 0.5)::INT) {w}", "n_strong"),
            r(f"max({v}) {w}", "best_overall"),
            r(f"avg({v}) {w}", "mean_overall"),
            r(f"(row_number() OVER (PARTITION BY q ORDER BY {v} DESC, c) = 1)::INT", "is_argmax"),
            r(f"sum(({v} >= 0.9)::INT) {w}", "addr_strong_n"),
            r(f"({v} >= 0.9 AND sum(({v} >= 0.9)::INT) {w} = 1)::INT", "addr_strong_sole"),
        )
    ) + " FROM scores"


def _cross() -> str:
    def over(field: str, name: str) -> str:
        return f"""{name} AS (SELECT q, c, max(v) AS v FROM (SELECT q, c, o, CASE WHEN bool_or(l) AND bool_or(r) THEN coalesce(sum(idf) FILTER (l AND r), 0) / sum(idf) ELSE 0 END AS v FROM
  (SELECT q, c, o, t, bool_or(s = 1) AS l, bool_or(s = 2) AS r FROM (SELECT q, c, o, unnest({b.toks('x.' + field)}) AS t, 1 AS s FROM met JOIN norm x ON x.entity_id = met.c UNION ALL SELECT q, c, o, unnest({b.toks('x.' + field)}), 2 FROM met JOIN norm x ON x.entity_id = met.o) GROUP BY ALL) JOIN idf ON term = t GROUP BY q, c, o) GROUP BY q, c)"""

    return (
        b.with_(b.NORM, b.PAIRS, b.SCORES, IDF)
        + f""", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, c) AS rn FROM scores) WHERE rn <= 4),
met AS (SELECT s.q, s.c, t.c AS o FROM scores s JOIN top t ON t.q = s.q AND t.source <> s.source), {over('addr_norm', 'ca')}, {over('name_norm', 'cn')}
SELECT scores.q, scores.c, round(coalesce(ca.v, 0), 6) AS cross_addr, round(coalesce(cn.v, 0), 6) AS cross_name FROM scores LEFT JOIN ca ON ca.q = scores.q AND ca.c = scores.c LEFT JOIN cn ON cn.q = scores.q AND cn.c = scores.c"""
    )


GRAMS = "CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, length({x}) + 2), lambda i: substr('  ' || {x} || ' ', i, 3))) END"

ORACLE = {
    "er_block_topk_word": b.with_(b.NORM, topk_ctes("wc", K)) + "SELECT q, c, source, sim FROM wc",
    "er_block_topk_char3": b.with_(b.NORM, topk_ctes("ch", K, CHARS, min_df=3, threshold="0")) + "SELECT q, c, source, sim FROM ch",
    "er_block_word_count": b.with_(b.NORM, topk_ctes("wk", K, binary=True)) + "SELECT q, c, source, sim FROM wk",
    "er_block_exact_key": b.with_(b.NORM, EXACT) + "SELECT q, c, source FROM exact_k",
    "er_block_rare_token": b.with_(b.NORM)
    + """, t AS (SELECT DISTINCT country, entity_id, source, unnest(list_filter(string_split(trim(name_norm || ' ' || addr_norm), ' '), lambda t: length(t) >= 3)) AS term FROM norm), s AS (SELECT country, term FROM t GROUP BY ALL HAVING count(*) BETWEEN 2 AND 40),
m AS (SELECT DISTINCT x.entity_id AS q, y.entity_id AS c, y.source FROM t x JOIN s USING (country, term) JOIN t y USING (country, term) WHERE x.source = 'S1' AND y.source <> 'S1')
SELECT q, c, source FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c) AS rn FROM m) WHERE rn <= 60""",
    "er_block_union": b.with_(*BASE) + UNION + "SELECT q, c, source FROM cand",
    "er_block_eval": b.with_(*BASE) + UNION + _eval("SELECT q, c FROM cand"),
    "er_block_sweep": b.with_(b.NORM, b.TRUTH, topk_ctes("wc", 50)) + _eval("SELECT k, q, c FROM wc, (SELECT unnest([1, 5, 10, 25, 50])::INT AS k) ks WHERE rn <= k", "k"),
    "er_signal_union": b.with_(*BASE) + _eval(MASKS, "combo"),
    "er_block_ablation": b.with_(*BASE) + f", e AS ({_eval(MASKS, 'combo')}) SELECT 7 - l.combo AS without, (w.tp - l.tp)::BIGINT AS tp_lost, (w.candidates - l.candidates)::BIGINT AS cand_saved FROM e l, e w WHERE w.combo = 7 AND l.combo IN (3, 5, 6)",
    "er_block_shootout": b.with_(b.NORM, b.TRUTH, topk_ctes("wd", 25), topk_ctes("ct", 25, binary=True), topk_ctes("ch", 25, CHARS, min_df=3, threshold="0"))
    + _eval("SELECT m || '-' || k AS setup, q, c FROM (SELECT 'word' AS m, q, c, rn FROM wd UNION ALL SELECT 'count', q, c, rn FROM ct UNION ALL SELECT 'char3', q, c, rn FROM ch), (SELECT unnest([5, 25]) AS k) ks WHERE rn <= k", "setup"),
    "er_seed_stability": b.with_(*BASE)
    + UNION
    + ", h AS (SELECT truth.q, truth.c, cand.c IS NOT NULL AS hit FROM truth LEFT JOIN cand ON cand.q = truth.q AND cand.c = truth.c), e AS (SELECT seed, avg(hit::INT) AS r FROM h, (SELECT unnest(range(1, 6)) AS seed) s WHERE left(md5(seed || '|' || q), 1) < '5' GROUP BY seed) SELECT count(*) AS seeds, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS deviation, round(min(r), 6) AS least, round(max(r), 6) AS most FROM e",
    "er_reachability": b.with_(b.NORM, b.TRUTH)
    + f""", m AS (SELECT {GRAMS.format(x='x.name_norm')} AS gn1, {GRAMS.format(x='y.name_norm')} AS gn2, {GRAMS.format(x='x.addr_norm')} AS ga1, {GRAMS.format(x='y.addr_norm')} AS ga2 FROM truth JOIN norm x ON x.entity_id = q JOIN norm y ON y.entity_id = c),
j AS (SELECT {b.sql_jaccard('gn1', 'gn2')} AS n, {b.sql_jaccard('ga1', 'ga2')} AS a FROM m)
SELECT count(*) AS pairs, round(avg((n >= 0.5)::INT), 6) AS by_name, round(avg((a >= 0.5)::INT), 6) AS by_addr, round(avg((n >= 0.5 OR a >= 0.5)::INT), 6) AS by_either FROM j""",
    "er_rel_windows": _rel(),
    "er_rel_cross": _cross(),
    "er_rel_mirror": S + "SELECT q, c, p, row_number() OVER (PARTITION BY c ORDER BY p DESC, q)::INT AS claim_rank, count(*) OVER (PARTITION BY c) AS n_claims FROM scores",
    "er_rel_stacked": S + "SELECT q, c, round((row_number() OVER (PARTITION BY q ORDER BY p DESC, c) - 1)::DOUBLE, 8) AS sc_rank, round(max(p) OVER w - p, 8) AS sc_gap_best, round(CASE WHEN max(p) OVER w > 0 THEN p / max(p) OVER w ELSE 0 END, 8) AS sc_over_best, round(sum((p > 0.5)::INT) OVER w::DOUBLE, 8) AS sc_n_conf, round(max(p) OVER w, 8) AS sc_best FROM scores WINDOW w AS (PARTITION BY q)",
    "er_rule_flat": S + "SELECT q, c, p FROM scores WHERE p >= 0.4",
    "er_rule_rescue": S + "SELECT q, c, p FROM (SELECT *, max(p) OVER (PARTITION BY q) AS b, row_number() OVER (PARTITION BY q ORDER BY p DESC, c) AS r FROM scores) WHERE p >= 0.6 OR (r = 1 AND b < 0.6 AND b >= 0.1)",
    "er_rule_rank_aware": S + "SELECT q, c, p FROM (SELECT *, min((p >= least(0.1 + (r - 1) * 0.05, 0.999))::INT) OVER (PARTITION BY q ORDER BY r) AS h FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, c) AS r FROM scores)) WHERE h = 1",
    "er_rule_exclusive": S + "SELECT q, c, p FROM scores QUALIFY row_number() OVER (PARTITION BY c ORDER BY p DESC, q) = 1",
    "er_contested": S + "SELECT c, count(*) AS n_claims FROM scores WHERE p >= 0.1 GROUP BY c HAVING count(*) > 1",
    "er_conflict_resolve": S + "SELECT q, c, score, containment FROM (SELECT q, c, CASE WHEN p < 0.5 THEN p END AS score, p AS containment FROM scores) QUALIFY row_number() OVER (PARTITION BY c ORDER BY (score IS NULL) DESC, coalesce(score, containment) DESC, q DESC) = 1",
    "er_cascade_blend": S + "SELECT q, c, round(CASE WHEN p >= 0.05 AND p < 0.95 THEN 0.6 * (1 - p) + 0.4 * p ELSE p END, 6) AS p FROM scores",
    "er_submission": S + "SELECT q AS source1_entity_id, ids AS matched_entity_ids FROM (" + LISTS.format(t=0.4) + ")",
    "er_splice": S
    + "SELECT o.q, CASE WHEN left(md5(o.q), 1) < '8' THEN n.ids ELSE o.ids END AS ids FROM (" + LISTS.format(t=0.2) + ") o JOIN (" + LISTS.format(t=0.4) + ") n ON n.q = o.q",
    "er_block_floors": b.with_(*BASE) + "SELECT q, c, source FROM wc WHERE sim >= 0.2 AND rn <= 5 UNION SELECT q, c, source FROM wa WHERE sim >= 0.3 AND rn <= 5",
    "er_reduction_ratio": b.with_(*BASE)
    + UNION
    + "SELECT candidates, comparisons, round(1.0 - candidates / comparisons::DOUBLE, 6) AS reduction_ratio FROM (SELECT count(*) AS candidates FROM cand), (SELECT sum(a * o)::BIGINT AS comparisons FROM (SELECT country, count(*) FILTER (source = 'S1') AS a, count(*) FILTER (source <> 'S1') AS o FROM ent GROUP BY country))",
    "er_eval_by_country": b.with_(*BASE)
    + UNION
    + f", w AS (SELECT country, c.q, c.c FROM cand c JOIN ent ON entity_id = c.q), t AS (SELECT country, count(*) AS n_true, count(w.c) AS tp FROM (SELECT truth.*, country FROM truth JOIN ent ON entity_id = truth.q) x LEFT JOIN w USING (country, q, c) GROUP BY country) SELECT e.country, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp, round(tp / n_true::DOUBLE, 6) AS recall, coalesce(k.n, 0) AS candidates, e.n AS entities FROM (SELECT country, count(*) AS n FROM ent WHERE source = 'S1' GROUP BY country) e LEFT JOIN t USING (country) LEFT JOIN (SELECT country, count(*) AS n FROM w GROUP BY country) k USING (country)",
    "er_submission_faults": "SELECT unnest(['missing entity', 'repeated entity', 'wrong source', 'unknown id', 'repeated id']) AS fault, 0::BIGINT AS n",
    "er_prune": S + "SELECT q, c, p FROM scores QUALIFY row_number() OVER (PARTITION BY q ORDER BY p DESC, c) <= 3",
}
