"""Queries of readers, writers and models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.operators import decide, metrics, model, vector
from kinspark.plans import bridge as b
from kinspark.plans.q_blocking import EVERY
from kinspark.plans.q_features import token_idf
from kinspark.plans.q_metrics import LAB, T
from kinspark.sources import files


def _lines(spark, d) -> DataFrame:
    """Record lines, every seventh a field short and every eleventh one long."""
    e = b.entities(spark, d)
    n = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long")
    return e.select(F.when(n % 7 == 0, F.concat_ws("\t", "entity_id", "business_name", "country")).when(n % 11 == 0, F.concat_ws("\t", "entity_id", "business_name", "business_address", "country", F.lit("x"))).otherwise(F.concat_ws("\t", "entity_id", "business_name", "business_address", "country")).alias("value"))


def io_tsv_scan(spark, d) -> DataFrame:
    return files.split_lines(_lines(spark, d))


def io_tsv_malformed(spark, d) -> DataFrame:
    return files.malformed(_lines(spark, d))


def io_wide_long_roundtrip(spark, d) -> DataFrame:
    """Long to wide to lines and back to long."""
    everyone = b.entities(spark, d).where("source = 'S1'").select(F.col("entity_id").alias("q"))
    wide = files.to_wide(everyone, b.truth(spark, d))
    return files.to_long(files.split_lists(wide.select(F.concat_ws("\t", "q", "ids").alias("value"))))


def io_candidate_lists(spark, d) -> DataFrame:
    everyone = b.entities(spark, d).where("source = 'S1'").select(F.col("entity_id").alias("q"))
    return files.to_wide(everyone, b.pairs(spark, d).select("q", "c"))


def io_sharding(spark, d) -> DataFrame:
    own = files.shard(b.entities(spark, d).select(F.col("entity_id").alias("q"), "country"))
    return own.groupBy("country", "shard").agg(F.count(F.lit(1)).alias("n"))


def io_count_rows(spark, d) -> DataFrame:
    return files.count_rows(b.read(spark, d, "lineitem"))


def io_load(spark, d) -> DataFrame:
    return files.load(spark, f"{d}/nation.parquet")


def io_fingerprint(spark, d) -> DataFrame:
    return files.fingerprint(b.read(spark, d, "nation"))


def io_peek(spark, d) -> DataFrame:
    return files.peek(b.read(spark, d, "nation"), 5)


def io_list_data(spark, d) -> DataFrame:
    return files.list_data(spark, d)


def io_training_rows(spark, d) -> DataFrame:
    """The rows of the rescorer's training file: every pair of the band, and easy ones."""
    scored = model.label(b.scores(spark, d).select("q", "c", "p"), b.truth(spark, d))
    return model.rescorer_rows(scored, b.normalised(spark, d), 0.2, 0.8, 40)


def er_entity_split(spark, d) -> DataFrame:
    """Rows and entities on either side of the split by entity (no entity is on both)."""
    own = model.split(b.pairs(spark, d).select("q", "c"))
    return own.groupBy("validation").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("q").alias("entities"))


def er_query_sample(spark, d) -> DataFrame:
    return model.sample_queries(b.entities(spark, d).where("source = 'S1'"), 5).select("entity_id", "country")


def _vector(spark, d) -> DataFrame:
    """``q, c, label, vector``: all features, absolute and relative, 79 numbers a pair."""
    labelled = model.label(b.pairs(spark, d).select("q", "c", "source"), b.truth(spark, d))
    return vector.pair_vectors(labelled, b.normalised(spark, d), token_idf(spark, d), ("label",))


def _held_out(spark, d) -> DataFrame:
    """Pairs of held-out entities with their label and the score ``p`` of trees that stopped early on them."""
    return b.kept(spark, d, "held-out", _fitted)


def _fitted(spark, d) -> DataFrame:
    """The vector is written once: trees read it often, and each of their jobs would carry its whole lineage, which the driver keeps."""
    own, path = b.stored(_vector(spark, d), "vector")
    rows = model.split(own).withColumn("features", array_to_vector("vector")).drop("vector")
    scores, _ = b.stored(model.score(model.fit(rows, model.PRESETS["v2"]), rows.where("validation")).select("q", "c", "label", "p"), "held-out")
    b.drop(spark, path)
    return scores


def er_gbt_scores(spark, d) -> DataFrame:
    """Scores of boosted trees for the pairs of held-out entities; all 79 features, the published preset, early stop."""
    return _held_out(spark, d).select("q", "c", "label", F.round("p", 6).alias("p"))


def er_pipeline_gbt(spark, d) -> DataFrame:
    """End to end on held-out entities: block, 79 features, boosted trees, rescored band, one owner a record, macro F0.5."""
    scored = model.cascade(_held_out(spark, d).select("q", "c", "p"), b.normalised(spark, d), model.ratio_rescorer()).select("q", "c", "p")
    asked = model.split(b.entities(spark, d).where("source = 'S1'").select(F.col("entity_id").alias("q"))).where("validation").select("q")
    chosen = decide.exclusive(decide.flat(scored, 0.5))
    return metrics.macro_f_half(chosen, b.truth(spark, d).join(asked, "q", "left_semi"), asked)


def er_cascade(spark, d) -> DataFrame:
    """The band rescored by the text rescorer, then one owner a record."""
    scored = b.scores(spark, d).select("q", "c", "p")
    return decide.exclusive(model.cascade(scored, b.normalised(spark, d), model.ratio_rescorer()).select("q", "c", "p")).select("q", "c", F.round("p", 6).alias("p"))


def stream_windowed_counts(spark, d) -> DataFrame:
    """The watermarked window count, on a bounded read."""
    from kinspark.streaming.ingest import windowed_counts

    return windowed_counts(b.read(spark, d, "events"))


QUERIES = {
    f.__name__: f
    for f in (io_tsv_scan, io_tsv_malformed, io_wide_long_roundtrip, io_candidate_lists, io_sharding, io_count_rows, io_load, io_fingerprint, io_peek, io_list_data, io_training_rows, er_entity_split, er_query_sample, er_gbt_scores, er_pipeline_gbt, er_cascade, stream_windowed_counts)
}

E_ = b.with_(b.ENT)
LINES = ", lines AS (SELECT CASE WHEN n % 7 = 0 THEN concat_ws(chr(9), entity_id, business_name, country) WHEN n % 11 = 0 THEN concat_ws(chr(9), entity_id, business_name, business_address, country, 'x') ELSE concat_ws(chr(9), entity_id, business_name, business_address, country) END AS value FROM (SELECT *, split_part(entity_id, '-', 2)::BIGINT AS n FROM ent))"
ORACLE = {
    "io_tsv_scan": E_ + LINES + " SELECT p[1] AS entity_id, p[2] AS business_name, p[3] AS business_address, p[4] AS country FROM (SELECT string_split(value, chr(9)) AS p FROM lines) WHERE len(p) >= 4",
    "io_tsv_malformed": E_ + LINES + " SELECT count(*) AS n_lines, sum((len(p) < 4)::INT)::BIGINT AS n_short, sum((len(p) > 4)::INT)::BIGINT AS n_long FROM (SELECT string_split(value, chr(9)) AS p FROM lines)",
    "io_wide_long_roundtrip": b.with_(b.ENT, b.TRUTH) + "SELECT q, c FROM truth",
    "io_candidate_lists": T + f"SELECT e.q, coalesce(ids, '') AS ids FROM {EVERY} e LEFT JOIN (SELECT q, string_agg(c, ',' ORDER BY c) AS ids FROM pairs GROUP BY q) USING (q)",
    "io_count_rows": "SELECT count(*) AS n_rows FROM lineitem",
    "io_load": "SELECT * FROM nation",
    "io_peek": "SELECT * FROM nation LIMIT 5",
    "io_fingerprint": "SELECT count(*) AS n_rows, left(md5('n_nationkey,n_name,n_regionkey|' || count(*) || '|' || sum(('0x' || left(md5(concat_ws('|', n_nationkey, n_name, n_regionkey)), 15))::HUGEINT)), 12) AS fingerprint FROM nation",
    "er_entity_split": b.with_(b.NORM, b.PAIRS) + "SELECT ('0x' || left(md5('42|' || q), 15))::BIGINT % 100 >= 75 AS validation, count(*) AS pairs, count(DISTINCT q) AS entities FROM pairs GROUP BY 1",
    "er_query_sample": E_ + "SELECT entity_id, country FROM ent WHERE source = 'S1' QUALIFY row_number() OVER (PARTITION BY country ORDER BY md5('42|' || entity_id), entity_id) <= 5",
    "io_training_rows": T
    + LAB
    + """, x AS (SELECT *, (p >= 0.2 AND p < 0.8)::INT AS in_band FROM lab), k AS (SELECT * FROM x WHERE in_band = 1 UNION ALL SELECT * FROM (SELECT * FROM x WHERE in_band = 0 QUALIFY row_number() OVER (PARTITION BY y ORDER BY md5(q || '|' || c), q, c) <= 20))
SELECT k.q AS s1_id, k.c AS cand_id, l.name_norm || ' | ' || l.addr_norm AS text_a, r.name_norm || ' | ' || r.addr_norm AS text_b, y AS label, p AS stage1, in_band FROM k JOIN norm l ON l.entity_id = k.q JOIN norm r ON r.entity_id = k.c""",
    "stream_windowed_counts": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
