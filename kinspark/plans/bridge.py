"""Entity-resolution inputs made from the star-schema tables, in Spark and, word for word, in SQL.

``entities``: documents as business records (three sources, language as country). Of all distinct words of a
whole text, in order of their MD5, the first six are the name and the next twelve the address: a bottom-k sketch,
in which texts meet as far as they share words, wherever those stand. ``truth``: records of source 2 or 3 with the text of a source-1 entity, each owned by the least such
entity. ``pairs``: candidates that share a rare token. ``scores``: a score for each candidate pair.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.functions import tables, text
from kinspark.functions.tokens import words
from kinspark.functions.unicode import fold

RARE = 40


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``entity_id, source, country, business_name, business_address, text_md5``."""
    words = F.array_distinct(F.filter(F.split(F.regexp_replace("text", r"[ \t\n\f\r]+", " "), " "), lambda t: t != ""))
    ordered = F.array_sort(F.transform(words, lambda t: F.concat(F.md5(t), t)))
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.transform(F.slice(ordered, 1, 18), lambda t: F.substring(t, 33, 1 << 30)).alias("sketch"))
    source = F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"))
    country = F.when(F.col("lang") == "en", "US").when(F.col("lang") == "fr", "France").otherwise(F.col("lang"))
    return docs.select(
        F.concat_ws("-", source, "doc_id").alias("entity_id"),
        source.alias("source"),
        country.alias("country"),
        F.array_join(F.slice("sketch", 1, 6), " ").alias("business_name"),
        F.array_join(F.slice("sketch", 7, 12), " ").alias("business_address"),
        F.md5("text").alias("text_md5"),
    )


_KEPT: dict[tuple[str, str, str], DataFrame] = {}


def release() -> None:
    """Give back what :func:`kept` holds."""
    for frame in _KEPT.values():
        frame.unpersist()
    _KEPT.clear()


def kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A frame that many queries start from, persisted once for each session and input (lineage rebuilds lost blocks)."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _KEPT or not _KEPT[key].is_cached:
        _KEPT[key] = build(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)
    return _KEPT[key]


def stored(frame: DataFrame, label: str) -> tuple[DataFrame, str]:
    """A frame written below ``spark.checkpoint.dir`` (on one machine without one, in a local folder) and read back, which cuts its lineage; and its path."""
    spark = frame.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='kinspark-')}"
    path = f"{shared.rstrip('/')}/kinspark/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete what :func:`stored` wrote."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(own, True)


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with ``name_norm, addr_norm`` (short variants by country)."""
    return kept(spark, sf_dir, "normalised", _normalised)


def _normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities(spark, sf_dir).select("entity_id", "source", "country", "text_md5", text.normalize("business_name", "country", fold=fold).alias("name_norm"), text.normalize("business_address", "country", fold=fold).alias("addr_norm"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``q, c``: each record of source 2 or 3 with the least source-1 entity of its text."""
    own = entities(spark, sf_dir).select("entity_id", "source", "text_md5")
    owner = own.where("source = 'S1'").groupBy("text_md5").agg(F.min("entity_id").alias("q"))
    return own.where("source <> 'S1'").join(owner, "text_md5").select("q", F.col("entity_id").alias("c"))


def pairs_of(records: DataFrame, rare: int = RARE) -> DataFrame:
    """``q, c, source, n1, a1, n2, a2`` of source-1 entities and other records of one country that share a token of at most ``rare`` records."""
    terms = F.array_distinct(words(text.combo("name_norm", "addr_norm")))
    post = records.select("country", "entity_id", "source", F.explode(terms).alias("term"))
    scarce = post.groupBy("country", "term").agg(F.count(F.lit(1)).alias("df")).where((F.col("df") >= 2) & (F.col("df") <= rare)).select("country", "term")
    post = post.join(scarce, ["country", "term"])
    q = post.where("source = 'S1'").select("country", "term", F.col("entity_id").alias("q"))
    c = post.where("source <> 'S1'").select("country", "term", F.col("entity_id").alias("c"), "source")
    met = q.join(c, ["country", "term"]).select("q", "c", "source").distinct()
    left = records.select(F.col("entity_id").alias("q"), F.col("name_norm").alias("n1"), F.col("addr_norm").alias("a1"))
    right = records.select(F.col("entity_id").alias("c"), F.col("name_norm").alias("n2"), F.col("addr_norm").alias("a2"))
    return met.join(left, "q").join(right, "c").select("q", "c", "source", "n1", "a1", "n2", "a2")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "pairs", lambda s, d: pairs_of(normalised(s, d)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint members of two arrays without repeats; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``q, c, source, p``: the mean of both token Jaccards, to six places."""
    sets = {x: F.array_distinct(text.tokens(x)) for x in ("n1", "a1", "n2", "a2")}
    return pairs(spark, sf_dir).select("q", "c", "source", F.round((jaccard(sets["n1"], sets["n2"]) + jaccard(sets["a1"], sets["a2"])) / 2, 6).alias("p"))


# ---------------------------------------------------------------- the same in SQL

COLLAPSE = "CASE WHEN {x} = '' THEN '' ELSE list_reduce(string_split({x}, ''), lambda a, b: CASE WHEN right(a, 1) = b THEN a ELSE a || b END) END"


def collapse(x: str) -> str:
    return COLLAPSE.format(x=f"({x})")


ENT = r"""
docs_w AS (SELECT doc_id, lang, text, list_transform(list_sort(list_transform(list_distinct(list_filter(string_split_regex(text, '[ \t\n\f\r]+'), lambda t: t <> '')), lambda t: md5(t) || t))[1:18], lambda t: substr(t, 33)) AS w FROM documents),
ent AS (SELECT 'S' || (1 + doc_id % 3) || '-' || doc_id AS entity_id, 'S' || (1 + doc_id % 3) AS source,
  CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'France' ELSE lang END AS country,
  array_to_string(w[1:6], ' ') AS business_name, array_to_string(w[7:18], ' ') AS business_address, md5(text) AS text_md5 FROM docs_w)"""


def _values(short: bool) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in tables.variants(short).items())


def _norm_ctes() -> str:
    """CTEs that end in norm(entity_id, source, country, text_md5, name_norm, addr_norm)."""
    low = "regexp_replace(lower(strip_accents(replace(s, 'ß', 'ss'))), '[^a-z0-9 ]+', ' ', 'g')"  # the twin folds what Latin texts hold
    short = ", ".join(f"'{c}'" for c in tables.SHORT_COUNTRIES)
    null = ", ".join(f"'{x}'" for x in tables.NULLISH)
    unconfuse = f"CASE WHEN regexp_matches(t, '[0-9]') AND NOT regexp_matches(t, '^[0-9]+$') THEN translate(t, '{tables.CONFUSED}', '{tables.MEANT}') ELSE t END"
    singular = "CASE WHEN length({x}) > 5 AND {x} LIKE '%ies' THEN left({x}, length({x}) - 3) || 'y' WHEN length({x}) > 4 AND {x} LIKE '%s' AND NOT {x} LIKE '%ss' THEN left({x}, length({x}) - 1) ELSE {x} END"
    steps = [f"tok0 AS (SELECT DISTINCT country IN ({short}) AS sc, t AS orig, {unconfuse} AS t FROM (SELECT country, unnest(w) AS t FROM fields))"]
    for i in range(4):
        steps.append(f"tok{i}a AS (SELECT sc, orig, coalesce(v.b, t) AS t FROM tok{i} LEFT JOIN var v ON v.a = t AND v.s = sc)")
        steps.append(f"tok{i}b AS (SELECT sc, orig, {singular.format(x='t')} AS t FROM tok{i}a)")
        steps.append(f"tok{i + 1} AS (SELECT sc, orig, coalesce(v.b, t) AS t FROM tok{i}b LEFT JOIN var v ON v.a = t AND v.s = sc)")
    words_re = lambda ws: rf"\b({'|'.join(ws)})\b"
    return rf"""
fields AS (SELECT entity_id, country, f, trim(lower(s)) IN ({null}) AS empty, list_filter(string_split(regexp_replace({collapse(low)}, '\s+', ' ', 'g'), ' '), lambda t: t <> '') AS w
  FROM (SELECT entity_id, country, 'n' AS f, business_name AS s FROM ent UNION ALL SELECT entity_id, country, 'a', business_address FROM ent)),
var AS (SELECT false AS s, a, b FROM (VALUES {_values(False)}) x(a, b) UNION ALL SELECT true, a, b FROM (VALUES {_values(True)}) x(a, b)),
{', '.join(steps)},
canon AS (SELECT entity_id, f, string_agg(k.t, ' ' ORDER BY pos) AS before FROM (SELECT entity_id, country, f, unnest(w) AS t, generate_subscripts(w, 1) AS pos FROM fields) x JOIN tok4 k ON k.orig = x.t AND k.sc = (x.country IN ({short})) GROUP BY ALL),
stripped AS (SELECT fields.entity_id, fields.f, CASE WHEN empty THEN '' ELSE coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(before, ''), '{words_re(tables.LEGAL)}', ' ', 'g'), '{words_re(tables.STOP)}', ' ', 'g'), '\s+', ' ', 'g')), ''), coalesce(before, '')) END AS v FROM fields LEFT JOIN canon USING (entity_id, f)),
norm AS (SELECT ent.entity_id, source, country, text_md5, n.v AS name_norm, a.v AS addr_norm FROM ent JOIN stripped n ON n.entity_id = ent.entity_id AND n.f = 'n' JOIN stripped a ON a.entity_id = ent.entity_id AND a.f = 'a')"""


NORM = ENT + "," + _norm_ctes()

TRUTH = """
owner AS (SELECT text_md5, min(entity_id) AS q FROM ent WHERE source = 'S1' GROUP BY 1),
truth AS (SELECT q, entity_id AS c FROM ent JOIN owner USING (text_md5) WHERE source <> 'S1')"""

PAIRS = f"""
post AS (SELECT DISTINCT country, entity_id, source, unnest(list_filter(string_split(trim(name_norm || ' ' || addr_norm), ' '), lambda t: length(t) >= 2)) AS term FROM norm),
scarce AS (SELECT country, term FROM post GROUP BY ALL HAVING count(*) BETWEEN 2 AND {RARE}),
pairs AS (SELECT m.q, m.c, m.source, l.name_norm AS n1, l.addr_norm AS a1, r.name_norm AS n2, r.addr_norm AS a2
  FROM (SELECT DISTINCT x.entity_id AS q, y.entity_id AS c, y.source FROM post x JOIN scarce USING (country, term) JOIN post y USING (country, term) WHERE x.source = 'S1' AND y.source <> 'S1') m
  JOIN norm l ON l.entity_id = m.q JOIN norm r ON r.entity_id = m.c)"""


def toks(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"


def sql_jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


SCORES = f"""
scores AS (SELECT q, c, source, round(({sql_jaccard('t1', 't2')} + {sql_jaccard('s1', 's2')}) / 2, 6) AS p FROM (SELECT q, c, source, {toks('n1')} AS t1, {toks('n2')} AS t2, {toks('a1')} AS s1, {toks('a2')} AS s2 FROM pairs))"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


ALL = (NORM, TRUTH, PAIRS, SCORES)
