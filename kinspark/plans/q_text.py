"""Queries of the text functions and term statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.functions import tables, text, tokens
from kinspark.functions.unicode import fold
from kinspark.plans import bridge as b

ENT, NORM, with_ = b.ENT, b.NORM, b.with_


def er_norm_pipeline(spark, d) -> DataFrame:
    return b.normalised(spark, d).select("entity_id", "name_norm", "addr_norm")


def er_blocking_text(spark, d) -> DataFrame:
    """Phonetic form, skeleton, sorted key and numbers of the normal forms."""
    own = b.normalised(spark, d)
    return own.select(
        "entity_id",
        text.phonetic("name_norm").alias("name_phonetic"),
        text.skeleton("name_norm").alias("name_skeleton"),
        text.sorted_tokens(text.combo("name_norm", "addr_norm")).alias("sorted_key"),
        F.array_join(text.numeric_tokens("addr_norm"), ",").alias("numbers"),
    )


def er_blocking_key(spark, d) -> DataFrame:
    """The country-free phonetic key of name and address."""
    return b.entities(spark, d).select("entity_id", text.blocking_key("business_name", fold).alias("name_key"), text.blocking_key("business_address", fold).alias("addr_key"))


def er_normalised_cache(spark, d) -> DataFrame:
    """The whole cache row, with transliteration on (an Arrow UDF)."""
    e = b.entities(spark, d).withColumn("name_latin", fold("business_name")).withColumn("addr_latin", fold("business_address"))
    return e.select(
        "entity_id",
        "country",
        text.normalize("name_latin", "country").alias("name_norm"),
        text.normalize("addr_latin", "country").alias("addr_norm"),
        text.blocking_key("name_latin").alias("name_key"),
        text.blocking_key("addr_latin").alias("addr_key"),
        text.script_of("business_name").alias("script"),
    )


def er_script(spark, d) -> DataFrame:
    return b.entities(spark, d).select("entity_id", text.script_of("business_name").alias("script"))


def er_char_ngrams(spark, d) -> DataFrame:
    own = b.normalised(spark, d)
    return own.select("country", F.explode(tokens.char_ngrams("name_norm")).alias("term")).groupBy("country", "term").agg(F.count(F.lit(1)).alias("tf"))


def er_padded_trigrams(spark, d) -> DataFrame:
    return b.normalised(spark, d).select("entity_id", F.size(tokens.padded_trigrams("name_norm")).cast("long").alias("n_grams"), F.md5(F.array_join(F.array_sort(tokens.padded_trigrams("name_norm")), "|")).alias("grams_md5"))


def _combo(spark, d) -> DataFrame:
    return b.normalised(spark, d).select("entity_id", "source", "country", tokens.words(text.combo("name_norm", "addr_norm")).alias("terms"))


def er_word_df(spark, d) -> DataFrame:
    return tokens.document_frequency(_combo(spark, d), "terms", ("country",))


def er_idf(spark, d) -> DataFrame:
    own = b.normalised(spark, d).select("entity_id", text.tokens(text.combo("name_norm", "addr_norm")).alias("terms"))
    return tokens.feature_idf(own, "terms").select("term", F.round("idf", 6).alias("idf"))


def er_tfidf_weights(spark, d) -> DataFrame:
    w = tokens.tfidf(_combo(spark, d).where("source <> 'S1'"), "terms", "entity_id", ("country", "source"), max_df=0.05)
    return w.select("entity_id", "term", F.round("w", 6).alias("w"))


def er_tfidf_max_features(spark, d) -> DataFrame:
    """Weights over the 300 most frequent terms of each country and source."""
    w = tokens.tfidf(_combo(spark, d).where("source <> 'S1'"), "terms", "entity_id", ("country", "source"), max_features=300)
    return w.select("entity_id", "term", F.round("w", 6).alias("w"))


def er_norm_plain(spark, d) -> DataFrame:
    """The older normaliser: neither canonical spellings nor dropped words."""
    made = lambda c: text.normalize(c, fold=fold, **text.NORMALISERS["plain"])
    return b.entities(spark, d).select("entity_id", made("business_name").alias("name_norm"), made("business_address").alias("addr_norm"))


QUERIES = {f.__name__: f for f in (er_norm_pipeline, er_blocking_text, er_blocking_key, er_normalised_cache, er_script, er_char_ngrams, er_padded_trigrams, er_word_df, er_idf, er_tfidf_weights, er_tfidf_max_features, er_norm_plain)}


def _phonetic(x: str) -> str:
    for a, c in tables.PHONETIC:
        x = f"replace({x}, '{a}', '{c}')"
    return x


def _skeleton(x: str) -> str:
    w = "w"
    for a, c in tables.SKELETON_PAIRS:
        w = f"replace({w}, '{a}', '{c}')"
    w = f"regexp_replace(translate({w}, '{tables.SKELETON_FROM}', '{tables.SKELETON_TO}'), '[aeiou]', '', 'g')"
    folded = f"list_transform(list_filter(string_split({x}, ' '), lambda w: w <> ''), lambda w: {w})"
    runs = f"list_transform({folded}, lambda y: {b.collapse('y')})"
    return f"array_to_string(list_filter({runs}, lambda w: w <> ''), ' ')"


def _script(x: str) -> str:
    letters = rf"regexp_replace({x}, '[^\p{{L}}]', '', 'g')"
    span = lambda a, z: rf"\x{{{a:X}}}-\x{{{z:X}}}"
    rows = [f"{{'n': length(regexp_replace(l, '[^{span(a, z)}]', '', 'g')), 'at': -length(regexp_extract(l, '^[^{span(a, z)}]*')), 'name': '{n}'}}" for n, a, z in tables.SCRIPTS]
    inside = "".join(span(a, z) for _, a, z in tables.SCRIPTS)
    rows.append(f"{{'n': length(regexp_replace(l, '[{inside}]', '', 'g')), 'at': -length(regexp_extract(l, '^[{inside}]*')), 'name': 'other'}}")
    return f"(SELECT CASE WHEN l = '' THEN 'none' ELSE list_max([{', '.join(rows)}]).name END FROM (SELECT {letters} AS l))"


def _plain(x: str) -> str:
    low = f"regexp_replace(lower(strip_accents(replace({x}, 'ß', 'ss'))), '[^a-z0-9 ]+', ' ', 'g')"
    null = ", ".join(f"'{v}'" for v in tables.NULLISH)
    return rf"CASE WHEN trim(lower({x})) IN ({null}) THEN '' ELSE trim(regexp_replace({b.collapse(low)}, '\s+', ' ', 'g')) END"


def _key_ctes() -> str:
    """NORM with every country taken as one without short variants, and phonetic."""
    return NORM.replace("CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'France' ELSE lang END AS country", "'none' AS country")


TERMS = "post_t AS (SELECT entity_id, source, country, unnest(list_filter(string_split(trim(name_norm || ' ' || addr_norm), ' '), lambda t: length(t) >= 2)) AS term FROM norm)"

ORACLE = {
    "er_norm_pipeline": with_(NORM) + "SELECT entity_id, name_norm, addr_norm FROM norm",
    "er_blocking_text": with_(NORM)
    + rf"""SELECT entity_id, {_phonetic('name_norm')} AS name_phonetic, {_skeleton('name_norm')} AS name_skeleton,
  array_to_string(list_sort(list_filter(string_split(trim(name_norm || ' ' || addr_norm), ' '), lambda t: t <> '')), ' ') AS sorted_key,
  coalesce(array_to_string((SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(n) AS x, generate_subscripts(n, 1) AS i FROM (SELECT regexp_extract_all(addr_norm, '\d+') AS n)) GROUP BY x)), ','), '') AS numbers FROM norm""",
    "er_blocking_key": with_(_key_ctes()) + f"SELECT entity_id, {_phonetic('name_norm')} AS name_key, {_phonetic('addr_norm')} AS addr_key FROM norm",
    "er_normalised_cache": f"SELECT n.entity_id, n.country, name_norm, addr_norm, name_key, addr_key, script FROM ({with_(NORM)} SELECT entity_id, country, name_norm, addr_norm FROM norm) n JOIN ({with_(_key_ctes())} SELECT entity_id, {_phonetic('name_norm')} AS name_key, {_phonetic('addr_norm')} AS addr_key FROM norm) k USING (entity_id) JOIN ({with_(ENT)} SELECT entity_id, {_script('business_name')} AS script FROM ent) s USING (entity_id)",
    "er_script": with_(ENT) + f"SELECT entity_id, {_script('business_name')} AS script FROM ent",
    "er_char_ngrams": with_(NORM)
    + """SELECT country, term, count(*) AS tf FROM (SELECT country, unnest(CASE WHEN length(w) <= 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) END) AS term
  FROM (SELECT country, ' ' || unnest(list_filter(string_split(name_norm, ' '), lambda t: t <> '')) || ' ' AS w FROM norm)) GROUP BY ALL""",
    "er_padded_trigrams": with_(NORM)
    + """SELECT entity_id, len(g)::BIGINT AS n_grams, md5(array_to_string(list_sort(g), '|')) AS grams_md5 FROM (SELECT entity_id, CASE WHEN name_norm = '' THEN [] ELSE list_distinct(list_transform(range(1, length(name_norm) + 2), lambda i: substr('  ' || name_norm || ' ', i, 3))) END AS g FROM norm)""",
    "er_word_df": with_(NORM, TERMS) + "SELECT country, term, count(DISTINCT entity_id) AS df FROM post_t GROUP BY ALL",
    "er_norm_plain": with_(ENT)
    + f"SELECT entity_id, {_plain('business_name')} AS name_norm, {_plain('business_address')} AS addr_norm FROM ent",
    "er_tfidf_max_features": with_(NORM, TERMS)
    + """, t AS (SELECT * FROM post_t WHERE source <> 'S1'), n AS (SELECT country, source, count(*) AS n FROM norm GROUP BY ALL),
df AS (SELECT country, source, term, count(DISTINCT entity_id) AS df FROM t GROUP BY country, source, term QUALIFY row_number() OVER (PARTITION BY country, source ORDER BY count(*) DESC, term) <= 300),
idf AS (SELECT country, source, term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM df JOIN n USING (country, source)),
x AS (SELECT entity_id, term, count(*) * any_value(idf) AS x FROM t JOIN idf USING (country, source, term) GROUP BY ALL)
SELECT entity_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY entity_id)), 6) AS w FROM x""",
    "er_idf": with_(NORM)
    + """SELECT term, round(ln((SELECT count(*) FROM norm) / (1 + count(DISTINCT entity_id))::DOUBLE), 6) AS idf FROM (SELECT entity_id, unnest(list_filter(string_split(trim(name_norm || ' ' || addr_norm), ' '), lambda t: t <> '')) AS term FROM norm) GROUP BY term""",
    "er_tfidf_weights": with_(NORM, TERMS)
    + """, t AS (SELECT * FROM post_t WHERE source <> 'S1'), n AS (SELECT country, source, count(*) AS n FROM norm GROUP BY ALL),
df AS (SELECT country, source, term, count(DISTINCT entity_id) AS df FROM t GROUP BY ALL),
idf AS (SELECT country, source, term, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM df JOIN n USING (country, source) WHERE df <= greatest(2.0, floor(0.05 * n))),
x AS (SELECT entity_id, term, count(*) * any_value(idf) AS x FROM t JOIN idf USING (country, source, term) GROUP BY ALL)
SELECT entity_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY entity_id)), 6) AS w FROM x""",
}
