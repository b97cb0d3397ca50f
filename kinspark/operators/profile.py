"""Profiles and integrity checks of record files and truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.functions import similarity as sim
from kinspark.functions import tables, text
from kinspark.functions.tokens import padded_trigrams


def file_profile(records: DataFrame) -> DataFrame:
    """One row a source: rows, repeated ids, empty fields, countries, lengths of names and addresses."""
    repeated = records.groupBy("source", "entity_id").count().where("count > 1").groupBy("source").agg(F.count(F.lit(1)).alias("repeated_ids"))
    n, a = F.length("business_name"), F.length("business_address")
    made = records.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("country").alias("n_countries"),
        F.sum((F.col("business_name") == "").cast("int")).alias("empty_names"),
        F.sum((F.col("business_address") == "").cast("int")).alias("empty_addresses"),
        F.round(F.avg(n), 6).alias("name_mean"),
        F.round(F.percentile(n, F.lit(0.5)), 6).alias("name_median"),
        F.max(n).alias("name_max"),
        F.round(F.avg(a), 6).alias("addr_mean"),
        F.round(F.percentile(a, F.lit(0.5)), 6).alias("addr_median"),
        F.max(a).alias("addr_max"),
    )
    return made.join(repeated, "source", "left").fillna(0, ["repeated_ids"])


def script_mix(records: DataFrame, column: str = "business_name") -> DataFrame:
    """Rows by source and script."""
    return records.groupBy("source", text.script_of(column).alias("script")).agg(F.count(F.lit(1)).alias("n"))


def country_mix(records: DataFrame) -> DataFrame:
    """Rows by source and country, with totals (rollup)."""
    return records.rollup("source", "country").agg(F.count(F.lit(1)).alias("n_rows")).select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("country", F.lit("all")).alias("country"), "n_rows")


def truth_structure(truth: DataFrame, queries: DataFrame) -> DataFrame:
    """Entities by number of matches, their share and the share up to there; of those, with matches in both other sources or in one only."""
    sized = queries.select("q").join(truth.groupBy("q").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("c").startswith("S2").cast("int")).alias("s2"), F.max(F.col("c").startswith("S3").cast("int")).alias("s3")), "q", "left").fillna(0)
    rows = sized.groupBy("k").agg(F.count(F.lit(1)).alias("entities"), F.sum(F.col("s2") * F.col("s3")).alias("in_both"), F.sum(F.col("s2") * (1 - F.col("s3"))).alias("s2_only"), F.sum(F.col("s3") * (1 - F.col("s2"))).alias("s3_only"))
    up_to = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # a row for each size of match list
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("entities").over(whole)
    return rows.select("k", "entities", "in_both", "s2_only", "s3_only", F.round(F.col("entities") / total, 6).alias("share"), F.round(F.sum("entities").over(up_to) / total, 6).alias("share_up_to"))


def truth_sizes(truth: DataFrame, queries: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """One row: entities, mean and greatest number of matches, and its percentiles by nearest rank, read off the histogram."""
    sizes = queries.select("q").join(truth.groupBy("q").agg(F.count(F.lit(1)).alias("k")), "q", "left").fillna(0)
    rows = sizes.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.count(F.lit(1)).alias("entities"))
    up_to = F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))  # a row for each size of match list
    ranked = rows.withColumn("up_to", up_to).join(F.broadcast(total), F.lit(True))  # one row
    rank = lambda s: F.least(F.floor(F.col("entities") * F.lit(s)), F.col("entities") - 1)
    return ranked.agg(
        F.max("entities").alias("entities"),
        F.round(F.sum(F.col("k") * F.col("n")) / F.sum("n"), 6).alias("mean"),
        *(F.min(F.when(F.col("up_to") > rank(s), F.col("k"))).alias(f"p{round(s * 100)}") for s in shares),
        F.max("k").alias("most"),
    )


def _pair_similarities(truth: DataFrame, records: DataFrame) -> DataFrame:
    """``q, c, n, a``: trigram Jaccard of names and addresses of true pairs."""
    forms = records.select("entity_id", padded_trigrams("name_norm").alias("gn"), padded_trigrams("addr_norm").alias("ga"))
    side = lambda key, i: forms.select(F.col("entity_id").alias(key), *(F.col(c).alias(f"{c}{i}") for c in ("gn", "ga")))
    met = truth.join(side("q", 1), "q").join(side("c", 2), "c")
    return met.select("q", "c", sim.jaccard(F.col("gn1"), F.col("gn2")).alias("n"), sim.jaccard(F.col("ga1"), F.col("ga2")).alias("a"))


def pair_quantiles(truth: DataFrame, records: DataFrame, shares: tuple[float, ...] = (0.01, 0.05, 0.25, 0.5, 0.75)) -> DataFrame:
    """``share, name, addr``: quantiles of the similarities of true pairs."""
    own = _pair_similarities(truth, records).agg(*(F.percentile(c, F.array(*map(F.lit, shares))).alias(c) for c in ("n", "a")))
    rows = F.arrays_zip(F.array(*map(F.lit, shares)).alias("share"), F.col("n").alias("name"), F.col("a").alias("addr"))
    return own.select(F.explode(rows).alias("x")).select("x.share", F.round("x.name", 6).alias("name"), F.round("x.addr", 6).alias("addr"))


def unlike_pairs(truth: DataFrame, records: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` true pairs that are least alike: ``q, c, n, a``, by the larger of both similarities."""
    own = _pair_similarities(truth, records).select("q", "c", F.round("n", 6).alias("n"), F.round("a", 6).alias("a"))
    return own.orderBy(F.greatest("n", "a"), "q", "c").limit(k)


def script_agreement(truth: DataFrame, records: DataFrame, column: str = "business_name") -> DataFrame:
    """True pairs by the scripts of both sides."""
    own = records.select("entity_id", text.script_of(column).alias("s"))
    met = truth.join(own.select(F.col("entity_id").alias("q"), F.col("s").alias("script1")), "q").join(own.select(F.col("entity_id").alias("c"), F.col("s").alias("script2")), "c")
    return met.groupBy("script1", "script2").agg(F.count(F.lit(1)).alias("pairs"))


def reachability(truth: DataFrame, records: DataFrame, levels: tuple[float, ...] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Shares of true pairs within reach of a similarity, for each of ``levels``: by name, by address, by either, by neither, and
    those that only the address rescues."""
    own = _pair_similarities(truth, records)
    share = lambda test: F.round(F.avg(test.cast("double")), 6)
    each = own.agg(*(
        F.struct(F.lit(t).alias("level"), share(n).alias("by_name"), share(a).alias("by_addr"), share(n | a).alias("by_either"), share(~(n | a)).alias("unreachable"), F.sum((a & ~n).cast("long")).alias("rescued")).alias(f"l{i}")
        for i, t in enumerate(levels)
        for n, a in [(F.col("n") >= t, F.col("a") >= t)]
    ))
    return each.select(F.explode(F.array(*(F.col(f"l{i}") for i in range(len(levels))))).alias("x")).select("x.*")


def pair_similarity(truth: DataFrame, records: DataFrame) -> DataFrame:
    """Agreement of true pairs: country, and name and address trigram Jaccard (mean and share of 0.5 or more)."""
    forms = records.select("entity_id", "country", padded_trigrams("name_norm").alias("gn"), padded_trigrams("addr_norm").alias("ga"))
    side = lambda key, i: forms.select(F.col("entity_id").alias(key), *(F.col(c).alias(f"{c}{i}") for c in ("country", "gn", "ga")))
    met = truth.join(side("q", 1), "q").join(side("c", 2), "c")
    scored = met.select((F.col("country1") == F.col("country2")).cast("double").alias("same"), sim.jaccard(F.col("gn1"), F.col("gn2")).alias("n"), sim.jaccard(F.col("ga1"), F.col("ga2")).alias("a"))
    return scored.agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg("same"), 6).alias("same_country"), F.round(F.avg("n"), 6).alias("name_mean"), F.round(F.avg("a"), 6).alias("addr_mean"),
        F.round(F.avg((F.col("n") >= 0.5).cast("double")), 6).alias("name_half"), F.round(F.avg((F.col("a") >= 0.5).cast("double")), 6).alias("addr_half"),
    )


def integrity(truth: DataFrame, records: DataFrame) -> DataFrame:
    """``check_name, faults, passed``: repeats, prefixes, one owner, dangling ids on both sides, country agreement."""
    count = lambda df, name: df.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("faults"))
    known = records.select("entity_id", "country")
    q, c = known.select(F.col("entity_id").alias("q"), F.col("country").alias("cq")), known.select(F.col("entity_id").alias("c"), F.col("country").alias("cc"))
    out = (
        count(truth.groupBy("q", "c").count().where("count > 1"), "repeated pair")
        .union(count(truth.where(~F.col("c").rlike("^S[23]-")), "wrong prefix"))
        .union(count(truth.groupBy("c").agg(F.count_distinct("q").alias("n")).where("n > 1"), "several owners"))
        .union(count(truth.join(c, "c", "left_anti"), "dangling match"))
        .union(count(truth.join(q, "q", "left_anti"), "dangling entity"))
        .union(count(truth.join(q, "q").join(c, "c").where("cq <> cc"), "country differs"))
        .union(count(records.groupBy("entity_id").count().where("count > 1"), "repeated id"))
    )
    return out.withColumn("passed", F.col("faults") == 0)


def script_histogram(records: DataFrame, column: str = "business_name", k: int = 10) -> DataFrame:
    """The ``k`` most frequent scripts; one that has no name here goes by its block of 256 code points, as U+1Fxx."""
    inside = "".join(rf"\x{{{a:X}}}-\x{{{z:X}}}" for _, a, z in tables.SCRIPTS)
    first = F.regexp_extract(column, rf"[\p{{L}}&&[^{inside}]]", 0)
    block = F.concat(F.lit("U+"), F.lpad(F.hex(F.shiftright(F.ascii(first), 8)), 2, "0"), F.lit("xx"))
    script = F.when(text.script_of(column) == "other", block).otherwise(text.script_of(column))
    return records.groupBy(script.alias("script")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "script").limit(k)
