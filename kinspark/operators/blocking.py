"""Candidate generation: joins on shared terms or keys, with the best candidates kept for each entity and source."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.functions import text, tokens
from kinspark.operators import postings


@dataclass(frozen=True)
class Preset:
    """How terms are made and weighed. ``text``: the signals compared, columns of the records."""

    analyzer: str = "word"
    low: int = 1
    high: int = 1
    min_df: int = 1
    max_df: float = 0.05
    max_features: int | None = None
    k: int = 50
    threshold: float = 1e-6
    binary: bool = False
    signals: tuple[str, ...] = ("combo",)


PRESETS = {
    "lib": Preset("char", 2, 4, 2, 1.0, 400_000, 25, 0.02),
    "exp": Preset("char", 3, 3, 3, 1.0, 300_000, 100, 0.0),
    "prod-char": Preset("char", 3, 3, 3, 0.05, 300_000, 25, 0.0),
    "prod-word": Preset(),
    "word-v3": Preset(signals=("combo", "addr")),
    "many-core": Preset(min_df=2, max_df=1.0, max_features=2_000_000, k=100, threshold=0.0, signals=("combo", "addr", "name")),
    "kernel-char": Preset("char", 3, 3, 3, 0.05, 300_000, 50, 0.0),
    "word-count": Preset(binary=True),
}


def signal(records: DataFrame, name: str) -> DataFrame:
    """Records with the column ``signal``: combo, name or addr of the normal forms."""
    own = {"combo": text.combo("name_norm", "addr_norm"), "name": F.col("name_norm"), "addr": F.col("addr_norm")}[name]
    return records.select("entity_id", "source", "country", own.alias("signal"))


def terms(preset: Preset) -> Column:
    return tokens.words("signal") if preset.analyzer == "word" else tokens.char_ngrams("signal", preset.low, preset.high)


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("q", "source")) -> DataFrame:
    """The ``k`` rows of largest ``sim`` in each group; ties go to the lesser candidate. Adds ``rn``."""
    order = Window.partitionBy(*by).orderBy(F.desc("sim"), "c")
    return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


#: Indexed records in a block, queries in a chunk and the most chunks of a country, parts of a vocabulary.
BLOCK, CHUNK, MOST_CHUNKS, VOCABULARY_PARTS = 250_000, 1_000, 16, 256


def cosine_top_k(records: DataFrame, preset: Preset, name: str = "combo", block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``q, c, source, sim, rn``: the best ``k`` records of each other source for each source-1 entity of its country.

    Frequencies are those of the indexed side (each other source by itself); terms in more than ``max_df`` of
    its records are no terms. A cell is a block of the indexed records of a country and source, and a chunk of
    the queries there: it gets both, and the vocabulary with idf of the whole index, and sums products in memory
    (:mod:`kinspark.operators.postings`), so that what is shuffled are records and the best ``k`` a block, never
    pairs. Blocks and chunks follow from the counts; each indexed record goes to ``MOST_CHUNKS`` cells at most.
    """
    own = signal(records, name).where("country is not null and source is not null")
    counted = own.groupBy("country", "source").count().collect()  # a row for each country and source
    asked = {r["country"]: r["count"] for r in counted if r["source"] == "S1"}
    made = [(r["country"], r["source"], r["count"], -(-r["count"] // block), max(min(-(-asked[r["country"]] // chunk), MOST_CHUNKS), -(-asked[r["country"]] // block))) for r in counted if r["source"] != "S1" and r["country"] in asked]
    sizes = F.broadcast(records.sparkSession.createDataFrame(made, "country string, source string, n_docs long, blocks int, chunks int"))
    own = own.withColumn("terms", terms(preset))
    idf = tokens.smoothed_idf(own.where("source <> 'S1'"), "terms", ("country", "source"), preset.min_df, preset.max_df, preset.max_features, sizes.select("country", "source", "n_docs"))
    spelled = idf.groupBy("country", "source", F.pmod(F.xxhash64("term"), F.lit(VOCABULARY_PARTS)).alias("part")).agg(F.collect_list(F.struct("term", "idf")).alias("all"))
    spelled = spelled.select("country", "source", F.lit("").alias("entity_id"), F.lit(postings.VOCABULARY).alias("side"), F.array_join("all.term", postings.SEPARATOR).alias("texts"), F.col("all.idf").alias("idf"))
    held = own.select("country", "source", "entity_id", F.when(F.col("source") == "S1", postings.ASKED).otherwise(postings.INDEXED).alias("side"), F.array_join("terms", postings.SEPARATOR).alias("texts"), F.lit(None).cast("array<double>").alias("idf"))

    def places(side: int, n: str) -> Column:
        """The blocks or chunks a row goes to: all of them, or for rows of this side the one by hash."""
        own_part = F.pmod(F.xxhash64("entity_id"), F.col(n)).cast("int")
        return F.explode(F.when(F.col("side") == side, F.array(own_part)).otherwise(F.sequence(F.lit(0), F.col(n) - 1)))

    targets = sizes.withColumnRenamed("source", "target")
    meets = (held["country"] == targets["country"]) & ((held["source"] == "S1") | (held["source"] == targets["target"]))
    rows = held.join(targets, meets).drop(targets["country"]).unionByName(spelled.join(sizes.withColumn("target", F.col("source")), ["country", "source"]), allowMissingColumns=True)
    rows = rows.withColumn("at_block", places(postings.INDEXED, "blocks")).withColumn("at_chunk", places(postings.ASKED, "chunks"))
    rows = rows.select(F.concat_ws("\n", "country", "target", "at_block", "at_chunk").alias("cell"), "side", F.col("target").alias("source"), F.col("entity_id").alias("id"), F.col("texts").alias("terms"), "idf")
    dealt = rows.repartition("cell").sortWithinPartitions("cell", "side", "id")
    return top_k(dealt.mapInArrow(postings.scorer(preset.k, preset.threshold, preset.binary), postings.FOUND), preset.k)


def exact_key(records: DataFrame) -> DataFrame:
    """``q, c, source``: equal sorted tokens, in one country."""
    own = records.select("country", "entity_id", "source", text.sorted_tokens(text.combo("name_norm", "addr_norm")).alias("k")).where("k <> ''")
    q = own.where("source = 'S1'").select("country", "k", F.col("entity_id").alias("q"))
    return q.join(own.where("source <> 'S1'").select("country", "k", F.col("entity_id").alias("c"), "source"), ["country", "k"]).select("q", "c", "source")


def rare_token(records: DataFrame, most_df: int = 40, k: int = 60) -> DataFrame:
    """``q, c, source``: at least one shared token of three or more letters that few records hold; at most ``k`` a query, the least ids."""
    own = records.select("country", "entity_id", "source", F.explode(F.array_distinct(tokens.words(text.combo("name_norm", "addr_norm"), 3))).alias("term"))
    scarce = own.groupBy("country", "term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df").between(2, most_df))
    post = own.join(scarce.select("country", "term"), ["country", "term"])
    q = post.where("source = 'S1'").select("country", "term", F.col("entity_id").alias("q"))
    met = q.join(post.where("source <> 'S1'").select("country", "term", F.col("entity_id").alias("c"), "source"), ["country", "term"]).select("q", "c", "source").distinct()
    return met.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("c"))).where(F.col("rn") <= k).select("q", "c", "source")


def union_candidates(*passes: DataFrame) -> DataFrame:
    """``q, c, source`` of any pass, once."""
    out = passes[0].select("q", "c", "source")
    for more in passes[1:]:
        out = out.unionByName(more.select("q", "c", "source"))
    return out.distinct()


def build_candidates(passes: dict[str, DataFrame], floors: dict[str, float], k: int) -> DataFrame:
    """``q, c, source`` of scored passes: of each, pairs of at least its floor of ``sim``, the best ``k`` a group, then all once."""
    return union_candidates(*(top_k(frame.where(F.col("sim") >= floors.get(name, 0.0)).drop("rn"), k) for name, frame in passes.items()))


def block(records: DataFrame, preset: Preset, k: int | None = None) -> DataFrame:
    """The union of a preset's signals."""
    own = replace(preset, k=k or preset.k)
    return union_candidates(*(cosine_top_k(records, own, name) for name in own.signals))


def signal_masks(passes: dict[str, DataFrame]) -> DataFrame:
    """``q, c, mask``: bit i set where pass i has the pair."""
    out = None
    for i, frame in enumerate(passes.values()):
        own = frame.select("q", "c", F.lit(1 << i).alias("bit")).distinct()
        out = own if out is None else out.unionByName(own)
    return out.groupBy("q", "c").agg(F.bit_or("bit").alias("mask"))


def _met_in_lists(candidates: DataFrame, hits: DataFrame, own: tuple[str, ...]) -> DataFrame:
    """``own, q, hits`` of each candidate, as a left join on (q, c) gives them; rows are dealt out by q alone, which later sums by q can use."""
    listed = candidates.groupBy("q").agg(F.collect_list(F.struct(*own, "c")).alias("all"))
    true = hits.groupBy("q").agg(F.collect_list(F.struct("c", "hits")).alias("true"))
    found = F.filter("true", lambda t: F.array_contains(F.col("all.c"), t["c"]))
    each = listed.join(true, "q", "left").select("q", "all", found.alias("true")).select("q", "true", F.explode("all").alias("x"))
    hit = F.try_element_at(F.filter("true", lambda t: t["c"] == F.col("x.c")), F.lit(1))["hits"]
    return each.select(*(F.col(f"x.{name}").alias(name) for name in own), "q", hit.alias("hits"))


def evaluate(candidates: DataFrame, truth: DataFrame, queries: DataFrame, by: tuple[str, ...] = (), levels: tuple[tuple[str, ...], DataFrame] | None = None, few: bool = False) -> DataFrame:
    """Recall, misses, ceiling and size of candidates, for each value of the columns ``by`` that candidates have.

    ``queries``: (q), every entity asked about; candidates of others don't count. The ceiling is the mean F0.5 of a matcher that keeps just the
    true candidates. ``levels``: columns of the candidates and a small table of these and ``by``; candidates are then counted once by those
    columns, and the counts, not the pairs, go to every value of ``by`` that the table gives them. ``few``: an entity has a bounded number of
    candidates, which then are shuffled as one list for each entity and task, and once.
    """
    hits = truth.groupBy("q", "c").agg(F.count(F.lit(1)).alias("hits"))
    own = levels[0] if levels else by
    met = _met_in_lists(candidates, hits, own) if few else candidates.join(hits, ["q", "c"], "left")
    per_q = met.groupBy(*own, "q").agg(F.count(F.lit(1)).alias("n_cand"), F.coalesce(F.sum("hits"), F.lit(0)).alias("tp"))
    if levels:
        per_q = per_q.join(F.broadcast(levels[1]), list(own)).groupBy(*by, "q").agg(F.sum("n_cand").alias("n_cand"), F.sum("tp").alias("tp"))
    true = truth.groupBy("q").agg(F.count(F.lit(1)).alias("n_true"))
    base = queries.select("q").join(true, "q", "left").fillna(0, ["n_true"])
    recall = F.col("tp") / F.col("n_true")
    best = F.when(F.col("n_true") == 0, 1.0).when(F.col("tp") == 0, 0.0).otherwise(1.25 * recall / (0.25 + recall))
    zero, single = F.lit(0), (F.col("n_true") == 0).cast("long")
    met = per_q.join(base, "q")
    # Entities without candidates count alike under every configuration: they enter as totals, not as rows.
    some = met.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("n_cand").alias("candidates"), F.sum(best).alias("best"), F.sum((F.col("tp") == F.col("n_true")).cast("long")).alias("complete"), F.sum(single).alias("singles"))
    total = base.agg(F.count(F.lit(1)).alias("n"), F.sum("n_true").alias("n_true"), F.sum(single).alias("all_singles"))
    out = some.join(F.broadcast(total), F.lit(True))  # one row
    part = lambda name: F.coalesce(name, zero)
    left_out = F.col("all_singles") - part("singles")
    return out.select(
        *by,
        part("tp").alias("tp"),
        (F.col("n_true") - part("tp")).alias("fn"),
        F.round(F.coalesce(F.try_divide(part("tp"), F.col("n_true")), F.lit(0.0)), 6).alias("recall"),
        F.round((F.coalesce("best", F.lit(0.0)) + left_out) / F.col("n"), 6).alias("max_macro_f05"),
        F.round((part("complete") + left_out) / F.col("n"), 6).alias("complete_share"),
        part("candidates").alias("candidates"),
        F.round(part("candidates") / F.col("n"), 6).alias("cand_per_entity"),
    )


def evaluate_by_country(candidates: DataFrame, truth: DataFrame, records: DataFrame) -> DataFrame:
    """``country, n_true, tp, recall, candidates, entities`` of source-1 entities; recall is null where a country has no true pair."""
    own = records.where("source = 'S1'").select(F.col("entity_id").alias("q"), "country")
    cand = candidates.select("q", "c").distinct().withColumn("hit", F.lit(1))
    sizes = cand.groupBy("q").agg(F.count(F.lit(1)).alias("candidates"))
    true = truth.join(cand, ["q", "c"], "left").groupBy("q").agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("tp"))
    full = own.join(sizes, "q", "left").join(true, "q", "left").fillna(0, ["candidates", "n_true", "tp"])
    out = full.groupBy("country").agg(F.sum("n_true").alias("n_true"), F.sum("tp").alias("tp"), F.sum("candidates").alias("candidates"), F.count(F.lit(1)).alias("entities"))
    return out.select("country", "n_true", "tp", F.round(F.try_divide("tp", "n_true"), 6).alias("recall"), "candidates", "entities")


def reduction_ratio(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """``candidates, comparisons, reduction_ratio``: the share of all comparisons within a country that blocking saves."""
    by_country = records.groupBy("country").agg(F.sum((F.col("source") == "S1").cast("long")).alias("asked"), F.sum((F.col("source") != "S1").cast("long")).alias("others"))
    every = by_country.agg(F.sum(F.col("asked") * F.col("others")).alias("comparisons"))
    out = candidates.agg(F.count(F.lit(1)).alias("candidates")).join(F.broadcast(every), F.lit(True))  # one row each
    return out.select("candidates", "comparisons", F.round(F.lit(1.0) - F.col("candidates") / F.col("comparisons"), 6).alias("reduction_ratio"))


def smoke_index(records: DataFrame, truth: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """A small index for trial runs: all true matches and about ``share`` of the other records."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.col("entity_id")), F.lit(1_000_000)) < int(share * 1_000_000)
    others = records.where(part | (F.col("source") == "S1"))
    true = records.join(truth.select(F.col("c").alias("entity_id")).distinct(), "entity_id", "left_semi")
    return others.unionByName(true).distinct()


def seed_stability(candidates: DataFrame, truth: DataFrame, seeds: DataFrame) -> DataFrame:
    """Recall over samples of the entities, one for each seed: mean, deviation, least and most."""
    hit = truth.join(candidates.select("q", "c", F.lit(1).alias("hit")).distinct(), ["q", "c"], "left")
    drawn = hit.join(F.broadcast(seeds), F.substring(F.md5(F.concat_ws("|", F.col("seed").cast("string"), "q")), 1, 1) < "5")
    each = drawn.groupBy("seed").agg((F.count("hit") / F.count(F.lit(1))).alias("r"))
    return each.agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_pop("r"), 6).alias("deviation"), F.round(F.min("r"), 6).alias("least"), F.round(F.max("r"), 6).alias("most"))
