"""URL filters: rules for hosts and paths, and trust propagated over the link graph for the rest.

Personalised PageRank runs over host edges from trusted seeds; distrust runs over the reversed edges from
blocked seeds (who links to a blocked host is suspect). Hosts that most of whose pages a rule allows are
trusted seeds, those that most of whose pages a rule blocks are blocked seeds. Every seed of either kind
starts with the same mass, so that trust and distrust are on one scale however many seeds there are of each.
A host is blocked where its distrust outweighs its trust; a host without either is allowed.

Cases: a null url or one without ``://`` has empty host and path and no rule; such rows stand for no host
in the graph; null html has no links; very long html is searched for links once; ties of trust and distrust
are allowed; repeated rows stay; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm._common import drop_folder, materialize, written

#: (verdict, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
MOST_ROUNDS = 1000
LINK = r"(?i)\shref\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: str) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL, 1)), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    text = verdict = F.lit(None).cast("string")
    for kind, rule_host, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(prefix)
        text, verdict = F.when(fits, F.lit(rule_host + prefix)).otherwise(text), F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, n``: links between different hosts, summed in each task before the shuffle."""
    targets = F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1)), ascii_lower)
    links = pages.select(host_of(url_col).alias("src"), F.explode(F.array_distinct(targets)).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, most_rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank ``walk, host, rank`` from ``seeds`` (walk, host, weight) over ``edges`` (walk, src, dst, n).

    Walks (a few names) are apart from each other and go on side by side; each one's ranks sum to what its
    weights sum to. Mass that reaches a host without links out goes back to the seeds. Each round is written to
    the shared folder, where it replaces the one before; the loop ends when ranks move less than ``tolerance``
    in all and the last round reached no further host, or, where ``most_rounds`` is given, after so many. Else
    MOST_ROUNDS without an end are an error.
    """
    spark, key = edges.sparkSession, ["walk", "host"]
    out = edges.groupBy("walk", "src").agg(F.sum("n").alias("total"))
    own = out.select("walk", F.col("src").alias("host"), F.lit(True).alias("out"))
    shares = edges.join(out, ["walk", "src"]).select("walk", "src", F.col("dst").alias("host"), (F.col("n") / F.col("total")).alias("share")).join(own, key, "left")
    shares = materialize(shares.select("walk", "src", F.col("host").alias("dst"), "share", F.coalesce("out", F.lit(False)).alias("out")), "shares")
    seeds = materialize(seeds.join(own, key, "left").select(*key, "weight", F.coalesce("out", F.lit(False)).alias("out")), "seeds")
    zero, one = F.lit(0.0), F.count(F.lit(1)).alias("n")
    flows = F.coalesce(F.sum(F.when(F.col("out"), F.col("rank"))), zero).alias("flowed")
    whole = {r["walk"]: r["w"] for r in seeds.groupBy("walk").agg(F.sum("weight").alias("w")).collect()}  # a row a walk
    rank, folder = seeds.select(*key, F.col("weight").alias("rank"), "out"), None
    state = rank.groupBy("walk").agg(one, flows).collect()
    for _ in range((MOST_ROUNDS if most_rounds is None else most_rounds) if state else 0):
        left = F.lit(0.0)
        for r in state:
            left = F.when(F.col("walk") == r["walk"], 1 - damping * r["flowed"] / whole[r["walk"]]).otherwise(left)
        got = shares.join(rank.select("walk", F.col("host").alias("src"), "rank"), ["walk", "src"]).select("walk", F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"), zero.alias("old"), "out")
        jump = seeds.select(*key, (F.col("weight") * left).alias("rank"), zero.alias("old"), "out")
        step = got.unionByName(jump).unionByName(rank.select(*key, zero.alias("rank"), F.col("rank").alias("old"), "out"))
        step, newer = written(step.groupBy(*key).agg(F.sum("rank").alias("rank"), F.sum("old").alias("old"), F.max("out").alias("out")), "ranks")
        before, state = sum(r["n"] for r in state), step.groupBy("walk").agg(one, flows, F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change")).collect()
        if folder:
            drop_folder(spark, folder)
        rank, folder = step.select(*key, "rank", "out"), newer
        if sum(r["change"] for r in state) < tolerance and before == sum(r["n"] for r in state):
            break
    else:
        if most_rounds is None and state:
            raise RuntimeError(f"ranks did not settle in {MOST_ROUNDS} rounds")
    return rank.select(*key, "rank")


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", margin: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict, trust, distrust``.

    ``margin``: a host is blocked when its distrust is over so many times its trust. All pages are joined to
    their hosts' scores; a host with a third of all pages is a skewed key there, which adaptive execution
    splits, and is summed in each task before it is counted.
    """
    host, path = host_of(url_col), path_of(url_col)
    rule, verdict = rule_of(host, path, rules)
    judged = materialize(pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict")), "judged")
    edges = materialize(host_edges(pages, url_col, html_col), "host-edges")
    hosts = judged.where("host <> ''").groupBy("host").agg(F.avg((F.coalesce("verdict", F.lit("")) == "allow").cast("double")).alias("allowed"), F.avg((F.coalesce("verdict", F.lit("")) == "block").cast("double")).alias("blocked"))
    hosts = materialize(hosts, "hosts")

    n_seeds = hosts.where((F.col("allowed") > 0.5) | (F.col("blocked") > 0.5)).count()

    weight = F.lit(1.0 / max(1, n_seeds))
    seeds = hosts.where("allowed > 0.5").select(F.lit("trust").alias("walk"), "host", weight.alias("weight")).union(hosts.where("blocked > 0.5").select(F.lit("distrust"), "host", weight))
    links = edges.select(F.lit("trust").alias("walk"), "src", "dst", "n").union(edges.select(F.lit("distrust"), "dst", "src", "n"))
    zero = F.lit(0.0)
    of_walk = lambda name: F.coalesce(F.sum(F.when(F.col("walk") == name, F.col("rank"))), zero).alias(name)
    scores = propagate(links, seeds, tolerance=tolerance).groupBy("host").agg(of_walk("trust"), of_walk("distrust"))
    method = F.when(F.coalesce("distrust", zero) > margin * F.coalesce("trust", zero), "block").otherwise("allow")
    return judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), F.round(F.coalesce("trust", zero), 6).alias("trust"), F.round(F.coalesce("distrust", zero), 6).alias("distrust"))
