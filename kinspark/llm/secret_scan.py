"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for spans of several kinds. The hash of each candidate value is counted over
distinct repositories and distinct owners. A value of many owners is a widely copied example, and so is one
of two owners that hold it in many repositories; a value that one owner holds, in however many repositories,
or that few hold, is a live-looking credential. Spans of the base kinds stay whatever the verdict; spans of
the vendor kind are added only where they look live.

An owner is a row's ``source``; a repository is what an owner has in one language (``source, lang``), as the
tables at hand name no finer unit.

Cases: null text counts as empty; a row without spans keeps its place with empty results; in very long
texts n spans cost about n * sqrt(n) steps; repeated rows and repeated doc_ids are rows of their own; a null
owner or repository counts as one more owner or repository; a repository column that the table lacks is left
out; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm._common import bind, in_blocks, materialize, running, text_or_empty


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind, pattern, group of the value, least length of the value; in the order in which ties are listed.
ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + f"|{_either('api')}_?{_either('key')}" + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # a whole match of AKIA[A-Z0-9]+ is that of 20 or more characters
HEX = "[0-9a-f]{24,}"  # as above: runs are whole either way
VENDOR = "(?:ghp_|gho_|ghs_|glpat-|sk_live_|xoxb-|xoxp-|AIza)[A-Za-z0-9_-]{16,}"
KINDS = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("vendor", VENDOR, 0, 20))
BASE = ("assign", "access", "hex")
#: A value of so many owners is a copied example; so is one of two or more owners in so many repositories.
WIDELY_COPIED, WIDELY_HELD = 3, 4
ANY = "|".join(f"(?:{pattern})" for _, pattern, _, _ in KINDS)
REPO = ("source", "lang")
SPAN = "struct<start:int,rank:int,kind:string,stop:int,hash:string>"


def kind_spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind in code points.

    What lies between matches and the matches themselves alternate through the text, so running sums of
    their lengths are the places.
    """
    wanted = F.lit(pattern)
    lengths = F.transform(F.regexp_extract_all(text, wanted, F.lit(0)), F.length)
    values = F.regexp_extract_all(text, wanted, F.lit(group))
    between = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(between.alias("g"), lengths.alias("m"), values.alias("v"))

    def step(at: Column, row: Column) -> tuple[Column, Column, Column]:
        begin = at + row["g"]
        stop = begin + F.coalesce(row["m"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"), F.sha2(row["v"], 256).alias("hash"))
        return stop, F.coalesce(F.length(row["v"]) >= least, F.lit(False)), span

    return F.when(text.rlike(pattern), running(rows, F.lit(0), SPAN, step)["out"]).otherwise(F.array().cast(f"array<{SPAN}>"))


def all_spans(text: Column) -> Column:
    return F.concat(*(kind_spans(text, rank, *kind) for rank, kind in enumerate(KINDS)))


def ownership(spans: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners, n_spans`` over rows ``hash, repo, owner``; each level is summed before the next shuffle."""
    each = spans.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n_repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n_repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_spans"))


def _scan(docs: DataFrame, kept: dict[str, str], text_col: str, repo_cols: tuple[str, ...], owner_col: str, widely: int, held: int) -> DataFrame:
    """The columns in ``kept`` (old name to new) and ``_spans`` of every row.

    One pass over the texts writes the spans found, with what is kept; counting and joining work on spans
    alone. A value that a third of all rows hold is summed in each task first, and its rows are joined as a
    skewed key that adaptive execution splits.
    """
    repo = F.struct(*(F.col(c).cast("string").alias(f"r{i}") for i, c in enumerate(repo_cols) if c in docs.columns))
    found = materialize(
        docs.select(F.monotonically_increasing_id().alias("_row"), repo.alias("_repo"), F.col(owner_col).cast("string").alias("_owner"), all_spans(text_or_empty(text_col)).alias("_found"), *(F.col(c).alias(name) for c, name in kept.items())),
        "spans",
    )
    each = found.where(F.size("_found") > 0).select("_row", "_repo", "_owner", F.explode("_found").alias("s"))
    counts = ownership(each.select(F.col("s.hash").alias("hash"), F.col("_repo").alias("repo"), F.col("_owner").alias("owner")))
    copied = (F.col("n_owners") >= widely) | (F.col("n_owners") > 1) & (F.col("n_repos") >= held)
    judged = each.select("_row", "s", F.col("s.hash").alias("hash")).join(counts, "hash").withColumn("live", ~copied)
    judged = judged.where(F.col("s.kind").isin(*BASE) | F.col("live"))
    span = F.struct("s.start", "s.rank", "s.kind", "s.stop", "hash", "n_repos", "n_owners", "live")
    by_row = materialize(judged.groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_spans")), "judged")  # its size is known to the join below
    empty = F.array().cast(by_row.schema["_spans"].dataType)
    return found.join(by_row, "_row", "left").select(*kept.values(), F.coalesce("_spans", empty).alias("_spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = REPO, owner_col: str = "source", widely: int = WIDELY_COPIED, held: int = WIDELY_HELD) -> DataFrame:
    """Per row ``id_col`` and ``spans``: array of (start, rank, kind, stop, hash, n_repos, n_owners, live), sorted."""
    return _scan(docs, {id_col: "_id"}, text_col, repo_cols, owner_col, widely, held).select(F.col("_id").alias(id_col), F.col("_spans").alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_digests(docs: DataFrame, **options) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans, and how many are live or widely copied."""
    found = scan(docs, **options)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda kind: count(lambda s: s["kind"] == kind)
    return found.select(
        options.get("id_col", "doc_id"),
        *(of_kind(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_copied"),
    )


def redact(docs: DataFrame, mask: str = "<secret>", text_col: str = "text", repo_cols: tuple[str, ...] = REPO, owner_col: str = "source", widely: int = WIDELY_COPIED, held: int = WIDELY_HELD) -> DataFrame:
    """The rows with every live-looking span of the text replaced; widely copied examples and all else stay.

    Overlapping spans are replaced as one. A null text stays null. Only rows in which some pattern matches are
    written and joined with the verdicts; all others pass through as they are.
    """
    kept = {c: f"_keep{i}" for i, c in enumerate(docs.columns)}
    has_match = text_or_empty(text_col).rlike(ANY)
    found = _scan(docs.where(has_match), kept, text_col, repo_cols, owner_col, widely, held)
    body = F.col(kept[text_col])
    live = F.filter("_spans", lambda s: s["live"])

    def gap(at: Column, s: Column) -> tuple[Column, Column, Column]:
        return F.greatest(at, s["stop"]), s["start"] >= at, F.struct(at.alias("a"), s["start"].alias("b"))

    def cut(own: Column) -> Column:
        """The texts of one block of gaps, joined; the body is walked once a block."""
        first = own[0]["a"]
        part = F.substring(body, first + 1, F.element_at(own, -1)["b"] - first)
        return bind(part, lambda p: F.array_join(F.transform(own, lambda g: F.substring(p, g["a"] - first + 1, g["b"] - g["a"])), mask))

    gaps = bind(running(live, F.lit(0), "struct<a:int,b:int>", gap), lambda r: F.concat(r["out"], F.array(F.struct(r["state"].alias("a"), F.length(body).alias("b")))))
    done = F.array_join(F.transform(in_blocks(gaps), cut), mask)
    masked = found.select(*(F.when(F.size(live) > 0, done).otherwise(body).alias(c) if c == text_col else F.col(name).alias(c) for c, name in kept.items()))
    return docs.where(~has_match).select(*docs.columns).union(masked)
