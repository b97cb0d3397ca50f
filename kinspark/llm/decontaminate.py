"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders. Documents are cut into tiles of ``TILE`` template words,
benchmark items into windows at every offset, and tiles are hash-joined with windows: a copy of an item of
at least 2 * TILE - 1 words holds a whole tile wherever it starts. A capitalised word is a name; as one that
begins a sentence may be no name, items have windows of both readings. In scripts without spaces each
character is a word. Tiles of one copy lie on one diagonal (tile place less window place), so counting them
there gives the share of the item that is covered; and the slot values met in matching placeholders must map
one value to one value, which re-parameterised questions do and chance matches don't. Each diagonal is
tested alone, then with tiles of near ones, as words may have been put in or left out; an item matches where
any of these passes. For items of under 4 * TILE - 1 words a tile is only a hint: they are compared word by
word along its diagonal.

Cases: null, empty and short texts have no tiles; very long texts are tiled like any other, and diagonals of
one text and item are dealt in blocks of ``BLOCK``, so that no row grows with the text; items too short for
tiles are compared as a whole at every offset; repeated rows with one id are one document; ties don't matter,
as every covered pair is returned; an item of placeholders alone is no evidence; an empty table on either
side gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm._common import bind, fresh, materialize, row_key, text_or_empty

TILE = 4
MARK = "\u0001"
UNITS = ("kg", "mg", "g", "km", "cm", "mm", "m", "miles", "mile", "feet", "ft", "inches", "inch", "litres", "liters", "ml", "l", "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "years", "year", "dollars", "euros", "cents", "percent", "degrees", "mph", "kwh", "kw", "hz")
LEAST_COVER, DRIFT = 0.4, 3
#: Items too short for two tiles at every offset need this share of their words.
SHORT, SHORT_COVER = 4 * TILE - 1, 0.8
#: Windows of at most about 100 bytes each.
MOST_BROADCAST = 200_000
BLOCK = 64
#: Scripts that put no space between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
NAME, INNER_NAME = r"(?<!\p{L})\p{Lu}\p{Ll}+", r"\p{Lu}(?<=[\p{Ll},;] .)\p{Ll}+"


def marked_words(text: Column, name: str = NAME) -> Column:
    """Lower-case words; a placeholder is MARK, a letter for its type (n, m, u) and the value. ``name``: what is one."""

    def numbers(s: Column) -> Column:
        joined = F.regexp_replace(s, r"(?<=\d)[.,:](?=\d)", "")
        with_units = F.regexp_replace(joined, rf"(?i)(?<![\p{{L}}\d])(\d+) ?({'|'.join(UNITS)})(?![\p{{L}}\d])", f" {MARK}n$1 {MARK}u$2 ")
        return F.regexp_replace(with_units, r"(?<![\p{L}\d])\d+(?![\p{L}\d])", f" {MARK}n$0 ")

    parted = bind(F.translate(text, MARK, " "), lambda s: F.when(s.rlike(UNSPACED), F.regexp_replace(s, UNSPACED, " $0 ")).otherwise(s))
    slotted = bind(F.regexp_replace(parted, name, f"{MARK}m$0"), lambda s: F.when(s.rlike("[0-9]"), numbers(s)).otherwise(s))
    return F.split(F.trim(F.regexp_replace(F.lower(slotted), rf"[^\p{{L}}\p{{N}}{MARK}]+", " ")), " ")


def template(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.startswith(MARK), F.substring(w, 1, 2)).otherwise(w))


def slots(words: Column) -> Column:
    return F.transform(F.filter(words, lambda w: w.startswith(MARK)), lambda w: F.substring(w, 2, 1 << 20))


def windows(words: Column, size: int, step: int) -> Column:
    """Structs (at, h, slots) of the windows of ``size`` words at multiples of ``step``; those with under two literal words are left out unless the size is smaller."""
    count = lambda w: F.floor((F.size(w) - size) / step) + 1

    def each(w: Column) -> Column:
        def one(i: Column) -> Column:
            own = F.slice(w, i * step + 1, size)
            return bind(own, lambda x: F.struct((i * step).cast("int").alias("at"), F.xxhash64(template(x)).alias("h"), slots(x).alias("slots")))

        made = F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0).cast("long"), count(w) - 1), one)).otherwise(F.array().cast("array<struct<at:int,h:bigint,slots:array<string>>>"))
        return F.filter(made, lambda x: F.lit(size) - F.size(x["slots"]) >= min(2, size))

    return bind(words, each)


def _plain_windows(words: Column, size: int, step: int) -> Column:
    """As :func:`windows` for words without placeholders."""

    def each(w: Column) -> Column:
        one = lambda i: F.struct((i * step).cast("int").alias("at"), F.xxhash64(F.slice(w, i * step + 1, size)).alias("h"), F.array().cast("array<string>").alias("slots"))
        last = F.floor((F.size(w) - size) / step)
        return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0).cast("long"), last), one)).otherwise(F.array().cast("array<struct<at:int,h:bigint,slots:array<string>>>"))

    return bind(words, each)


def document_windows(text: Column, size: int, step: int) -> Column:
    """Windows of a text; texts without placeholders take a shorter way to the same result."""
    has_marks = lambda w: F.exists(w, lambda x: x.startswith(MARK))
    return bind(marked_words(text), lambda w: F.when(has_marks(w), windows(w, size, step)).otherwise(_plain_windows(w, size, step)))


def consistent(pairs: Column) -> Column:
    """Whether each item value of the distinct ``pairs`` (i, s) meets one value only."""
    return F.size(F.array_distinct(F.transform(pairs, lambda p: p["i"]))) == F.size(pairs)


def alignments(diagonals: Column, size: Column, block: Column) -> Column:
    """Structs (n, whole, d, pairs) of each of the block's ``diagonals`` (d, hits) alone, and with the tiles of those at most DRIFT away.

    For the latter, tiles are taken from the nearest diagonal outwards; one that overlaps a taken one in the
    document or in the item, or comes in another order, isn't.
    """

    def alone(x: Column) -> Column:
        return F.struct(F.size(F.array_distinct(x["hits"]["o"])).cast("long").alias("n"), F.lit(1).alias("whole"), (-x["d"]).alias("d"), F.array_distinct(F.flatten(x["hits"]["pairs"])).alias("pairs"))

    def chained(x: Column) -> Column:
        near = F.filter(diagonals, lambda y: F.abs(y["d"] - x["d"]) <= DRIFT)
        tiles = F.array_sort(F.flatten(F.transform(near, lambda y: F.transform(y["hits"], lambda h: F.struct(F.abs(y["d"] - x["d"]).alias("far"), (y["d"] + h["o"]).alias("at"), h["o"].alias("o"), h["pairs"].alias("pairs"))))))
        none = F.filter(tiles, lambda _: F.lit(False))
        apart = lambda a, t: ((a["at"] - t["at"] >= size) & (a["o"] - t["o"] >= size)) | ((t["at"] - a["at"] >= size) & (t["o"] - a["o"] >= size))
        taken = F.aggregate(tiles, none, lambda acc, t: F.when(F.forall(acc, lambda a: apart(a, t)), F.concat(acc, F.array(t))).otherwise(acc))
        return bind(taken, lambda c: F.struct(F.size(c).cast("long").alias("n"), F.lit(0).alias("whole"), (-x["d"]).alias("d"), F.array_distinct(F.flatten(c["pairs"])).alias("pairs")))

    mine = F.filter(diagonals, lambda x: F.floor(x["d"] / BLOCK) == block)
    drifted = F.filter(mine, lambda x: F.exists(diagonals, lambda y: (y["d"] != x["d"]) & (F.abs(y["d"] - x["d"]) <= DRIFT)))
    return F.concat(F.transform(mine, alone), F.transform(drifted, chained))


def whole_items(hints: DataFrame, items: DataFrame, texts: DataFrame, least_cover: float) -> DataFrame:
    """``doc_id, item_id, b (n, pairs), cover`` of short items of which the words along a hinted diagonal cover enough.

    ``hints``: a row (doc_id, item_id, length, d, hits) for each diagonal with a tile. The item's words before
    a cut are compared on one diagonal and those after it on another, at most DRIFT away, so that words may
    be put in or left out at one place. Only documents with a hint are cut into words again.
    """
    asked = hints.join(items.select(F.col("item_id").alias("item"), F.col("length").alias("n_words"), "w"), F.col("item_id").eqNullSafe(F.col("item")) & (F.col("length") == F.col("n_words")))
    asked = asked.groupBy(F.col("doc_id").alias("asked_id")).agg(F.collect_list(F.struct("item_id", "length", "w", "d", F.size("hits").cast("long").alias("n"))).alias("asked"))
    read = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("asked_id"))).select("doc_id", "asked", marked_words(F.col("text")).alias("words"))

    def with_words(a: Column) -> Column:
        """The hint with the words near its diagonal, so that no row takes the whole text along."""
        places = F.sequence(a["d"] - DRIFT, a["d"] + a["length"] + DRIFT - 1)
        near = F.transform(places, lambda k: F.when(k >= 0, F.get("words", F.when(k >= 0, k).otherwise(0))))
        return F.struct(a["item_id"].alias("item_id"), a["length"].alias("length"), a["w"].alias("w"), a["d"].alias("d"), a["n"].alias("n"), near.alias("near"))

    near = read.select("doc_id", F.explode(F.transform("asked", with_words)).alias("a")).select("doc_id", "a.*")
    form = lambda x: F.when(x.startswith(MARK), F.substring(x, 1, 2)).otherwise(x)
    plain = lambda x: F.when(x.startswith(MARK), F.substring(x, 3, 1 << 20)).otherwise(x)
    same = lambda p: (form(p["i"]) == form(p["s"])) | (plain(p["i"]) == plain(p["s"]))
    pair = lambda j, shift: F.struct(F.get("w", j).alias("i"), F.coalesce(F.get("near", j + shift + DRIFT), F.lit("")).alias("s"))
    places = F.sequence(F.lit(0), F.col("length") - 1)

    def cut_at(s: Column, first: Column, second: Column) -> Column:
        use = F.filter(places, lambda j: (j < s) | (j >= s + F.greatest(F.lit(0), first - second)))
        return F.filter(F.transform(use, lambda j: F.when(j < s, pair(j, first)).otherwise(pair(j, second))), same)

    shifts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for d in range(-DRIFT, DRIFT + 1) for a, b in {(0, d), (d, 0)}))
    cuts = F.flatten(F.transform(shifts, lambda x: F.transform(F.sequence(F.lit(0), F.col("length")), lambda s: cut_at(s, x["a"], x["b"]))))
    slot_pairs = lambda m: F.array_distinct(F.transform(F.filter(m, lambda p: p["i"].startswith(MARK) & p["s"].startswith(MARK)), lambda p: F.struct(F.substring(p["i"], 2, 1 << 20).alias("i"), F.substring(p["s"], 2, 1 << 20).alias("s"))))
    share = lambda m: F.size(m) / F.col("length")
    made = F.transform(F.filter(cuts, lambda m: share(m) >= least_cover), lambda m: F.struct(share(m).alias("cover"), F.col("n").alias("n"), slot_pairs(m).alias("pairs")))
    found = near.select("doc_id", "item_id", "length", F.array_max(F.filter(made, lambda x: consistent(x["pairs"]))).alias("f")).where("f is not null")
    return found.groupBy("doc_id", "item_id", "length").agg(F.max("f").alias("f")).select("doc_id", "item_id", F.struct("f.n", "f.pairs").alias("b"), "f.cover")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_cover: float = LEAST_COVER) -> DataFrame:
    """``doc_id, item_id, n_windows, cover, n_slots, n_changed`` of every document and item that match.

    The windows of the benchmark are broadcast where a count shows at most MOST_BROADCAST of them, else
    joined by shuffle on the hash. Documents are read once; what leaves that scan are matching tiles only,
    summed per diagonal in each task before they are shuffled.
    """
    words = [marked_words(text_or_empty(item_text_col), name) for name in (NAME, INNER_NAME)]
    items = benchmark.select(F.col(item_col).alias("item_id"), words[0].alias("w"), words[1].alias("w_inner"))
    items = items.select("*", F.when(F.col("w")[0] == "", 0).otherwise(F.size("w")).alias("length"))
    items = materialize(items.where("length > 0"), "items")
    short = [r[0] for r in items.where(F.col("length") < 2 * TILE - 1).select("length").distinct().collect()]  # at most 2 * TILE - 2 numbers
    hits = []
    for size, step, own in [(TILE, TILE, items.where(F.col("length") >= 2 * TILE - 1)), *((n, 1, items.where(F.col("length") == n)) for n in sorted(short))]:
        readings = F.array_distinct(F.concat(windows(F.col("w"), size, 1), windows(F.col("w_inner"), size, 1)))
        wanted = own.select("item_id", "length", F.explode(readings).alias("x")).select("item_id", "length", F.col("x.at").alias("o"), F.col("x.h").alias("h"), F.col("x.slots").alias("item_slots"))
        wanted = materialize(wanted, "windows")
        if wanted.count() <= MOST_BROADCAST:
            wanted = F.broadcast(wanted)
        tiles = docs.select(F.col(id_col).alias("doc_id"), F.explode(document_windows(text_or_empty(text_col), size, step)).alias("t"))
        met = tiles.select("doc_id", "t.at", "t.slots", F.col("t.h").alias("h")).join(wanted, "h")
        hits.append(met.select("doc_id", "item_id", "length", F.lit(size).alias("size"), (F.col("at") - F.col("o")).alias("d"), "o", F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("s")).alias("pairs")))
    hit = hits[0]
    for more in hits[1:]:
        hit = hit.union(more)
    key = ["doc_id", "item_id", "length", "size"]
    by_diagonal = hit.groupBy(*key, "d").agg(F.collect_set(F.struct("o", "pairs")).alias("hits"))
    hinted = F.col("length").between(2 * TILE - 1, SHORT - 1)
    by_word = items.where(hinted).limit(1).count() > 0
    if by_word:
        by_diagonal = materialize(by_diagonal, "diagonals")
    blocks = F.array_distinct(F.array(*(F.floor((F.col("d") + x) / BLOCK) for x in (-DRIFT, 0, DRIFT))))
    by_block = by_diagonal.where(~hinted).select(*key, F.explode(blocks).alias("block"), F.struct("d", "hits").alias("x")).groupBy(*key, "block").agg(F.collect_list("x").alias("all"))
    least = F.when(F.col("length") >= SHORT, 2).otherwise(1)
    cover = lambda x: F.least(F.lit(1.0), x["n"] * F.col("size") / F.col("length"))
    passes = lambda x: consistent(x["pairs"]) & (cover(x) >= least_cover) & (x["n"] >= least)
    found = by_block.select(*key, F.filter(alignments(F.col("all"), F.col("size"), F.col("block")), passes).alias("found")).where(F.size("found") > 0)
    found = found.groupBy(*key).agg(F.max(F.array_max("found")).alias("b"))
    best = found.select("doc_id", "item_id", F.struct("b.n", "b.pairs").alias("b"), cover(F.col("b")).alias("cover"))
    if by_word:
        texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
        best = best.unionByName(whole_items(by_diagonal.where(hinted), items.where(hinted), texts, max(least_cover, SHORT_COVER)))
    pairs = F.col("b.pairs")
    return best.select("doc_id", "item_id", F.col("b.n").alias("n_windows"), F.round("cover", 4).alias("cover"), F.size(pairs).alias("n_slots"), F.size(F.filter(pairs, lambda p: p["i"] != p["s"])).alias("n_changed"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that match no item. Rows are told apart by 128 bits over all their columns, so that equal ids don't matter."""
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key(docs.columns))
    leaks = materialize(find_leaks(keyed, benchmark, id_col=key, text_col=text_col).select(F.col("doc_id").alias(key)).distinct(), "leaks")
    return keyed.join(leaks, key, "left_anti").select(*docs.columns)
