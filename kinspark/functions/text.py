"""Text normalisation as Column functions, so that it stays in the JVM and inside the optimiser's view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinspark.functions import tables


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_null(c) -> Column:
    """True for null and for placeholders."""
    return F.coalesce(F.lower(F.trim(_col(c))), F.lit("")).isin(*tables.NULLISH)


def letters_and_digits(c, letters: str = "a-z0-9") -> Column:
    return F.regexp_replace(F.lower(_col(c)), f"[^{letters} ]+", " ")


def collapse_runs(c) -> Column:
    """Each run of one character becomes that character; digits and spaces too, so that 1100 becomes 10."""
    return F.regexp_replace(_col(c), r"(.)\1+", "$1")


def squeeze(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def tokens(c) -> Column:
    return F.filter(F.split(_col(c), " "), lambda t: t != "")


def _unconfuse(t: Column) -> Column:
    return F.when(t.rlike("[0-9]") & ~t.rlike("^[0-9]+$"), F.translate(t, tables.CONFUSED, tables.MEANT)).otherwise(t)


def _singular(t: Column) -> Column:
    n = F.length(t)
    return (
        F.when((n > 5) & t.endswith("ies"), F.concat(t.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & t.endswith("s") & ~t.endswith("ss"), t.substr(F.lit(1), n - 1))
        .otherwise(t)
    )


def _settled(start: str, table: dict[str, str], rounds: int) -> str:
    """``start`` after so many rounds of look-up, singular, look-up."""

    def singular(t: str) -> str:
        if len(t) > 5 and t.endswith("ies"):
            return t[:-3] + "y"
        return t[:-1] if len(t) > 4 and t.endswith("s") and not t.endswith("ss") else t

    for _ in range(rounds):
        t = singular(table.get(start, start))
        start = table.get(t, t)
    return start


def canonical_tokens(words: Column, short: bool) -> Column:
    """One spelling for each meaning.

    A token takes up to four rounds of look-up, singular form and look-up. A word that is in the table, or
    whose singular is, has its end form worked out beforehand; any other word only becomes singular, where
    it stays. A hash-set test comes before each map look-up, whose cost is linear in the table.
    """
    table = tables.variants(short)
    ends = {k: _settled(k, table, 4) for k in table}
    singular_ends = {k: _settled(v, table, 3) for k, v in table.items()}

    def as_map(pairs: dict[str, str]) -> Column:
        return F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in pairs.items())), F.lit(";"), F.lit("="))

    def of_plural(t: Column) -> Column:
        return F.when(t.isin(*table), F.element_at(as_map(singular_ends), t)).otherwise(t)

    def each(t: Column) -> Column:
        single = F.element_at(F.transform(F.array(_singular(t)), lambda s: F.when(s != t, of_plural(s)).otherwise(s)), 1)
        return F.when(t.isin(*table), F.element_at(as_map(ends), t)).otherwise(single)

    return F.transform(F.transform(words, _unconfuse), each)


#: Older forms of the normaliser, as options of :func:`normalize`.
NORMALISERS = {
    "plain": {"canon": False, "drop_legal": False, "drop_stop": False},
    "kernel": {"canon": False},
    "one-table": {"country": None},
    "profile": {"canon": False, "collapse": False, "drop_legal": False, "drop_stop": False, "letters": "a-z0-9\u0900-\u097f"},
    "vowels": {"country": None, "vowels": True},
}


def strip_words(c: Column, words) -> Column:
    return F.regexp_replace(c, rf"\b({'|'.join(words)})\b", " ")


def normalize(c, country=None, canon: bool = True, collapse: bool = True, drop_legal: bool = True, drop_stop: bool = True, fold=None, letters: str = "a-z0-9", vowels: bool = False) -> Column:
    """The normalised form. ``fold``: a function of a Column applied first (see :mod:`kinspark.functions.unicode`).

    ``letters``: what is kept, as of a character class; ``vowels``: all vowels become one, runs of it too.

    ``country`` decides whether short variants apply; None: never. What would become empty keeps its form
    from before words were stripped.
    """
    text = F.coalesce(_col(c), F.lit(""))
    out = letters_and_digits(fold(text) if fold else text, letters)
    if collapse:
        out = collapse_runs(out)
    before = squeeze(out)
    if canon:
        words = tokens(before)
        plain = F.array_join(canonical_tokens(words, False), " ")
        before = plain if country is None else F.when(_col(country).isin(*tables.SHORT_COUNTRIES), F.array_join(canonical_tokens(words, True), " ")).otherwise(plain)
    out = before
    if drop_legal:
        out = strip_words(out, tables.LEGAL)
    if drop_stop:
        out = strip_words(out, tables.STOP)
    if vowels:
        out, before = (F.regexp_replace(x, "[aeiou]+", "a") for x in (out, before))
    return F.when(is_null(text), "").otherwise(F.coalesce(F.nullif(squeeze(out), F.lit("")), before))


def phonetic(c) -> Column:
    out = _col(c)
    for a, b in tables.PHONETIC:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def skeleton(c) -> Column:
    """Vowel-free consonant form of each word."""

    def fold(w: Column) -> Column:
        for a, b in tables.SKELETON_PAIRS:
            w = F.replace(w, F.lit(a), F.lit(b))
        return collapse_runs(F.regexp_replace(F.translate(w, tables.SKELETON_FROM, tables.SKELETON_TO), "[aeiou]", ""))

    return F.array_join(F.filter(F.transform(tokens(squeeze(F.lower(_col(c)))), fold), lambda w: w != ""), " ")


def blocking_key(c, fold=None) -> Column:
    """Phonetic form of the country-free normal form."""
    return phonetic(normalize(c, None, fold=fold))


def sorted_tokens(c) -> Column:
    return F.array_join(F.array_sort(tokens(squeeze(_col(c)))), " ")


def numeric_tokens(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(r"(\d+)"), F.lit(1)))


def script_of(c) -> Column:
    """The script with the most letters; of equals the one first met; ``none`` without letters."""
    letters = F.regexp_replace(_col(c), r"[^\p{L}]", "")

    def count(first: int, last: int) -> Column:
        return F.length(F.regexp_replace(letters, rf"[^\x{{{first:X}}}-\x{{{last:X}}}]", ""))

    def first_place(first: int, last: int) -> Column:
        return F.length(F.regexp_extract(letters, rf"^[^\x{{{first:X}}}-\x{{{last:X}}}]*", 0))

    inside = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for _, a, b in tables.SCRIPTS)
    rows = [F.struct(count(a, b).alias("n"), (-first_place(a, b)).alias("at"), F.lit(name).alias("name")) for name, a, b in tables.SCRIPTS]
    rows.append(F.struct(F.length(F.regexp_replace(letters, rf"[{inside}]", "")).alias("n"), (-F.length(F.regexp_extract(letters, rf"^[{inside}]*", 0))).alias("at"), F.lit("other").alias("name")))
    best = F.array_max(F.array(*rows))
    return F.when(F.length(letters) == 0, "none").otherwise(best["name"])


def combo(name, address) -> Column:
    return F.trim(F.concat_ws(" ", _col(name), _col(address)))
