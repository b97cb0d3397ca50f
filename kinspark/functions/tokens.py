"""Token arrays, document frequencies and TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.functions.text import tokens


def words(c, least: int = 2) -> Column:
    """Word terms; those under ``least`` characters are no terms."""
    return F.filter(tokens(c), lambda t: F.length(t) >= least)


def windows(text: Column, n: int) -> Column:
    """All substrings of ``n`` characters, in order."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: text.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def char_ngrams(c, low: int = 3, high: int = 3) -> Column:
    """n-grams within each word padded by a space on either side; a padded word shorter than n is one term, once."""

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        sizes = [F.when(F.length(padded) > n, windows(padded, n)).when(F.lit(n == low) | (F.length(padded) == n), F.array(padded)).otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
        return F.concat(*sizes)

    return F.flatten(F.transform(tokens(c), of_word))


def padded_trigrams(c) -> Column:
    """Distinct three-character windows of the text with two spaces before and one after; none for the empty text."""
    text = F.col(c) if isinstance(c, str) else c
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(windows(padded, 3)))


def document_frequency(docs: DataFrame, terms: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by..., term, df``."""
    return docs.select(*by, F.explode(F.array_distinct(terms)).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("df"))


def feature_idf(docs: DataFrame, terms: str) -> DataFrame:
    """``term, idf`` with ln(n / (1 + df)) over all documents."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return document_frequency(docs, terms).join(F.broadcast(n), F.lit(True)).select("term", F.log(F.col("n") / (1 + F.col("df"))).alias("idf"))  # one row beside each term


def smoothed_idf(fit: DataFrame, terms: str, by: tuple[str, ...], min_df: int = 1, max_df: float = 1.0, max_features: int | None = None, size: DataFrame | None = None) -> DataFrame:
    """``by..., term, idf``: ln((1+n)/(1+df))+1 of the terms that stay (see :func:`tfidf`). ``size``: ``by..., n_docs``, if that is known."""
    size = fit.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs")) if size is None else size
    df = document_frequency(fit, terms, by).join(size, list(by)).where((F.col("df") >= min_df) & (F.col("df") <= F.greatest(F.lit(2.0), F.floor(F.lit(max_df) * F.col("n_docs")))))
    if max_features:
        often = fit.select(*by, F.explode(terms).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("_n"))
        ranked = df.join(often, [*by, "term"]).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), "term")))
        df = ranked.where(F.col("_r") <= max_features).drop("_r", "_n")
    return df.select(*by, "term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(docs: DataFrame, terms: str, id_col: str, by: tuple[str, ...], fit: DataFrame | None = None, min_df: int = 1, max_df: float = 1.0, max_features: int | None = None, binary: bool = False) -> DataFrame:
    """``by..., id_col, term, w``: smoothed idf ln((1+n)/(1+df))+1 times term count, each document of length one.

    ``fit``: the documents whose frequencies count (all of ``docs`` if None). Terms in more than ``max_df`` of
    them go (at least 2 may hold any term), which is also what keeps the later join on terms from skew. Of the
    others, those that come most often stay, up to ``max_features``.
    """
    idf = smoothed_idf(docs if fit is None else fit, terms, by, min_df, max_df, max_features)
    tf = docs.select(*by, id_col, F.explode(terms).alias("term")).groupBy(*by, id_col, "term").agg(F.count(F.lit(1)).alias("tf"))
    if binary:
        return tf.join(idf, [*by, "term"]).select(*by, id_col, "term", F.lit(1.0).alias("w"))
    raw = tf.join(idf, [*by, "term"]).select(*by, id_col, "term", (F.col("tf") * F.col("idf")).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*by, id_col)))
    return raw.select(*by, id_col, "term", (F.col("x") / norm).alias("w"))
