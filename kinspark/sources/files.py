"""Readers and writers of record files, and the wide and long forms of id lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = ("entity_id", "business_name", "business_address", "country")


def split_lines(lines: DataFrame, columns: tuple[str, ...] = RECORD) -> DataFrame:
    """Records from lines (column ``value``): split at tabs without quoting; lines with too few fields go, further fields too; a header goes."""
    parts = F.split("value", "\t", -1)
    kept = lines.where(F.size(parts) >= len(columns)).where(F.col("value") != F.lit("\t".join(columns)))
    return kept.select(*(parts[i].alias(c) for i, c in enumerate(columns)))


def malformed(lines: DataFrame, fields: int = 4) -> DataFrame:
    """``n_lines, n_short, n_long``: lines with other than ``fields`` fields; short ones are dropped by the reader, long ones kept."""
    size = F.size(F.split("value", "\t", -1))
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.sum((size < fields).cast("int")).cast("long").alias("n_short"), F.sum((size > fields).cast("int")).cast("long").alias("n_long"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A record file, with ``source`` from the id's prefix."""
    return split_lines(spark.read.text(path)).withColumn("source", F.substring("entity_id", 1, 2))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``q, c`` of an id-list file."""
    return to_long(split_lists(spark.read.text(path)))


def split_lists(lines: DataFrame) -> DataFrame:
    """``q, ids`` of lines "id TAB comma list"; a header line (of names ending in _id and _ids) goes."""
    parts = F.split("value", "\t", 2)
    rows = lines.where(F.col("value") != "").select(parts[0].alias("q"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("ids"))
    return rows.where(~(F.col("q").endswith("_id") & F.col("ids").endswith("_ids")))


def to_long(lists: DataFrame) -> DataFrame:
    return lists.select("q", F.explode(F.filter(F.split("ids", ","), lambda x: x != "")).alias("c"))


def to_wide(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """``q, ids`` with a row for every entity, ids sorted and distinct."""
    lists = pairs.groupBy("q").agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("ids"))
    return entities.select("q").join(lists, "q", "left").select("q", F.coalesce("ids", F.lit("")).alias("ids"))


def write_lists(wide: DataFrame, path: str, header: tuple[str, str] | None = None) -> None:
    """An id-list file, a header on top if given (one file then)."""
    lines = wide.select(F.concat_ws("\t", "q", "ids").alias("value"), F.col("q").alias("_o"))
    if header:
        top = wide.sparkSession.createDataFrame([("\t".join(header), "")], "value string, _o string")
        lines = top.union(lines).orderBy("_o").coalesce(1)
    lines.select("value").write.mode("errorifexists").text(path)


def shard(rows: DataFrame, n: int = 16, key: str = "q", country: str = "country") -> DataFrame:
    """Rows with ``shard``: the CRC-32 of the key over ``n``; :func:`write_shards` lays them out by country and shard."""
    return rows.withColumn("shard", F.pmod(F.crc32(key), F.lit(n)).cast("int"))


def write_shards(rows: DataFrame, path: str, n: int = 16, key: str = "q", country: str = "country") -> None:
    own = shard(rows, n, key, country)
    own.repartition(F.col(country), F.col("shard")).write.mode("errorifexists").partitionBy(country, "shard").parquet(path)


def write_cache(rows: DataFrame, path: str, by: tuple[str, ...] = ("source", "country")) -> None:
    """A Parquet cache (zstd), partitioned; the committer makes it appear whole or not at all."""
    rows.write.mode("errorifexists").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_training_csv(rows: DataFrame, path: str) -> None:
    """Columns s1_id, cand_id, text_a, text_b, label, stage1, in_band, with a header."""
    rows.select("s1_id", "cand_id", "text_a", "text_b", "label", "stage1", "in_band").write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("errorifexists").json(path)


#: suffix: (format, options)
FORMATS = {
    "csv": ("csv", {"header": True, "inferSchema": True}),
    "tsv": ("csv", {"header": True, "inferSchema": True, "sep": "\t"}),
    "tab": ("csv", {"header": True, "inferSchema": True, "sep": "\t"}),
    "parquet": ("parquet", {}),
    "pq": ("parquet", {}),
    "json": ("json", {"multiLine": True}),
    "jsonl": ("json", {}),
    "ndjson": ("json", {}),
}


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table in any known format, told by its suffix; ValueError for another."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in FORMATS:
        raise ValueError(f"no reader for .{suffix}")
    kind, options = FORMATS[suffix]
    return spark.read.format(kind).options(**options).load(path)


def list_data(spark: SparkSession, path: str) -> DataFrame:
    """``path, size_mb`` of all files below a folder, largest first; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.round(F.col("length") / 1e6, 3).alias("size_mb")).orderBy(F.desc("size_mb"), "path")


def peek(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def count_rows(df: DataFrame) -> DataFrame:
    """One row; for Parquet the footers answer."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def cache_frame(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The frame kept at ``path``, built and written if absent or if ``force``."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    exists = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)
    if force or not exists:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_pass(pairs: DataFrame, path: str) -> None:
    """One pass of candidates: ``q, c, source, sim, has_sims``; sim is null in a pass that has none."""
    sims = "sim" in pairs.columns
    pairs.select("q", "c", "source", (F.col("sim") if sims else F.lit(None)).cast("double").alias("sim"), F.lit(sims).alias("has_sims")).write.mode("overwrite").parquet(path)


def load_pass(spark: SparkSession, path: str) -> DataFrame:
    """A saved pass; without sim where it had none."""
    own = spark.read.parquet(path)
    first = own.select("has_sims").first()
    return own.drop("has_sims") if first and first[0] else own.drop("has_sims", "sim")


def resumed(spark: SparkSession, path: str, parts: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """All parts, each written under its name below ``path`` once; a run that was stopped goes on at the first part that isn't whole."""
    out = None
    for name, build in parts.items():
        own = cache_frame(spark, f"{path}/part={name}", build)
        out = own if out is None else out.unionByName(own)
    return out


def fingerprint(df: DataFrame) -> DataFrame:
    """``n_rows, fingerprint`` (12 hex digits) that doesn't depend on row order.

    Digests of rows are summed, so that rows that come twice don't cancel out. Values count by their text.
    """
    names = ",".join(df.columns)
    row = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in df.columns)))
    total = F.coalesce(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.substring(F.md5(F.concat_ws("|", F.lit(names), F.count(F.lit(1)).cast("string"), total)), 1, 12).alias("fingerprint"))
