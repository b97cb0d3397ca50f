"""Shared plumbing of the training-data operators: table reads, written intermediates, shared folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    """The text column with null taken as the empty string."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_blocks(rows: Column) -> Column:
    """An array cut into about as many arrays as each of them has members."""

    def cut(r: Column) -> Column:
        each = F.ceil(F.sqrt(F.size(r))).cast("int")
        return F.when(F.size(r) > 0, F.transform(F.sequence(F.lit(1), F.size(r), F.greatest(each, F.lit(1))), lambda i: F.slice(r, i, each)))

    return bind(rows, cut)


def running(rows: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """Struct (state, out) after all of ``rows``, in order: ``step(state, row)`` gives the next state, whether to add to out, and what.

    ``kind`` is the type of out's members. Rows are taken in blocks of the root of their number, so that
    what has been added is copied once a block and not once a row.
    """
    none = F.array().cast(f"array<{kind}>")

    def each(acc: Column, row: Column) -> Column:
        after, adds, what = step(acc["state"], row)
        return F.struct(after.alias("state"), F.when(adds, F.concat(acc["out"], F.array(what))).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, own: Column) -> Column:
        done = F.aggregate(own, F.struct(acc["state"].alias("state"), none.alias("out")), each)
        return bind(done, lambda d: F.struct(d["state"].alias("state"), F.concat(acc["out"], d["out"]).alias("out")))

    blocks = in_blocks(rows)
    start = F.struct(state.alias("state"), none.alias("out"))
    return F.coalesce(F.aggregate(blocks, start, block), start)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(columns: Iterable[str]) -> Column:
    """128 bits over the given columns, by which rows are told apart; nulls differ from every text."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in columns]
    halves = (F.xxhash64(*texts), F.xxhash64(F.lit("second half"), *texts))
    return F.concat(*(F.unhex(F.lpad(F.hex(h), 16, "0")) for h in halves))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where a session on one machine has none (tests) is a local folder chosen and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kinspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark)}/kinspark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    This cuts lineage and survives lost executors, since the files are in a folder they share.
    """
    return written(df, label)[0]


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """As :func:`materialize`, with the folder, so that loops can drop what the next round has replaced."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_folder`, through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


class BoundedCache(dict):
    """A dict that fills itself from ``make`` and is emptied when it holds ``most`` entries.

    Keys longer than ``longest`` are computed each time and not held.
    """

    def __init__(self, make, most: int = 250_000, longest: int = 64):
        super().__init__()
        self._make, self._most, self._longest = make, most, longest

    def __missing__(self, key):
        value = self._make(key)
        if len(key) <= self._longest:
            if len(self) >= self._most:
                self.clear()
            self[key] = value
        return value
