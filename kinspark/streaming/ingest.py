"""Matching of records as they arrive, and a watermarked count of events. An extension: the batch engine doesn't need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinspark.functions import text, tokens


def match_stream(records: DataFrame, index: DataFrame, path: str, checkpoint: str, least_shared: int = 2) -> StreamingQuery:
    """Join each arriving batch (entity_id, country, name_norm, addr_norm) with a static term index and append its candidates.

    ``index``: (country, term, c) of the known records. Each batch is written under its number, so that a
    batch run again replaces itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        terms = F.explode(F.array_distinct(tokens.words(text.combo("name_norm", "addr_norm"))))
        asked = batch.select(F.col("entity_id").alias("q"), "country", terms.alias("term"))
        found = asked.join(index, ["country", "term"]).groupBy("q", "c").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least_shared)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, total`` over tumbling windows with a watermark."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
