"""Structured Streaming jobs over ticks: candles to a table, fills and a poll log per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.operators.outcomes import oco_first, touch_fills
from barloom.streaming.candles import candles, feed_health

TICK_SCHEMA = "symbol string, ts timestamp, price double, event_id long, qty long"


def read_ticks(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(TICK_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def start_candles(ticks: DataFrame, out: str, checkpoint: str, width: str = "5 minutes", watermark: str = "10 minutes") -> StreamingQuery:
    """Append finished candles to ``out``; a tick later than the watermark is dropped."""
    c = candles(ticks, width, tiebreak="event_id", watermark=watermark)
    return (c.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def start_fills(candle_stream: DataFrame, orders: DataFrame, out: str, log: str, checkpoint: str, state: str, stale_after_s: int = 1500) -> StreamingQuery:
    """Match every batch of candles against the working orders: one fill per order and exclusive group
    over the whole stream, one poll-log row per batch.

    What a batch leaves to the next is a table of its own in ``state``: the orders that can still fill, without the groups
    that fired and the orders whose validity the newest candle has passed, and the newest candle end of every symbol seen.
    So a batch costs what its candles, the open orders and the symbols cost, however long the stream has run. Batches are
    numbered folders; one that is run again reads what the batch before left and overwrites its own tables, and so fills
    nothing twice."""
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        put = lambda rows, path: rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        left = lambda name, first: spark.read.schema(first.schema).parquet(f"{state}/{name}/batch={batch_id - 1}") if batch_id else first
        book = left("book", orders)
        fills = oco_first(touch_fills(book, df))
        put(fills, out)
        fills = spark.read.schema(fills.schema).parquet(f"{out}/batch={batch_id}")
        newest = df.groupBy("symbol").agg(F.max("candle_end").alias("candle_end"))
        put(newest.unionByName(left("feeds", newest.limit(0))).groupBy("symbol").agg(F.max("candle_end").alias("candle_end")), f"{state}/feeds")
        feeds = spark.read.schema(newest.schema).parquet(f"{state}/feeds/batch={batch_id}")
        now = feeds.agg(F.max("candle_end")).scalar()
        group = F.coalesce(F.col("oco_group"), -F.col("order_id") - 1)
        alive = book.filter(F.coalesce(F.col("valid_until") > now, F.lit(True)))
        put(alive.withColumn("_g", group).join(fills.select(group.alias("_g")), "_g", "left_anti").drop("_g"), f"{state}/book")
        row = feed_health(feeds, now, stale_after_s).agg(F.count("*").alias("symbols"), F.max("lag_s").alias("max_lag_s"), F.count(F.when(F.col("status") == "stale", 1)).alias("stale_symbols"))
        put(row.select(F.lit(batch_id).alias("batch_id"), "*", fills.agg(F.count("*")).scalar().alias("fills")), log)
    return (candle_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
