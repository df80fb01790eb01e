"""Tick streams: the same functions serve batch and streaming DataFrames. `quantloom.sources.appends.append_batch` writes them, as a foreachBatch function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: how late ticks may come before their window closes
DELAY = "10 minutes"


def read_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over a folder of Parquet files with the columns id, ts, price, event_type, event_id."""
    return spark.readStream.schema("id long, ts timestamp, price double, event_type string, event_id long").parquet(folder)


def tick_bars(ticks: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """OHLC and count per instrument and event-time window, with a watermark on streams."""
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", DELAY)
    key = F.struct("ts", "event_id")
    out = ticks.groupBy("id", F.window("ts", width, slide).alias("w")).agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count("*").alias("n"))
    return out.select("id", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")


def sessions(ticks: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of ticks of an instrument that are less than `gap` apart."""
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", DELAY)
    out = ticks.groupBy("id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("price").alias("total"))
    return out.select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def merged(*streams: DataFrame) -> DataFrame:
    """Ticks of several sources as one; a batch is ordered by time within its partitions, a stream is ordered by the event-time windows that read it."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out if out.isStreaming else out.sortWithinPartitions("ts", "id", "event_id")


def moving_averages(ticks: DataFrame, width: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Mean price and, where ticks carry a `volume`, the volume-weighted one (0 without volume) of sliding event-time windows."""
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", DELAY)
    volume = F.col("volume") if "volume" in ticks.columns else F.lit(1.0)
    g = ticks.groupBy("id", F.window("ts", width, slide).alias("w")).agg(F.avg("price").alias("mavg"), F.sum(F.col("price") * volume).alias("_m"), F.sum(volume).alias("_v"), F.count("*").alias("n"))
    return g.select("id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mavg", F.coalesce(F.try_divide(F.col("_m"), F.col("_v")), F.lit(0.0)).alias("vwap"), "n")


def snapshots(ticks: DataFrame, closes: DataFrame) -> DataFrame:
    """Latest tick per instrument with the previous close (`id`, `prev_close`) and the change since; on streams for update or complete mode."""
    last = ticks.groupBy("id").agg(F.max_by(F.struct("ts", "price"), F.struct("ts", "event_id")).alias("t"), F.count("*").alias("n"))
    x = last.join(closes.select("id", "prev_close"), "id", "left")
    return x.select("id", F.col("t.ts").alias("ts"), F.col("t.price").alias("last"), "prev_close", (F.try_divide(F.col("t.price"), F.col("prev_close")) - 1).alias("change"), "n")


STOP = "id long, ts timestamp, price double, peak double, drawdown double, stopped boolean"


def drawdown_stops(ticks: DataFrame, limit: float = 0.1) -> DataFrame:
    """Per instrument a running peak held as state: each tick with its fall from the peak and whether the stop has been hit; once hit it stays.

    On streams ticks of one micro-batch are taken in time order; a tick that comes a batch late meets the state of its arrival."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        peak, stopped = state.get if state.exists else (0.0, False)
        for pdf in [pd.concat(list(frames), ignore_index=True).sort_values("ts", kind="stable")]:
            rows = []
            for ts, price in zip(pdf["ts"], pdf["price"], strict=True):
                peak = max(peak, float(price))
                fall = price / peak - 1 if peak > 0 else 0.0
                stopped = stopped or fall <= -limit
                rows.append((key[0], ts, price, peak, fall, stopped))
            yield pd.DataFrame(rows, columns=["id", "ts", "price", "peak", "drawdown", "stopped"])
        state.update((peak, stopped))

    return ticks.select("id", "ts", "price").groupBy("id").applyInPandasWithState(step, STOP, "peak double, stopped boolean", "append", GroupStateTimeout.NoTimeout)


def fresh(snapshot: DataFrame, now: str, limit: str = "5 minutes", least: int = 1) -> DataFrame:
    """One row: instruments, those younger than `limit` at `now`, and whether at least `least` and four fifths of all are. For foreachBatch as for batches."""
    young = F.col("ts") >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL {limit}")
    g = snapshot.agg(F.count("*").alias("n"), F.count_if(young).alias("young"))
    return g.withColumn("open", (F.col("young") >= least) & (F.col("young") >= 0.8 * F.col("n")))
