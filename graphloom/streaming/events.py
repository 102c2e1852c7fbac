"""Streams of events into a live graph.

Events are src, rel, dst, ts (timestamp), value, ttl (seconds; negative: for ever).  Discretisers
work on event time and are plain DataFrame functions; the stream operators use watermarks, windows
and keyed state, so late data has a rule: what comes after the watermark is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from graphloom.storage import shared_path

EVENT_SCHEMA = T.StructType([T.StructField(n, T.TimestampType() if n == "ts" else T.DoubleType() if n in ("value", "ttl") else T.StringType()) for n in ("src", "rel", "dst", "ts", "value", "ttl")])


# ---------------------------------------------------------------- sources


def tail_files(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json", **options) -> DataFrame:
    """A stream of the lines of files that come into a folder."""
    return spark.readStream.format(fmt).schema(schema).options(**options).load(folder)


def binary_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of whole files (images, sounds, documents)."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).load(folder)


def register_callback_source(spark: SparkSession, name: str, produce: Callable[[int], list[tuple]], schema: str) -> None:
    """A streaming source that calls ``produce(batch)`` for the rows of each batch until it gives
    none.  Pollers of web services and message queues are written as such functions."""
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"batch": 0}

        def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
            rows = produce(start["batch"])
            return iter(rows), {"batch": start["batch"] + (1 if rows else 0)}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            return iter([row for b in range(start["batch"], end["batch"]) for row in produce(b)])

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
            return Reader()

    spark.dataSource.register(Source)


# ---------------------------------------------------------------- windows


def live_edges(events: DataFrame, window: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Distinct edges of each (sliding) window with their counts."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return marked.groupBy(span.alias("w"), "src", "rel", "dst").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "src", "rel", "dst", "n")


def session_edges(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions of each source."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "src").agg(F.count("*").alias("n")).select("src", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rates(events: DataFrame, seconds: int = 10) -> DataFrame:
    """Events per second of tumbling windows."""
    return events.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg((F.count("*") / seconds).alias("rate")).select(F.col("w.start").alias("start"), "rate")


def alive_at(events: DataFrame, now: Column, default_ttl: float) -> DataFrame:
    """Edges still alive at a time: their last event plus its time to live is not past, or it is for
    ever (each event decides for itself)."""
    ttl = F.coalesce("ttl", F.lit(default_ttl))
    ok = (ttl < 0) | (F.unix_micros("ts") / 1e6 + ttl >= now)
    return events.where(ok & (F.unix_micros("ts") / 1e6 <= now)).groupBy("src", "rel", "dst").agg(F.count("*").alias("refs"), F.max("ts").alias("last"))


def dedup(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first event of each edge within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["src", "rel", "dst"])


# ---------------------------------------------------------------- discretisers


def states(events: DataFrame, low: float, high: float, spike: float) -> DataFrame:
    """LOW, NORMAL, HIGH or SPIKE of each value; only changes per source are kept."""
    state = F.when(F.col("value") >= spike, "SPIKE").when(F.col("value") >= high, "HIGH").when(F.col("value") < low, "LOW").otherwise("NORMAL")
    order = Window.partitionBy("src").orderBy("ts", "id")
    marked = events.withColumn("state", state)
    return marked.withColumn("before", F.lag("state").over(order)).where(~F.col("state").eqNullSafe(F.col("before"))).select("id", "src", "ts", "state")


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Bin of equal width from 0, values outside in the end bins."""
    return F.least(F.greatest(F.floor((value - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1)).cast("int")


def precedes(events: DataFrame, max_gap: float) -> DataFrame:
    """An edge from each event's label to the next one of the source, unless the gap is too long."""
    order = Window.partitionBy("src").orderBy("ts", "id")
    seconds = F.unix_micros("ts") / 1e6
    steps = events.select("src", "rel", F.lead("rel").over(order).alias("next"), (F.lead(seconds).over(order) - seconds).alias("gap"))
    return steps.where(F.col("next").isNotNull() & (F.col("gap") <= max_gap)).groupBy("rel", "next").agg(F.count("*").alias("n"))


def co_occurrence(events: DataFrame, frame: str, item: str) -> DataFrame:
    """Pairs of items in one frame, by how many frames hold both."""
    one = events.select(frame, item).distinct()
    other = one.select(frame, F.col(item).alias("other"))
    return one.join(other, frame).where(F.col(item) < F.col("other")).groupBy(F.col(item).alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("frames"))


def _last_fires(events: DataFrame, labels: list[str]) -> DataFrame:
    """Each event with the last time of every other label of its source.  One window, no self-join."""
    order = Window.partitionBy("src").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    seconds = F.unix_micros("ts") / 1e6
    rows = events.select("src", "rel", seconds.alias("t"), *[F.last(F.when(F.col("rel") == x, seconds), ignorenulls=True).over(order).alias(f"_{i}") for i, x in enumerate(labels)])
    fires = F.filter(F.array(*[F.struct(F.lit(x).alias("pre"), F.col(f"_{i}").alias("at")) for i, x in enumerate(labels)]), lambda s: s["at"].isNotNull() & (s["pre"] != F.col("rel")))
    return rows.select("src", F.col("rel").alias("post"), "t", F.explode(fires).alias("f")).select("src", "f.pre", "post", (F.col("t") - F.col("f.at")).alias("dt"))


def co_activation(events: DataFrame, labels: list[str], window: float, least: int) -> DataFrame:
    """Pairs of labels of which one fired within ``window`` seconds after the other's last time."""
    return _last_fires(events, labels).where(F.col("dt") <= window).groupBy("pre", "post").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def spike_timing(events: DataFrame, labels: list[str], tau: float = 3600.0, window: float = 4 * 3600.0, gain: float = 0.1, loss: float = 0.12, theta: float = 0.0, least: int = 1) -> DataFrame:
    """Order-in-time weight of label pairs: each last-fire pair within the window strengthens its
    direction and weakens the other one by exponential decay of the gap."""
    fires = _last_fires(events, labels).where(F.col("dt") <= window).withColumn("x", F.exp(-F.col("dt") / tau))
    g = fires.groupBy("pre", "post").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    back = g.select(F.col("post").alias("pre"), F.col("pre").alias("post"), F.col("x").alias("y"))
    out = g.join(back, ["pre", "post"], "left").withColumn("weight", gain * F.col("x") - loss * F.coalesce("y", F.lit(0.0)))
    return out.where((F.col("weight") >= theta) & (F.col("n") >= least)).select("pre", "post", "n", "weight")


def uniformity(events: DataFrame, bins: int, low: float, high: float) -> DataFrame:
    """Chi-square statistic of each source's event times against equal shares of the time bins."""
    b = bin_of(F.unix_micros("ts") / 1e6, low, high, bins)
    g = events.groupBy("src", b.alias("bin")).agg(F.count("*").alias("n"))
    s = g.groupBy("src").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return s.select("src", "total", (F.col("squares") * bins / F.col("total") - F.col("total")).alias("chi2"))


# ---------------------------------------------------------------- keyed state


def spike_timing_stream(events: DataFrame, tau: float = 3600.0, window: float = 4 * 3600.0, gain: float = 0.1) -> DataFrame:
    """Last-fire pairs as a stream: each micro-batch gives its strengthening per source and pair.

    The state of a source is the last time of each of its labels."""
    out = "src string, pre string, post string, weight double, n bigint"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        labels, times = state.get if state.exists else ([], [])
        last = dict(zip(labels, times))
        rows = pd.concat(frames).sort_values(["ts", "id"])
        found: dict[tuple[str, str], list[float]] = {}
        for label, ts in zip(rows["rel"], rows["ts"]):
            t = ts.timestamp()
            for pre, at in last.items():
                if pre != label and 0 <= t - at <= window:
                    found.setdefault((pre, label), []).append(gain * 2.718281828459045 ** (-(t - at) / tau))
            last[label] = t
        state.update((list(last), list(last.values())))
        if found:
            yield pd.DataFrame([(key[0], a, b, sum(x), len(x)) for (a, b), x in found.items()], columns=["src", "pre", "post", "weight", "n"])

    return events.groupBy("src").applyInPandasWithState(step, out, "labels array<string>, times array<double>", "append", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- sinks


def merge_into(path: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: append the batch's edges under its number, so a repeated batch
    overwrites itself, then tell a listener."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if on_batch:
            on_batch(batch, number)

    return write


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into a memory table; for tests and small results."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
