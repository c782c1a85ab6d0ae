"""Event logs as streams: numbering, limits, leases, duplicates and windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.sources.tables import shared_dir


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet file or folder, with the schema of what is there (R2: where it stands is in the checkpoint)."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder, name = path.rpartition("/")[::2]
    single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema)
    # a stream reads folders; a single file is the only one of its name in its folder
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def numbered(events: DataFrame, key: str, order: list[str], columns: str) -> DataFrame:
    """``seq``: a dense number of each key's events in order of arrival, of one batch by ``order``.

    ``columns`` is the DDL of the input's columns that are kept.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        rows["seq"] = range(seq + 1, seq + 1 + len(rows))
        state.update((seq + len(rows),))
        yield rows

    return events.groupBy(key).applyInPandasWithState(step, f"{columns}, seq bigint", "seq bigint", "append", GroupStateTimeout.NoTimeout)


def rate_limited(events: DataFrame, key: str, at: str, order: list[str], columns: str, seconds: float = 60.0, most: int = 60) -> DataFrame:
    """``accepted``: at most so many of a key in any such span; rejected ones don't count."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        accepted = []
        for t in rows[at].map(lambda x: x.timestamp()):
            kept = [x for x in kept if x > t - seconds]
            accepted.append(len(kept) < most)
            if accepted[-1]:
                kept.append(t)
        rows["accepted"] = accepted
        state.update((kept,))
        yield rows

    return events.groupBy(key).applyInPandasWithState(step, f"{columns}, accepted boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def lapsed_leases(beats: DataFrame, key: str, at: str, order: list[str], seconds: float = 90.0) -> DataFrame:
    """``key, lapsed_at``: times at which a lease ran out before the next heartbeat."""
    kind = beats.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in pd.concat(list(batches)).sort_values(order, kind="stable")[at].map(lambda x: x.timestamp()):
            if last is not None and t - last > seconds:
                out.append(last + seconds)
            last = t if last is None else max(last, t)
        state.update((last,))
        yield pd.DataFrame({key: [k[0]] * len(out), "lapsed_at": out})

    return beats.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, lapsed_at double", "last double", "append", GroupStateTimeout.NoTimeout)


def without_repeats(events: DataFrame, keys: list[str], at: str, late: str = "30 days") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of tumbling windows of event time with a watermark (an addition of this engine)."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def drain(spark: SparkSession, stream: DataFrame, mode: str = "append", each: Callable | None = None) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote.

    Appended rows go to Parquet files exactly once; a complete result is written anew by each
    batch. Output and checkpoint are in the shared folder, so a restart goes on from there.
    """
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        q = w.format("parquet").start(f"{at}/out")
    else:
        q = w.foreachBatch(each or (lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out"))).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
