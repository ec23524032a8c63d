"""Structured Streaming forms of the event jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from aislerank.functions.numbers import rounded
from aislerank.operators import drift, personal
from aislerank.operators.vectors import best_per
from aislerank.session import scratch_path, ship_package

# ---------------------------------------------------------------- sources and sinks


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """The Parquet files of a table as a stream; the trigger bounds the size of a micro-batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def run_once(stream: DataFrame, mode: str = "append",
             each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process everything available and read the result back.

    Every micro-batch overwrites its own folder, so a batch that is replayed after a failure does not
    appear twice.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = each(batch) if each else batch
        rows.write.mode("overwrite").parquet(f"{base}/rows/batch={batch_id}")

    handle = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress")
              .trigger(availableNow=True).foreachBatch(write).start())
    handle.awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def log_recommendations(stream: DataFrame, path: str, engine: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for the recommendation log; a batch that is replayed overwrites its folder."""
    from aislerank.sources.tables import append_recommendations

    def write(batch: DataFrame, batch_id: int) -> None:
        append_recommendations(batch, f"{path}/batch={batch_id}", engine, mode="overwrite")

    return write


# ---------------------------------------------------------------- repeat views

EVENT_OUT = "session_id string, product_id string, event_type string, us bigint"
# Buckets of sessions that share a state: a call for each session costs far more than its few events.
BUCKETS = 4096
_EVENT = pa.schema([("session_id", pa.string()), ("event_id", pa.int64()), ("product_id", pa.string()),
                    ("event_type", pa.string()), ("us", pa.int64()), ("passed", pa.bool_())])


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _EVENT) as out:
        out.write_table(pa.Table.from_pandas(rows, _EVENT, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _codes(values: pd.Series):
    return pd.factorize(values, sort=True, use_na_sentinel=False)[0]


def _merger(gap_us: int):
    """Per bucket of sessions: hold events until the watermark passes them, then apply the repeat-view rule in
    time order.  An event is put out once nothing can merge into it any more.

    Only neighbours of a session matter, so all sessions of a bucket are worked through at once.  Of a session the
    newest event that the watermark has passed (``passed``) is kept while something may still merge into it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
        parts += [frame[_EVENT.names[:-1]].assign(passed=False) for frame in frames]
        rows = pd.concat(parts, ignore_index=True)
        now = state.getCurrentWatermarkMs() * 1000
        due = (rows["passed"] | (rows["us"] < now)).to_numpy()
        held, rows = rows[~due], rows[due]
        if len(rows):
            session, product = _codes(rows["session_id"]), _codes(rows["product_id"])
            order = np.lexsort((_codes(rows["event_type"]), product, rows["event_id"], rows["us"], ~rows["passed"], session))
            rows, session, product = rows.iloc[order], session[order], product[order]
            us, kind = rows["us"].to_numpy(), rows["event_type"]
            same = session[1:] == session[:-1]
            merged = np.append(False, same & (product[1:] == product[:-1]) & (kind == "view").to_numpy()[1:]
                               & kind.isin(("view", "repeat_view")).to_numpy()[:-1] & (us[1:] - us[:-1] < gap_us))
            rows = rows.assign(event_type=kind.mask(merged, "repeat_view"), passed=True)
            newest = np.append(~same, True)
            waits = newest & (us + gap_us > now)
            out = rows[~np.append(merged[1:], False) & ~waits]
            if len(out):
                yield out[["session_id", "product_id", "event_type", "us"]]
            held = pd.concat([rows[waits], held]) if len(held) else rows[waits]
        if len(held):
            state.update((_packed(held),))
            first = int((held["us"] + held["passed"] * gap_us).min())
            state.setTimeoutTimestamp(max(first // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return step


def repeat_views(events: DataFrame, gap_seconds: float = 60, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """``events``: validated, with a ``ts`` timestamp.  Append mode.

    Custom state, because "the newest event of the session" is no windowed aggregate.  ``buckets`` is fixed for the
    life of a checkpoint.
    """
    ship_package(events.sparkSession)
    rows = events.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("session_id"), F.lit(buckets)).alias("bucket"),
        "session_id", "event_id", "product_id", "event_type", "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("bucket").applyInPandasWithState(
        _merger(int(gap_seconds * 1_000_000)), EVENT_OUT, "rows binary", "append", GroupStateTimeout.EventTimeTimeout)


def _keeper(n: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(zip(*state.get)) if state.exists else []
        for frame in frames:
            kept = sorted(kept + list(zip(frame["us"], frame["event_id"])), reverse=True)[:n]
        state.update(([int(u) for u, _ in kept], [int(e) for _, e in kept]))
        yield pd.DataFrame(
            [(key[0], int(e), i) for i, (_, e) in enumerate(kept)], columns=["session_id", "event_id", "position"])

    return step


def newest_events(events: DataFrame, n: int = 50) -> DataFrame:
    """The n newest events per session, put out again whenever they change.  Update mode; the state
    of a session never holds more than n events."""
    ship_package(events.sparkSession)
    rows = events.select("session_id", "event_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy("session_id").applyInPandasWithState(
        _keeper(n), "session_id string, event_id bigint, position bigint",
        "times array<bigint>, ids array<bigint>", "update", GroupStateTimeout.NoTimeout)


# ---------------------------------------------------------------- windows


def windowed_trend(events: DataFrame, hours: int = 24, decay: float = 0.95, min_count: int = 5,
                   delay: str = "1 hour") -> DataFrame:
    """Scores of the closed windows.  Rank them per micro-batch with ``rank_windows``: a window is
    put out whole."""
    aged = events.withWatermark("ts", delay).withColumn("w", F.window("ts", f"{hours} hours"))
    age = (F.unix_micros(F.col("w.end")) - F.unix_micros("ts")) / 3.6e9
    return (aged.groupBy("w", "product_id")
            .agg(F.count("*").alias("events"), rounded(F.sum(F.pow(F.lit(decay), age)), 6).alias("score"))
            .filter(F.col("events") >= min_count)
            .select(F.unix_micros(F.col("w.start")).alias("window_start"), "product_id", "events", "score"))


def rank_windows(k: int = 10) -> Callable[[DataFrame], DataFrame]:
    return lambda batch: best_per(batch, "window_start", "score", "product_id", k)


def click_through(events: DataFrame, by: str = "engine", hours: int = 24, min_impressions: int = 10,
                  delay: str = "1 hour") -> DataFrame:
    flag = lambda kind: F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0))
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", f"{hours} hours").alias("w"), by)
            .agg(flag("view").alias("impressions"), flag("click").alias("clicks"))
            .filter(F.col("impressions") >= min_impressions)
            .select(F.unix_micros(F.col("w.start")).alias("window_start"), by, "impressions", "clicks",
                    rounded(F.col("clicks") / F.col("impressions"), 6).alias("ctr")))


def conversions(events: DataFrame, minutes: int = 30, delay: str = "1 hour") -> DataFrame:
    """(event_id, session_id, clicked_at, purchased_at) of every closed click, as the batch form: the
    session's first purchase within the window, or none.  Append mode.

    An outer interval join, whose state both watermarks bound, and a minimum per click that the
    watermark behind the join closes.  A click asks in each time slice its window reaches, so the state of
    one very long session lies on as many tasks as it has slices.
    """
    width = max(3600, minutes * 60)
    slice_of = lambda at: F.floor(F.unix_seconds(at) / width)
    clicks = events.filter("event_type = 'click'").select(
        "event_id", "session_id", F.col("ts").alias("click_ts")).withWatermark("click_ts", delay).withColumn(
            "slice", F.explode(F.sequence(slice_of(F.col("click_ts")), slice_of(F.col("click_ts") + F.expr(f"INTERVAL {minutes} MINUTES")))))
    buys = events.filter("event_type = 'purchase'").select(
        F.col("session_id").alias("buyer"), F.col("ts").alias("buy_ts"), slice_of(F.col("ts")).alias("buy_slice")
    ).withWatermark("buy_ts", delay)
    joined = clicks.join(buys, F.expr(
        "session_id = buyer AND slice = buy_slice AND buy_ts >= click_ts "
        f"AND buy_ts <= click_ts + INTERVAL {minutes} MINUTES"), "left_outer")
    return joined.groupBy("click_ts", "event_id", "session_id").agg(F.min("buy_ts").alias("first")).select(
        "event_id", "session_id", F.unix_micros("click_ts").alias("clicked_at"), F.unix_micros("first").alias("purchased_at"))


# ---------------------------------------------------------------- per micro-batch jobs


def check_drift(path: str) -> Callable[[DataFrame], DataFrame]:
    """Compare each micro-batch of catalogue rows with the stored baseline; the first one becomes it."""
    return lambda batch: drift.check(batch, path)


def recommend_touched(events: DataFrame, catalogue: DataFrame, vecs: DataFrame, k: int = 8) -> Callable[[DataFrame], DataFrame]:
    """For the sessions in a micro-batch, recommendations from their whole history in ``events``."""

    def job(batch: DataFrame) -> DataFrame:
        touched = batch.select("session_id").distinct()
        return personal.recommend_sessions(
            events.join(touched, "session_id", "left_semi"), touched, catalogue, vecs, k)

    return job
