"""Continuous forms of the batch operators.

State that must last forever (receipts, attempts) lives in tables written per micro-batch under the batch's own id, so
a batch that is run again after a failure replaces its own rows and nothing else. State with a natural end (a frame
session, a file that is still growing) lives in the state store and leaves with a timeout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import delivery, intake
from ..operators.frames import MAX_FRAMES
from ..sources.messages import directory_stream

INCOMPLETE = "INCOMPLETE_TRANSMISSION"
BUCKETS = 64  # of the attempt log, by a hash of the delivery


def _per_batch(stream: DataFrame, checkpoint: str, action: Callable[[DataFrame, int], None], once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _write_batch(rows: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    rows.drop("batch_id").write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/batch_id={batch_id}")


def newest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest micro-batch of a table that every batch writes whole."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch_id")).first()[0]
    return rows.filter(F.col("batch_id") == last).drop("batch_id")


def file_intake(spark: SparkSession, directory: str, glob: str, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """New files of a directory, each once."""
    files = directory_stream(spark, directory, glob).select("path", "name", "length", "modified_at")
    return _per_batch(files, checkpoint, lambda rows, n: _write_batch(rows, target, n), once)


def receipts(messages: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """One receipt per source and content, however often a message is sent or a batch is replayed.

    The receipts seen so far are keys in the state store; no batch reads the stored table again.
    """
    fresh = intake.with_receipt(messages).dropDuplicates(["receipt_id"])
    return _per_batch(fresh, checkpoint, lambda rows, n: _write_batch(rows, target, n), once)


SESSION_BUCKETS = 4096  # sessions share a group by a hash of their id: a group of its own for each costs more than its frames
SESSION_STATE = ("session_id ARRAY<STRING>, expected ARRAY<INT>, previous ARRAY<STRING>, text ARRAY<STRING>, frames ARRAY<INT>, "
                 "final ARRAY<BOOLEAN>, deadline ARRAY<LONG>")
SESSION_OUT = "session_id STRING, raw_text STRING, n_frames INT, state STRING"


def _sessions(timeout_ms: int | None):
    """Folds the frames of the sessions of a bucket (without a session_id column: of the session that is the key)."""
    columns = ("seq", "kind", "frame_no", "text", "terminator", "checksum", "issue")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = {name: tuple(rest) for name, *rest in zip(*state.get, strict=True)} if state.exists else {}
        now = state.getCurrentProcessingTimeMs() if timeout_ms is not None else None
        arrived: dict[str, list[tuple]] = {}
        if not state.hasTimedOut:
            for data in batches:
                names = data["session_id"].tolist() if "session_id" in data else [key[0]] * len(data)
                for name, *row in zip(names, *(data[c].tolist() for c in columns), strict=True):
                    arrived.setdefault(name, []).append(row)
        out = []
        if now is not None:  # also where the bucket has frames of other sessions
            for name in [n for n, held in waiting.items() if n not in arrived and held[-1] <= now]:
                _, _, text, frames, _, _ = waiting.pop(name)
                out.append((name, text, frames, INCOMPLETE))
        for name, rows in arrived.items():
            expected, previous, text, frames, final, _ = waiting.pop(name, (1, None, "", 0, False, None))
            rows.sort(key=lambda row: row[0])
            for _, kind, frame_no, part, terminator, checksum, issue in rows:
                if kind == "EOT":  # what follows is the session's next transmission
                    if frames:
                        out.append((name, text, frames, "COMPLETE" if final and frames <= MAX_FRAMES else INCOMPLETE))
                    expected, previous, text, frames, final = 1, None, "", 0, False
                    continue
                if issue is not None:
                    continue
                signature = f"{int(frame_no)}\x01{part}\x01{terminator}\x01{checksum}"
                if frame_no == (expected + 7) % 8 and signature == previous:
                    continue
                if frame_no == expected:
                    # Beyond the limit frames are counted, not kept: the transmission is incomplete.
                    text = text + part if frames < MAX_FRAMES else text
                    expected, previous, frames, final = (expected + 1) % 8, signature, frames + 1, terminator == "ETX"
            if frames:
                waiting[name] = (expected, previous, text, frames, final, 0 if now is None else now + timeout_ms)
        if waiting:
            state.update(tuple(map(list, zip(*((name, *held) for name, held in waiting.items()), strict=True))))
            if now is not None:
                state.setTimeoutDuration(max(1, min(held[-1] for held in waiting.values()) - now))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["session_id", "raw_text", "n_frames", "state"])

    return fold


def _timeout(timeout_ms: int | None) -> str:
    """A stream with timers never runs dry, so a run that must end by itself keeps none."""
    return GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def frame_sessions(frames: DataFrame, timeout_ms: int | None = 60_000) -> DataFrame:
    """Frames -> messages. Needs session_id, seq, kind (FRAME or EOT), frame_no, text, terminator, checksum, issue.

    A transmission ends with EOT, or after the receive timeout as incomplete; a session may send several. What one session holds is
    bounded by the frame limit. The state store's keys are ``SESSION_BUCKETS`` buckets of sessions; a bucket holds its open sessions.
    """
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(SESSION_BUCKETS))
    return frames.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(
        _sessions(timeout_ms), SESSION_OUT, SESSION_STATE, "append", _timeout(timeout_ms))


def delivery_states(events: DataFrame, log_path: str, state_path: str, checkpoint: str, max_attempts: int = delivery.MAX_ATTEMPTS,
                    once: bool = True) -> StreamingQuery:
    """Attempts and operator actions -> state and next attempt time of every delivery they touch.

    The batch fold itself is used: each micro-batch appends to the log and folds again the deliveries it names, reading the log's buckets
    (by a hash of the delivery) that hold them.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64("delivery_id"), F.lit(BUCKETS)).cast("int"))
        _write_batch(bucketed, log_path, batch_id, "bucket")
        own = spark.read.parquet(f"{log_path}/batch_id={batch_id}")
        touched = own.select("delivery_id", "bucket").distinct()
        buckets = [r["bucket"] for r in touched.select("bucket").distinct().collect()]  # at most BUCKETS numbers
        log = spark.read.parquet(log_path).filter((F.col("batch_id") <= batch_id) & F.col("bucket").isin(buckets)).drop("batch_id", "bucket")
        states = delivery.states(log.join(touched.select("delivery_id"), "delivery_id", "left_semi"), max_attempts)
        _write_batch(states, state_path, batch_id)

    return _per_batch(events, checkpoint, fold, once)


def current_states(spark: SparkSession, state_path: str) -> DataFrame:
    """Newest state of each delivery."""
    rows = spark.read.parquet(state_path)
    kept = [c for c in rows.columns if c not in ("delivery_id", "batch_id")]
    return rows.groupBy("delivery_id").agg(F.max_by(F.struct(*kept), "batch_id").alias("s")).select("delivery_id", "s.*")


FILE_STATE = "size LONG, mtime LONG"
FILE_OUT = "path STRING, observed_at TIMESTAMP, stable BOOLEAN"


def _stability(forget_ms: int | None):
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        noted = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("observed_at")
        out = []
        for size, mtime_at, seen_at in zip(rows["bytes"], rows["mtime"], rows["observed_at"], strict=True):
            mtime, seen = int(mtime_at.timestamp() * 1000), int(seen_at.timestamp() * 1000)
            quiet = seen - mtime >= delivery.FILE_QUIET_MS
            same = noted is not None and noted[0] == size and abs(mtime - noted[1]) <= delivery.FILE_DRIFT_MS
            out.append(bool(quiet and same))
            noted = (int(size), mtime)
        state.update(noted)
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame({"path": [key[0]] * len(out), "observed_at": rows["observed_at"].to_numpy(), "stable": out})

    return fold


def file_stability(observations: DataFrame, forget_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """Whether each observation of a growing file finds it settled. Needs path, size, mtime, observed_at."""
    rows = observations.withColumnRenamed("size", "bytes")
    return rows.groupBy("path").applyInPandasWithState(
        _stability(forget_ms), FILE_OUT, FILE_STATE, "append", _timeout(forget_ms))


def hand_off(deliveries: DataFrame, waiting: str, target: str, checkpoint: str, now, once: bool = True) -> StreamingQuery:
    """Due deliveries to the sink table, each attempt once. Needs delivery_id, attempts and what ``delivery.due`` reads.

    Attempts seen before are keys in the state store. Work that is not due yet is written beside the sink and read again by the next batch only,
    so it goes out with the first batch at whose time it is due; of several attempts of one delivery the newest waits.
    """

    def send(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch if batch_id == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{waiting}/batch_id={batch_id - 1}"))
        others = [c for c in rows.columns if c != "delivery_id"]
        rows = rows.groupBy("delivery_id").agg(F.max_by(F.struct(*others), "attempts").alias("d")).select("delivery_id", "d.*")
        ready = delivery.due(rows, now())
        _write_batch(ready.select("delivery_id", "attempts", "connection_id", "state"), target, batch_id)
        held = rows.filter(F.col("state").isin(*delivery.DISPATCHABLE)).join(ready.select("delivery_id"), "delivery_id", "left_anti")
        _write_batch(held.select(*batch.columns), waiting, batch_id)

    return _per_batch(deliveries.dropDuplicates(["delivery_id", "attempts"]), checkpoint, send, once)


def running_counters(messages: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Received counter, written whole with every batch; ``newest`` reads it."""
    counts = messages.groupBy("protocol", "transport").agg(F.count("*").alias("n"))
    writer = counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, n: _write_batch(rows, target, n))
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_throughput(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """L20 over a stream; rows later than ``delay`` are dropped."""
    from ..operators import reports

    return reports.throughput(messages.withWatermark("received_at", delay))
