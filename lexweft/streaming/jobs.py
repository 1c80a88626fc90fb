"""Streams of conversion jobs: their states, and the loop that asks for pending ones.

Both keep a job's state by ``transformWithState``, in RocksDB, with timers of
processing time. A job that has ended leaves a tombstone for ``tombstone_ms``, so
a late row doesn't start it again; both go by a time to live, so state stays bounded.
"""

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
TERMINAL = ("succeeded", "failed")
#: How long a job is left alone between looks.
POLL_MS = 30_000
OUT_SCHEMA = "job_id string, seq long, status string, filename string, result string, error string, created_at long, updated_at long, done boolean"
POLLED_SCHEMA = "job_id string, status string, result string, error string, looks int"


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and several states for a key need this state store; a setting of the session."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class JobStates(StatefulProcessor):
    """The state of a job: what of its events counts is the one with the largest ``seq``."""

    def __init__(self, ttl_ms: int, tombstone_ms: int):
        self.ttl_ms, self.tombstone_ms = ttl_ms, tombstone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Values outlive the timer that ends them, by which they are told from lost ones.
        self.job = handle.getValueState("job", "seq long, status string, filename string, result string, error string, created_at long, updated_at long", ttlDurationMs=2 * self.ttl_ms)
        self.ended = handle.getValueState("ended", "at long", ttlDurationMs=self.tombstone_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        events = sorted((r for r in rows if r.seq is not None), key=lambda r: r.seq)
        if self.ended.exists() or not events:
            return
        state = self.job.get() if self.job.exists() else None
        seq, status, filename, result, error, created = (*state[:6],) if state else (-1, None, None, None, None, now)
        for e in events:
            # An event without these fields leaves what earlier ones said.
            if e.seq > seq:
                seq, status = e.seq, e.status
                filename, result, error = e.filename or filename, e.result or result, e.error or error
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        done = status in TERMINAL
        if done:
            self._end(now)
        else:
            self.job.update((seq, status, filename, result, error, created, now))
            self.handle.registerTimer(now + self.ttl_ms)
        yield Row(job_id=key[0], seq=seq, status=status, filename=filename, result=result, error=error, created_at=created, updated_at=now, done=done)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.job.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        seq, _, filename, _, _, created, _ = self.job.get()
        self._end(now)
        said = f"TimeoutError: sin eventos en {self.ttl_ms} ms"
        yield Row(job_id=key[0], seq=seq, status="failed", filename=filename, result=None, error=said, created_at=created, updated_at=now, done=True)

    def _end(self, now: int) -> None:
        self.job.clear()
        self.ended.update((now,))

    def close(self) -> None:
        pass


def track_jobs(events: DataFrame, ttl_ms: int = DAY_MS, tombstone_ms: int = DAY_MS) -> DataFrame:
    """The state of each job after each batch of ``events`` (job_id, seq, status, and filename, result and error if there are), in whatever order they come.

    A job that sees no event for ``ttl_ms`` ends as failed. What comes for an
    ended job within ``tombstone_ms`` is ignored. Rows with a null ``seq`` are ignored; of a
    null job_id there is one job.
    """
    use_rocksdb(events.sparkSession)
    said = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in ("filename", "result", "error")]
    own = events.select("job_id", F.col("seq").cast("long"), "status", *said)
    return own.groupBy("job_id").transformWithState(JobStates(ttl_ms, tombstone_ms), OUT_SCHEMA, "update", "ProcessingTime")


class Polling(StatefulProcessor):
    """Asks for a job again and again until it has ended."""

    def __init__(self, ask: Callable[[str], tuple[str, str | None, str | None]], every_ms: int, most: int | None, tombstone_ms: int):
        self.ask, self.every_ms, self.most, self.tombstone_ms = ask, every_ms, most, tombstone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.looks = handle.getValueState("looks", "n int")
        self.ended = handle.getValueState("ended", "at long", ttlDurationMs=self.tombstone_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for _ in rows:
            pass
        if not self.ended.exists() and not self.looks.exists():
            self.looks.update((0,))
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.every_ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.looks.exists():
            return
        looks = self.looks.get()[0] + 1
        now = timerValues.getCurrentProcessingTimeInMs()
        try:
            status, result, error = self.ask(key[0])
        except Exception as e:  # noqa: BLE001  a look that fails is one more pending look
            status, result, error = "pending", None, f"{type(e).__name__}: {e}"
        if status not in TERMINAL and self.most and looks >= self.most:
            status, error = "failed", error or f"TimeoutError: {looks} consultas"
        if status in TERMINAL:
            self.looks.clear()
            self.ended.update((now,))
            yield Row(job_id=key[0], status=status, result=result, error=error, looks=looks)
        else:
            self.looks.update((looks,))
            self.handle.registerTimer(now + self.every_ms)

    def close(self) -> None:
        pass


def poll_jobs(started: DataFrame, ask: Callable[[str], tuple[str, str | None, str | None]], every_ms: int = POLL_MS, most: int | None = None, tombstone_ms: int = DAY_MS) -> DataFrame:
    """Each job of the stream ``started`` (job_id) once it has ended, with how many looks that took.

    ``ask`` gives (status, result, error) of a job; it is called every ``every_ms``
    until that is succeeded or failed, ``most`` times at most. One that raises
    counts as a look. Jobs that are started again while they are asked for, or
    within ``tombstone_ms`` of their end, are not asked for anew. A batch that runs again
    after a failure asks again; asking changes nothing.
    """
    use_rocksdb(started.sparkSession)
    return started.groupBy("job_id").transformWithState(Polling(ask, every_ms, most, tombstone_ms), POLLED_SCHEMA, "append", "ProcessingTime")


def ingest(files: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``process(batch, batch_id)`` for each micro-batch of a file stream, until what is there is done.

    A batch may come again after a failure, so ``process`` should write by
    batch_id or by document_id.
    """
    return files.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
