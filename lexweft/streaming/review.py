"""The pause for a human review, as keyed state: a package waits for its decision and goes on once.

Packages and decisions are streams of their own; both are keyed by document_id. A
package stays in state until a final decision is there, whichever came first,
or until ``wait_ms`` have gone, when it goes on as expired. What comes later for
the same document within ``tombstone_ms`` is ignored.
"""

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lexweft.streaming.jobs import DAY_MS, use_rocksdb

#: Decisions that end the pause; others (a request for changes, say) leave it.
FINAL = ("approved", "rejected")
OUT_SCHEMA = "document_id string, package string, review string, waited_ms long"


class Pause(StatefulProcessor):
    def __init__(self, wait_ms: int, tombstone_ms: int):
        self.wait_ms, self.tombstone_ms = wait_ms, tombstone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.package = handle.getValueState("package", "package string, at long")
        # Of a document whose package never comes, the decision goes.
        self.decision = handle.getValueState("decision", "decision string", ttlDurationMs=self.tombstone_ms)
        self.gone = handle.getValueState("gone", "at long", ttlDurationMs=self.tombstone_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        found = list(rows)
        if self.gone.exists():
            return
        packages = sorted(r.package for r in found if r.package is not None)
        if packages and not self.package.exists():
            self.package.update((packages[0], now))
            self.handle.registerTimer(now + self.wait_ms)
        # Of decisions that come in one batch, the least ``seq`` was first.
        final = sorted(((r.seq is None, r.seq or 0, r.decision) for r in found if r.decision in FINAL))
        if final and not self.decision.exists():
            self.decision.update((final[0][2],))
        if self.package.exists() and self.decision.exists():
            yield self._on(key, self.decision.get()[0], now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.package.exists():
            yield self._on(key, "expired", timerValues.getCurrentProcessingTimeInMs())

    def _on(self, key: tuple, review: str, now: int) -> Row:
        package, since = self.package.get()
        self.package.clear()
        self.decision.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.gone.update((now,))
        return Row(document_id=key[0], package=package, review=review, waited_ms=now - since)

    def close(self) -> None:
        pass


def await_reviews(packages: DataFrame, reviews: DataFrame, wait_ms: int = 7 * DAY_MS, tombstone_ms: int = 30 * DAY_MS) -> DataFrame:
    """Each of the stream ``packages`` (document_id and any columns, which become the JSON ``package``) once it is decided on or expired.

    ``reviews``: document_id, decision, seq. Rows without a document_id are left out, as no
    decision can be told to be theirs.
    """
    use_rocksdb(packages.sparkSession)
    none = F.lit(None)
    made = packages.select("document_id", F.to_json(F.struct(*packages.columns), {"ignoreNullFields": "false"}).alias("package"), none.cast("string").alias("decision"), none.cast("long").alias("seq"))
    said = reviews.select("document_id", none.cast("string").alias("package"), "decision", F.col("seq").cast("long"))
    both = made.unionByName(said).where("document_id IS NOT NULL")
    return both.groupBy("document_id").transformWithState(Pause(wait_ms, tombstone_ms), OUT_SCHEMA, "append", "ProcessingTime")
