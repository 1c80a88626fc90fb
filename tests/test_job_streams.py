import json
import os
import time

import pytest

from lexweft.streaming.jobs import poll_jobs, track_jobs

EVENT = "job_id string, seq long, status string, filename string, result string, error string"


class Feed:
    """A stream of JSON rows that arrive file by file, and the rows that come out, kept through restarts of the query."""

    def __init__(self, spark, root, schema, make):
        self.spark, self.root, self.schema, self.make, self.out, self.n = spark, str(root), schema, make, [], 0
        os.makedirs(f"{self.root}/in", exist_ok=True)

    def send(self, *rows):
        path = f"{self.root}/in/.{self.n}"
        with open(path, "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.rename(path, f"{self.root}/in/{self.n}.json")
        self.n += 1

    def start(self):
        made = self.make(self.spark.readStream.schema(self.schema).json(f"{self.root}/in"))
        mode = "update" if self.make.__name__ == "states" else "append"
        take = lambda df, i: self.out.extend(df.collect())
        self.query = made.writeStream.foreachBatch(take).outputMode(mode).option("checkpointLocation", f"{self.root}/cp").trigger(processingTime="200 milliseconds").start()

    def until(self, found, seconds=90):
        end = time.time() + seconds
        while not found(self.out):
            assert self.query.exception() is None and time.time() < end, (self.query.exception(), self.out)
            time.sleep(0.1)

    def stop(self):
        self.query.stop()
        self.query.awaitTermination(30)

    def state_rows(self):
        return sum(s["numRowsTotal"] for s in self.query.lastProgress["stateOperators"])


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    yield
    spark.conf.set(name, before)


def test_states_restart_late_rows_and_timeout(spark, tmp_path, rocksdb):
    def states(events):
        return track_jobs(events, ttl_ms=30_000)

    feed = Feed(spark, tmp_path, EVENT, states)
    feed.send({"job_id": "a", "seq": 0, "status": "queued", "filename": "a.pdf"}, {"job_id": "b", "seq": 2, "status": "running"}, {"job_id": "b", "seq": 1, "status": "queued", "filename": "b.pdf"}, {"job_id": "n", "status": "queued"})
    feed.start()
    feed.until(lambda out: {r.job_id for r in out} >= {"a", "b"})
    assert {(r.job_id, r.status, r.filename, r.done) for r in feed.out} == {("a", "queued", "a.pdf", False), ("b", "running", "b.pdf", False)}
    feed.stop()
    feed.start()  # state comes from the checkpoint
    feed.send({"job_id": "a", "seq": 3, "status": "succeeded", "result": "{}"}, {"job_id": "b", "seq": 1, "status": "queued"})
    feed.until(lambda out: any(r.done for r in out))
    ended = next(r for r in feed.out if r.done)
    assert (ended.job_id, ended.status, ended.filename, ended.result, ended.updated_at >= ended.created_at) == ("a", "succeeded", "a.pdf", "{}", True)
    # An older event changes nothing; the first batch may have come again with the restart.
    assert {(r.status, r.seq) for r in feed.out if r.job_id == "b"} == {("running", 2)}
    feed.send({"job_id": "a", "seq": 9, "status": "running"})  # late: the job has ended
    feed.until(lambda out: any(r.job_id == "b" and r.done for r in out))
    lost = next(r for r in feed.out if r.job_id == "b" and r.done)
    assert (lost.status, lost.seq, lost.filename, lost.error) == ("failed", 2, "b.pdf", "TimeoutError: sin eventos en 30000 ms")
    feed.send({"job_id": "b", "seq": 7, "status": "succeeded"}, {"job_id": "c", "seq": 1, "status": "failed", "error": "E: x"})
    feed.until(lambda out: any(r.job_id == "c" for r in out))
    feed.stop()
    assert [r.job_id for r in feed.out if r.done] == ["a", "b", "c"] and not [r for r in feed.out if r.job_id == "a" and r.seq == 9]


def test_polling_until_the_third_look(spark, tmp_path, rocksdb):
    looks = str(tmp_path / "looks")

    def ask(job):
        with open(looks, "a") as f:
            f.write(job + "\n")
        with open(looks) as f:
            n = f.read().split("\n").count(job)
        if job == "down":
            raise ConnectionError("no")
        return ("succeeded", "{}", None) if n >= 3 else ("running", None, None)

    def polled(started):
        return poll_jobs(started, ask, every_ms=300, most=5, tombstone_ms=2_000)

    feed = Feed(spark, tmp_path, "job_id string", polled)
    feed.send({"job_id": "x"}, {"job_id": "x"}, {"job_id": "down"})
    feed.start()
    feed.until(lambda out: len(out) == 2)
    got = {r.job_id: (r.status, r.result, r.error, r.looks) for r in feed.out}
    assert got == {"x": ("succeeded", "{}", None, 3), "down": ("failed", None, "ConnectionError: no", 5)}
    end = time.time() + 60
    while feed.state_rows() and time.time() < end:  # tombstones go when their time is up
        time.sleep(0.3)
    assert feed.state_rows() == 0 and len(feed.out) == 2
    feed.stop()
