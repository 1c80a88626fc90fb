import json
import time

from test_job_streams import Feed, rocksdb  # noqa: F401  a fixture

from lexweft.streaming.review import await_reviews

SHAPE = "document_id string, filename string, pages int, decision string, seq long"


def test_a_package_waits_and_goes_on_once(spark, tmp_path, rocksdb):  # noqa: F811
    def waiting(rows):
        return await_reviews(rows.where("filename IS NOT NULL").select("document_id", "filename", "pages"), rows.where("decision IS NOT NULL").select("document_id", "decision", "seq"), wait_ms=40_000)

    feed = Feed(spark, tmp_path, SHAPE, waiting)
    package = lambda d: {"document_id": d, "filename": f"{d}.pdf"}
    review = lambda d, decision, seq=1: {"document_id": d, "decision": decision, "seq": seq}
    feed.send(package("a"), package("b"), review("early", "rejected"), review("a", "changes"), package(None), review(None, "approved"))
    feed.start()
    time.sleep(3)
    assert feed.out == []
    feed.stop()
    feed.start()  # those that wait come from the checkpoint
    feed.send(review("a", "approved", 3), review("a", "rejected", 2), package("early"), package("early"))
    feed.until(lambda out: len(out) >= 2)
    feed.send(review("a", "approved", 4), package("a"))  # the document has gone on already
    feed.until(lambda out: any(r.document_id == "b" for r in out))
    feed.send(review("b", "approved"))
    time.sleep(2)
    feed.stop()
    got = {r.document_id: (json.loads(r.package), r.review) for r in feed.out}
    shown = lambda d: {"document_id": d, "filename": f"{d}.pdf", "pages": None}
    assert got == {"a": (shown("a"), "rejected"), "early": (shown("early"), "rejected"), "b": (shown("b"), "expired")} and len(feed.out) == 3
    assert all(r.waited_ms >= 40_000 for r in feed.out if r.document_id == "b")
