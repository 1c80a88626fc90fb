import json

import pytest

from lexweft.sources import requests

FORM = 'multipart/form-data; boundary="b"'


def multipart(**fields):
    parts = "".join(f'--b\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n' for k, v in fields.items())
    return (parts + "--b--\r\n").encode()


def test_bodies():
    parse = requests.parse_body
    assert parse("application/json; charset=utf-8", '{"a": "é", "b": [1, "ñ"], "c": null, "a": "z"}'.encode()) == {"a": "z", "b": '[1, "ñ"]', "c": None}
    assert parse("application/x-www-form-urlencoded", "a=1&b=%C3%A9+x&a=2&c=".encode()) == {"a": "2", "b": "é x", "c": ""}
    assert parse("application/x-www-form-urlencoded", b"") == {}
    assert parse(FORM, multipart(filename="f.pdf", markdown="line 1\r\nñ")) == {"filename": "f.pdf", "markdown": "line 1\r\nñ"}
    for kind, body in (("application/json", b"[1]"), ("application/json", b"{"), ("application/json", b"\xff"), ("text/plain", b"x"), ("", b"x"), (FORM, b"x"), ("application/x-www-form-urlencoded", b"\xff=1")):
        with pytest.raises(ValueError):
            parse(kind, body)


def test_half_written_lines(tmp_path):
    log = requests.FolderLog(str(tmp_path))
    assert requests.FolderLog(str(tmp_path / "none")).ends() == {}
    log.append("a", "application/json", b"{}")
    whole = log.ends()["a"]
    with open(tmp_path / "a.log", "ab") as f:
        f.write(b"x" * 200_000)
    (tmp_path / "b.log").write_bytes(b"no line feed")
    assert log.ends() == {"a": whole, "b": 0}
    assert list(log.read("a", 0, whole)) == [(0, "application/json", b"{}")]


def run(spark, log, root, fail=False):
    """What is there, by batches that each replace their own output; ``fail``: a batch dies after it wrote."""

    def write(df, batch):
        df.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")
        if fail:
            raise RuntimeError("died")

    q = requests.read_requests(spark, log).writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_restart_loses_and_doubles_nothing(spark, tmp_path):
    log, root = requests.FolderLog(str(tmp_path / "log")), str(tmp_path)
    sent = []

    def send(partition, n):
        for _ in range(n):
            sent.append(str(len(sent)))
            kind, body = [
                ("application/json", json.dumps({"session_id": sent[-1], "message": "hola"}).encode()),
                ("application/x-www-form-urlencoded", f"session_id={sent[-1]}&message=hola".encode()),
                (FORM, multipart(session_id=sent[-1], message="hola")),
            ][len(sent) % 3]
            log.append(partition, kind, body)

    def got():
        return sorted((r.session_id for r in requests.chat_requests(spark.read.parquet(f"{root}/out")).where("status = 200").collect()), key=int)

    send("a", 5), send("b", 2)
    run(spark, log, root)
    assert got() == sent
    send("a", 3), send("c", 4)  # a partition that wasn't there before
    with pytest.raises(Exception, match="died"):
        run(spark, log, root, fail=True)
    send("b", 2)  # comes after the batch that died was planned
    run(spark, log, root)  # that batch again, and no more: this trigger runs one batch of such a source
    assert got() == sent[:-2]
    run(spark, log, root)
    assert got() == sent
    log.append("b", "text/plain", b"what?")
    log.append("b", "application/json", b'{"filename": "f"}')
    run(spark, log, root)
    assert got() == sent
    odd = requests.chat_requests(spark.read.parquet(f"{root}/out")).where("status = 422").orderBy("offset").collect()
    assert [(r.session_id, r.error) for r in odd] == [(None, "ValueError: content type text/plain"), (None, None)]
    forms = requests.metadata_requests(spark.createDataFrame([("a", 0, "", {"filename": "f", "markdown": "m"}, None)], requests.SCHEMA)).first()
    assert (forms.filename, forms.markdown, forms.fuente, forms.status) == ("f", "m", None, 200)
