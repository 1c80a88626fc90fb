import json
import os
import subprocess
import sys

import pytest

from lexweft.sources import store

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def folder_store(folder, looks=0):
    """A store whose uploads are files named by key; an operation is done after so many looks. A file ``crash`` ends the worker right after an upload."""
    folder = str(folder)
    os.makedirs(folder, exist_ok=True)

    class Store:
        def _log(self, what, key):
            with open(f"{folder}/log", "a") as f:
                f.write(f"{what} {key}\n")

        def find(self, store_, key):
            path = f"{folder}/{store_}-{key}.json"
            return (f"op-{key}", self._done(key)) if os.path.exists(path) else None

        def upload(self, store_, key, name, markdown, pairs):
            if markdown == "boom":
                raise RuntimeError("quota")
            with open(f"{folder}/{store_}-{key}.json", "w") as f:
                json.dump([name, markdown, pairs], f)
            self._log("upload", key)
            if os.path.exists(f"{folder}/crash"):
                os.remove(f"{folder}/crash")
                os._exit(1)
            return f"op-{key}", looks == 0

        def _done(self, key):
            with open(f"{folder}/log") as f:
                return f.read().split("\n").count(f"look {key}") >= looks

        def done(self, operation):
            self._log("look", operation[3:])
            return self._done(operation[3:])

        def cancel(self, operation):
            self._log("cancel", operation[3:])

    return Store()


def logged(folder, what):
    with open(f"{folder}/log") as f:
        return sorted(x.split()[1] for x in f if x.startswith(what))


def documents(spark, n=6):
    rows = [(f"d{i}", f"{i}.md", f"s{i % 2}", None if i == 3 else f"text {i}", [("k", f"v{i}")] if i else None) for i in range(n)]
    return spark.createDataFrame(rows, store.DOCUMENT)


def test_uploads_once(spark, tmp_path):
    docs = documents(spark)
    twice = docs.union(docs).selectExpr("*", "1 AS more")
    store.write_store(twice, folder_store(tmp_path, looks=2), every=0.0)
    assert logged(tmp_path, "upload") == [f"d{i}" for i in range(6)]
    with open(tmp_path / "s1-d3.json") as f:
        assert json.load(f) == ["3.md", "", [["k", "v3"]]]
    store.write_store(documents(spark, 8), folder_store(tmp_path, looks=2), every=0.0)
    assert logged(tmp_path, "upload") == [f"d{i}" for i in range(8)]
    store.write_store(docs.limit(0), folder_store(tmp_path))


def test_many_open_operations(spark, tmp_path):
    store.write_store(documents(spark, 30).coalesce(1), folder_store(tmp_path, looks=3), every=0.0, open_most=4)
    assert set(logged(tmp_path, "look")) == {f"d{i}" for i in range(30)}


def test_deadline_and_abort(spark, tmp_path):
    with pytest.raises(Exception, match="no termino en 1 segundos"):
        store.write_store(documents(spark, 2), folder_store(tmp_path, looks=10**9), most=1, every=0.1)
    assert logged(tmp_path, "cancel") == ["d0", "d1"]
    store.write_store(documents(spark, 2), folder_store(tmp_path / "other", looks=10**9), wait=False)  # not waited for
    with pytest.raises(ValueError, match="between 1 and 3600"):
        store.StoreWriter(None, True, 0, 1, 1)


def test_failed_uploads(spark, tmp_path):
    bad = documents(spark, 1).selectExpr("document_id", "filename", "store", "'boom' AS markdown", "array(struct('k' AS key, 'ñ' AS string_value)) AS custom_metadata")
    with pytest.raises(Exception, match='quota; custom_metadata_sent=.*"length": 1, "value": "ñ"'):
        store.write_store(bad, folder_store(tmp_path))
    with pytest.raises(Exception, match="needs a document_id"):
        store.write_store(documents(spark, 1).selectExpr("document_id", "filename", "NULL AS store", "markdown", "custom_metadata"), folder_store(tmp_path))


def test_a_write_that_died_runs_again(spark, tmp_path):
    (tmp_path / "crash").write_text("")
    with pytest.raises(Exception):  # noqa: B017  the worker died; this session doesn't retry tasks
        store.write_store(documents(spark), folder_store(tmp_path, looks=1), every=0.0)
    assert 1 <= len(logged(tmp_path, "upload")) < 7
    store.write_store(documents(spark), folder_store(tmp_path, looks=1), every=0.0)
    assert logged(tmp_path, "upload") == [f"d{i}" for i in range(6)]


def test_a_task_that_died_runs_again(tmp_path):
    """In a session of its own, where Spark runs a failed task again within the write."""
    (tmp_path / "crash").write_text("")
    script = f"""
import sys
sys.path[:0] = [{ROOT!r}, {ROOT + "/tests"!r}]
from pyspark.sql import SparkSession
import test_store as t
spark = SparkSession.builder.master("local[2,4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
t.store.write_store(t.documents(spark), t.folder_store({str(tmp_path)!r}, looks=1), every=0.0)
"""
    done = subprocess.run([sys.executable, "-c", script], env=os.environ | {"PYTHONPATH": f"{ROOT}:{ROOT}/tests"}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert not (tmp_path / "crash").exists() and logged(tmp_path, "upload") == [f"d{i}" for i in range(6)]
