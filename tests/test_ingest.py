import os

import pytest
from pyspark.sql import functions as F

from lexweft.functions import text
from lexweft.operators.documents import output_names
from lexweft.sources.files import stream_files
from lexweft.streaming import ingest


def pipeline(spark, root):
    """``run(crash)``: takes what is there through all steps; with ``crash``, dies right after that step. And how often files were converted."""
    converted = spark.sparkContext.accumulator(0)

    def make(files):
        def convert(batches):
            for pdf in batches:
                converted.add(len(pdf))
                pdf["markdown"] = [c.decode() + "\n" for c in pdf.pop("content")]
                yield pdf

        named = files.select("filename", "content", text.document_id(F.col("filename"), F.col("content")).alias("document_id"))
        done = named.mapInPandas(convert, "filename string, document_id string, markdown string")
        return done.select("*", *output_names(F.col("document_id")), F.lit("{}").alias("metadata_json"), F.concat(F.lit("review "), "filename").alias("review_json"))

    def run(crash=None):
        real = ingest.done
        after = dict(zip(ingest.STEPS, ingest.STEPS[1:]))
        dying = after.get(crash)

        def until(spark_, path):
            if dying and f"/{dying}/" in path:
                raise RuntimeError("crash")
            return real(spark_, path)

        ingest.done = until
        try:
            ingest.ingest_documents(stream_files(spark, f"{root}/in"), make, f"{root}/out", f"{root}/archive", f"{root}/cp").awaitTermination(120)
        finally:
            ingest.done = real

    return run, converted


def put(root, **files):
    os.makedirs(f"{root}/in", exist_ok=True)
    for name, content in files.items():
        with open(f"{root}/in/{name}.pdf", "w") as f:
            f.write(content)


def outputs(spark, root):
    return {f: sorted((r.name.partition("-")[0], r.value) for r in spark.read.parquet(f"{root}/out/{f}").collect()) for f in ("markdown", "review")}


def test_same_end_whatever_step_it_dies_after(spark, tmp_path):
    root = str(tmp_path)
    run, converted = pipeline(spark, root)
    put(root, a="one", b="two", copy="one")
    for step in ingest.STEPS[:-1]:
        with pytest.raises(Exception, match="crash"):
            run(step)
        assert sorted(os.listdir(f"{root}/in")) == ["a.pdf", "b.pdf", "copy.pdf"]  # moved last of all
    # A task that moved a file and died before it was committed.
    os.makedirs(f"{root}/archive")
    os.rename(f"{root}/in/b.pdf", f"{root}/archive/b.pdf")
    run()
    want = {"markdown": [("a", "one\n"), ("b", "two\n")], "review": [("a", "review a.pdf"), ("b", "review b.pdf")]}
    assert outputs(spark, root) == want and converted.value == 2
    assert os.listdir(f"{root}/in") == [] and sorted(os.listdir(f"{root}/archive")) == ["a.pdf", "b.pdf", "copy.pdf"]
    put(root, again="two", new="three")  # a content that was there before, by another name
    run()
    want["markdown"].append(("new", "three\n")), want["review"].append(("new", "review new.pdf"))
    assert outputs(spark, root) == want and converted.value == 3
    assert sorted(r.path.rpartition("/")[2] for r in ingest.ledger(spark, f"{root}/out").collect()) == ["a.pdf", "b.pdf", "new.pdf"]
    assert os.listdir(f"{root}/in") == []


def test_a_file_that_is_lost(spark, tmp_path):
    paths = spark.createDataFrame([(f"file:{tmp_path}/none.pdf", "none.pdf")], "path string, filename string")
    with pytest.raises(Exception, match="FileNotFoundError"):
        ingest.move(paths, str(tmp_path / "archive")).collect()
    assert ingest.ledger(spark, str(tmp_path)).count() == 0
