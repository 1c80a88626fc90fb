"""Ingestion of source files in ordered steps that survive a crash between any two.

A micro-batch of files goes through steps: its files are listed with their content's
hash; those whose content is new are made into packages; Markdown, metadata and review
rows are written, in this order; the ledger learns the contents; and only then
the source files are moved to the archive, by the executors. Each step writes a
folder of its own for the batch, as a whole, and one that is there already is not
done again. A batch that runs again after a crash thus goes on at the step that
wasn't done, converts nothing twice, and needs no file that is moved already.

Content is told apart by its SHA-256: a file that comes again, or under another name,
within a batch or later, is not made into a package but moved like the others.

Folders below ``root``: listed, packages, markdown, metadata, review, ledger and
moved, each with ``batch=<number>``. Defined results for odd input: files that vanish before
they are listed fail the batch, as they do any of Spark's sources; an empty file is content
like any other; a file whose name the archive has already replaces it.
"""

import posixpath
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweft.sources.sinks import OUTPUTS

STEPS = ("listed", "packages", *(folder for folder, _, _ in OUTPUTS), "ledger", "moved")


def done(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written as a whole."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """``(content_sha256, path, batch)`` of all contents that went through; empty at first."""
    try:
        return spark.read.parquet(f"{root}/ledger").select("content_sha256", "path", "batch")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], "content_sha256 string, path string, batch long")


def listing(files: DataFrame, known: DataFrame) -> DataFrame:
    """``(path, filename, content_sha256, fresh)``: whether a file is the first with a content that ``known`` doesn't have."""
    hashed = files.select("path", "filename", F.sha2("content", 256).alias("content_sha256"))
    first = F.row_number().over(Window.partitionBy("content_sha256").orderBy("path")) == 1
    seen = known.select("content_sha256", F.lit(True).alias("seen")).distinct()
    return hashed.withColumn("first", first).join(seen, "content_sha256", "left").select("path", "filename", "content_sha256", (F.col("first") & F.col("seen").isNull()).alias("fresh"))


def move(paths: DataFrame, archive: str) -> DataFrame:
    """Moves the files of ``paths`` (path, filename) below ``archive`` where their rows lie; ``(path, target)`` of all, those moved before too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            targets = []
            for path, name in zip(pdf["path"], pdf["filename"]):
                files, source = _opened(fs, path)
                _, folder = _opened(fs, archive)
                target = posixpath.join(folder, name)
                files.create_dir(folder)
                # The source is gone if a task that died had moved it.
                if files.get_file_info(source).type != fs.FileType.NotFound:
                    files.move(source, target)
                elif files.get_file_info(target).type == fs.FileType.NotFound:
                    raise FileNotFoundError(path)
                targets.append(target)
            yield pd.DataFrame({"path": pdf["path"], "target": targets}, dtype=object)

    return paths.select("path", "filename").mapInPandas(run, "path string, target string")


def _opened(fs, path: str):
    """Arrow's file system and the path within it; Spark writes local paths as file:/x."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote("/" + path.removeprefix("file:").lstrip("/"))
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def process_batch(files: DataFrame, batch: int, make: Callable[[DataFrame], DataFrame], root: str, archive: str) -> None:
    """All steps of one batch of ``files`` (path, filename, content); see the module."""
    spark = files.sparkSession
    at = {step: f"{root}/{step}/batch={batch}" for step in STEPS}

    def step(name: str, table: Callable[[], DataFrame]) -> DataFrame:
        if not done(spark, at[name]):
            table().write.mode("overwrite").parquet(at[name])
        return spark.read.parquet(at[name])

    listed = step("listed", lambda: listing(files, ledger(spark, root)))
    fresh = listed.where("fresh")
    packages = step("packages", lambda: make(files.join(fresh.select("path"), "path", "left_semi")))
    for folder, name, value in OUTPUTS:
        step(folder, lambda n=name, v=value: packages.select(F.col(n).alias("name"), F.col(v).alias("value")))
    step("ledger", lambda: fresh.select("content_sha256", "path"))
    step("moved", lambda: move(listed, archive))


def ingest_documents(files: DataFrame, make: Callable[[DataFrame], DataFrame], root: str, archive: str, checkpoint: str):
    """A query over the stream ``files`` (path, filename, content) that takes what is there through all steps; returns it started.

    ``make`` turns files into packages (markdown_name, markdown, metadata_name,
    metadata_json, review_name, review_json, and any more).
    """
    query = files.writeStream.foreachBatch(lambda df, batch: process_batch(df, batch, make, root, archive))
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
