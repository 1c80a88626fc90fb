"""Requests as a stream: chat and form bodies from a partitioned log, with offsets and replay.

``request_format(log)`` makes a streaming data source. A log has partitions, and
in each, bodies at growing offsets; a batch is a range of offsets for each
partition, which Spark keeps in the query's checkpoint, so a batch that runs again
reads the very same bodies, and a restart goes on where the last batch ended.
Partitions that come later start at their beginning. Executors read the ranges,
one task for each partition.

A body is a JSON object, a URL-encoded form or a multipart form. Its fields become
a map of strings (JSON values that are no strings as JSON text, files of a form as
decoded text). Defined results for odd input: a body that is none of these has
null ``fields`` and says why in ``error``; of a repeated field the last counts; an
empty body of a form has no fields; null values of JSON are null.
"""

import base64
import email
import email.policy
import io
import json
import urllib.parse
import uuid
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "partition string, offset long, content_type string, fields map<string, string>, error string"


class RequestLog(Protocol):
    """What a caller brings; it is sent to executors, so it must be picklable."""

    def ends(self) -> dict[str, int]:
        """The offset after the last body of each partition."""

    def read(self, partition: str, start: int, end: int) -> Iterator[tuple[int, str, bytes]]:
        """``(offset, content type, body)`` of all bodies from ``start`` to before ``end``."""


class FolderLog:
    """A log in a folder that the driver and all executors see: a file for each partition, a JSON line for each body, byte offsets.

    The folder is a path or a URI that Arrow's file systems open.
    """

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def append(self, partition: str, content_type: str, body: bytes) -> None:
        files, path = self._open()
        files.create_dir(path)
        line = json.dumps({"content_type": content_type, "body": base64.b64encode(body).decode()}) + "\n"
        with files.open_append_stream(f"{path}/{partition}.log") as f:
            f.write(line.encode())

    def ends(self) -> dict[str, int]:
        from pyarrow import fs

        files, path = self._open()
        infos = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {i.base_name.removesuffix(".log"): self._whole(files, i) for i in infos if i.base_name.endswith(".log")}

    @staticmethod
    def _whole(files, info) -> int:
        """The end of the last whole line; a writer may be within one."""
        with files.open_input_file(info.path) as f:
            end = info.size
            while end:
                start = max(0, end - (1 << 16))
                f.seek(start)
                cut = f.read(end - start).rfind(b"\n")
                if cut >= 0:
                    return start + cut + 1
                end = start
        return 0

    def read(self, partition: str, start: int, end: int) -> Iterator[tuple[int, str, bytes]]:
        files, path = self._open()
        # Arrow's files have no lines of their own.
        with io.BufferedReader(files.open_input_file(f"{path}/{partition}.log"), 1 << 20) as f:
            f.seek(start)
            while start < end:
                line = f.readline()
                found = json.loads(line)
                yield start, found["content_type"], base64.b64decode(found["body"])
                start += len(line)


def parse_body(content_type: str, body: bytes) -> dict[str, str | None]:
    """The fields of a body; a ValueError if it has none of the forms."""
    kind = content_type.partition(";")[0].strip().lower()
    if kind == "application/json":
        found = json.loads(body)
        if not isinstance(found, dict):
            raise ValueError("the body is no JSON object")
        return {k: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in found.items()}
    if kind == "application/x-www-form-urlencoded":
        return dict(urllib.parse.parse_qsl(body.decode(), keep_blank_values=True, errors="strict"))
    if kind == "multipart/form-data":
        form = email.message_from_bytes(b"Content-Type: " + content_type.encode() + b"\r\n\r\n" + body, policy=email.policy.HTTP)
        if not form.is_multipart():
            raise ValueError("the form has no parts")
        named = ((p.get_param("name", header="content-disposition"), p.get_payload(decode=True)) for p in form.iter_parts())
        return {str(k): v.decode() for k, v in named if k is not None}
    raise ValueError(f"content type {kind or 'missing'}")


class Range(InputPartition):
    def __init__(self, partition: str, start: int, end: int):
        self.partition, self.start, self.end = partition, start, end


class RequestReader(DataSourceStreamReader):
    def __init__(self, log: RequestLog):
        self.log = log

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.log.ends()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(p, start.get(p, 0), z) for p, z in sorted(end.items()) if start.get(p, 0) < z]

    def read(self, partition: Range) -> Iterator[tuple]:
        for offset, content_type, body in self.log.read(partition.partition, partition.start, partition.end):
            try:
                fields, error = parse_body(content_type or "", body), None
            except ValueError as e:  # Unicode and JSON errors are such
                fields, error = None, f"{type(e).__name__}: {e}"
            yield partition.partition, offset, content_type, fields, error


def request_format(log: RequestLog) -> type[DataSource]:
    class RequestFormat(DataSource):
        @classmethod
        def name(cls) -> str:
            return "lexweft_requests"

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:
            return RequestReader(log)

    return RequestFormat


def read_requests(spark: SparkSession, log: RequestLog) -> DataFrame:
    """The stream of all bodies of ``log``: partition, offset, content_type, fields, error."""
    spark.dataSource.register(request_format(log))
    return spark.readStream.format("lexweft_requests").load()


def _typed(requests: DataFrame, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> DataFrame:
    """The named fields as columns, with ``status``: 200, or 422 if the body or a required field is missing."""
    there = F.lit(True)
    for name in required:
        there = there & F.col("fields")[name].isNotNull()
    good = F.coalesce(F.col("error").isNull() & there, F.lit(False))
    return requests.select("partition", "offset", *[F.col("fields")[n].alias(n) for n in (*required, *optional)], F.when(good, 200).otherwise(422).alias("status"), "error")


def chat_requests(requests: DataFrame) -> DataFrame:
    return _typed(requests, ("session_id", "message"))


def metadata_requests(requests: DataFrame) -> DataFrame:
    """Requests for metadata, as JSON or as a form."""
    return _typed(requests, ("filename", "markdown"), ("fuente",))


def new_partition() -> str:
    """A name for a writer's own partition, so that writers don't wait for each other."""
    return uuid.uuid4().hex
