"""The document store as a sink of Spark's: uploads keyed by document, waited for before a write is committed.

``store_format(client)`` makes a data source whose tasks upload their rows. A task
asks the store for a document's key before it uploads, so a task that runs again,
or a whole write that does, uploads nothing twice. It keeps at most ``open_most``
operations open, and hands those that are open at its end to the driver as its
commit message, so what the driver gets is bounded per task. ``commit`` looks at
them until all are done or the deadline is there; a write that ends without
commit cancels what its tasks left open.

A document is (document_id, filename, store, markdown, custom_metadata). An upload
that raises fails its task, which Spark runs again as often as it does any; the
message says what metadata was sent. Defined results for odd input: null Markdown
is empty text, null metadata no pairs; a null document_id or store is an error.
Rows that repeat a document_id are one document, whose first upload counts.
"""

import json
import time
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Seconds between looks at an upload, how long it is waited for, and the bounds of that.
POLL, MAX_WAIT, WAIT_BOUNDS = 1.0, 600, (1, 3600)
DOCUMENT = "document_id string, filename string, store string, markdown string, custom_metadata array<struct<key: string, string_value: string>>"


class StoreClient(Protocol):
    """What a caller brings; it is sent to executors, so it must be picklable."""

    def find(self, store: str, key: str) -> tuple[str, bool] | None:
        """``(operation, done)`` of the upload of ``key``, None if there was none."""

    def upload(self, store: str, key: str, display_name: str, markdown: str, pairs: list[tuple[str, str]]) -> tuple[str, bool]:
        """Starts the upload of ``key``; of two at once, the store keeps one."""

    def done(self, operation: str) -> bool: ...

    def cancel(self, operation: str) -> None: ...


@dataclass
class Handed(WriterCommitMessage):
    """What a task hands over: how many documents it uploaded and found, and its open operations."""

    uploaded: int = 0
    found: int = 0
    open: list[str] = field(default_factory=list)


def checked_wait(most: float) -> float:
    least, longest = WAIT_BOUNDS
    if not least <= most <= longest:
        raise ValueError(f"max_wait_seconds must be between {least} and {longest}")
    return most


def wait_all(done, operations: list[str], most: float, every: float, clock=time.monotonic, sleep=time.sleep, upto: int = 0) -> list[str]:
    """Looks at ``operations`` until all but ``upto`` are done and returns those; a TimeoutError once ``most`` seconds have gone."""
    deadline, left = clock() + most, operations
    while len(left := [o for o in left if not done(o)]) > upto:
        if clock() >= deadline:
            raise TimeoutError(f"Gemini File Search upload no termino en {most:g} segundos")
        sleep(every)
    return left


class StoreWriter(DataSourceWriter):
    def __init__(self, client: StoreClient, wait: bool, most: float, every: float, open_most: int):
        self.client, self.wait, self.most, self.every, self.open_most = client, wait, checked_wait(most), every, open_most

    def write(self, iterator) -> Handed:
        out = Handed()
        for row in iterator:
            if row.document_id is None or row.store is None:
                raise ValueError("a document needs a document_id and a store")
            known = self.client.find(row.store, row.document_id)
            pairs = [(p.key, p.string_value) for p in row.custom_metadata or []]
            if known:
                out.found += 1
            else:
                try:
                    known = self.client.upload(row.store, row.document_id, row.filename, row.markdown or "", pairs)
                except Exception as e:
                    sent = [{"index": i, "key": k, "length": len(v), "value": v} for i, (k, v) in enumerate(pairs)]
                    raise RuntimeError(f"{e}; custom_metadata_sent={json.dumps(sent, ensure_ascii=False)}") from e
                out.uploaded += 1
            if self.wait and not known[1]:
                out.open.append(known[0])
            if len(out.open) > self.open_most:
                out.open = wait_all(self.client.done, out.open, self.most, self.every, upto=self.open_most // 2)
        return out

    def commit(self, messages) -> None:
        wait_all(self.client.done, [o for m in messages if m for o in m.open], self.most, self.every)

    def abort(self, messages) -> None:
        for operation in (o for m in messages if m for o in m.open):
            if not self.client.done(operation):
                self.client.cancel(operation)


def store_format(client: StoreClient, wait: bool = True, most: float = MAX_WAIT, every: float = POLL, open_most: int = 100) -> type[DataSource]:
    """A data source to register, by which documents are written to the store of ``client``."""

    class StoreFormat(DataSource):
        @classmethod
        def name(cls) -> str:
            return "lexweft_store"

        def schema(self) -> str:
            return DOCUMENT

        def writer(self, schema, overwrite: bool) -> DataSourceWriter:
            return StoreWriter(client, wait, most, every, open_most)

    return StoreFormat


def write_store(documents: DataFrame, client: StoreClient, **options) -> None:
    """Uploads ``documents`` (DOCUMENT's columns; others are ignored); returns when all are done, else raises."""
    spark = documents.sparkSession
    spark.dataSource.register(store_format(client, **options))
    shape = spark.createDataFrame([], DOCUMENT).schema
    own = documents.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape.fields])
    # Copies of a document go to one task, where the first upload is found by the others.
    own.repartition("document_id").write.format("lexweft_store").mode("append").save()
