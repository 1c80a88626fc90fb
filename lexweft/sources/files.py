"""Sources: files with their bytes, JSON registries, settings, the driver's tables."""

import os
from dataclasses import dataclass, fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, only_pdf: bool = False) -> DataFrame:
    """``(filename, path, length, content)`` of all files below a folder; column pruning spares the bytes if unused."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if only_pdf:
        reader = reader.option("pathGlobFilter", "*.[pP][dD][fF]")
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    return reader.load(path).select(name.alias("filename"), "path", "length", "content")


def stream_files(spark: SparkSession, path: str, per_trigger: int = 1000, archive: str | None = None) -> DataFrame:
    """The same as a stream; files move to ``archive`` once their batch is committed."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    name = F.regexp_extract("path", r"([^/]*)\z", 1)
    return reader.load(path).select(name.alias("filename"), "path", "length", "content")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``(display_name, store)`` of a JSON object file; empty if the file is missing or no JSON object."""
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "display_name string, store string")
    parsed = whole.select(F.from_json("value", "map<string,string>").alias("m")).where("m IS NOT NULL")
    return parsed.select(F.explode("m").alias("display_name", "store"))


def stream_requests(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Request bodies as a stream: JSON objects, one a line, in files that arrive below a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


#: What a form or a request for metadata holds.
METADATA_REQUEST = "filename string, markdown string, fuente string"


@dataclass(frozen=True)
class Settings:
    """Limits and names (fixed values, with their defaults), each from an environment variable of its name in capitals, else from a ``.env`` file; others are ignored."""

    max_upload_mb: int = 75
    min_text_chars_for_native_pdf: int = 800
    gemini_api_key: str | None = None
    gemini_model: str = "gemini-2.5-flash"
    gemini_file_search_store: str | None = None
    enable_gemini_file_search_upload: bool = False
    google_cloud_project: str | None = None
    document_ai_location: str = "us"
    document_ai_processor_id: str | None = None

    @classmethod
    def from_env(cls, env=None, env_file: str | None = ".env") -> "Settings":
        found = read_env_file(env_file) | {k.upper(): v for k, v in (os.environ if env is None else env).items()}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        truth = {"1": True, "true": True, "yes": True, "on": True, "t": True, "y": True, "0": False, "false": False, "no": False, "off": False, "f": False, "n": False}
        cast = {bool: lambda v: truth[v.strip().lower()], int: int}
        return cls(**{k: cast.get(kind, str)(found[k.upper()]) for k, kind in kinds.items() if k.upper() in found})

    def ocr_ready(self) -> bool:
        return bool(self.google_cloud_project and self.document_ai_location and self.document_ai_processor_id)


def read_env_file(path: str | None) -> dict[str, str]:
    """Names in capitals and values of a ``.env`` file; empty if there is none."""
    if not path or not os.path.isfile(path):
        return {}
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
                out[name.strip().upper()] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
