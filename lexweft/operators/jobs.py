"""Jobs and errors: latest states, projections, classification and error records."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweft.functions import text
from lexweft.sources.shared import materialize

PUBLIC = ("job_id", "status", "filename", "result", "error")

#: Signs in a message, the HTTP status, the code and what people are told; the first that applies counts.
ERROR_RULES = (
    (("timeout", "no termino"), ("TimeoutError",), 504, "UPSTREAM_TIMEOUT", "El procesamiento tardo mas de lo esperado."),
    (("json", "valid"), ("JSONDecodeError", "ValidationError"), 422, "AGENT_VALIDATION_FAILED", "No se pudo validar la respuesta generada."),
    (("api_key", "no esta configurado", "no está configurado"), (), 503, "UPSTREAM_NOT_CONFIGURED", "El servicio de IA no esta configurado."),
    (("file search", "store"), (), 503, "UPSTREAM_UNAVAILABLE", "No se pudo consultar la base de conocimiento."),
    (("gemini",), (), 503, "UPSTREAM_UNAVAILABLE", "El servicio de IA no esta disponible en este momento."),
)
OTHER_ERROR = (422, "PROCESSING_FAILED", "No se pudo completar el procesamiento.")


def classify_error(message: Column, kind: Column | None = None) -> Column:
    """``struct<status, code, message>`` for an error's message and type."""
    low = F.lower(message)
    kind = F.lit("") if kind is None else F.coalesce(kind, F.lit(""))
    out = lambda a, b, c: F.struct(F.lit(a).alias("status"), F.lit(b).alias("code"), F.lit(c).alias("message"))
    found = None
    for signs, kinds, *answer in ERROR_RULES:
        met = kind.isin(*kinds) if kinds else F.lit(False)
        for sign in signs:
            met = met | F.contains(low, F.lit(sign))
        found = F.when(met, out(*answer)) if found is None else found.when(met, out(*answer))
    return found.otherwise(out(*OTHER_ERROR))


def latest_states(events: DataFrame, by: str = "job_id", order: str = "seq") -> DataFrame:
    """The last state of each job; one partial aggregate, so no window over a job's whole history."""
    rest = [c for c in events.columns if c != by]
    # By position: a group's key and its last row have names of their own.
    last = events.groupBy(F.col(by).alias("key")).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last"))
    return last.select(F.col("key").alias(by), *[F.col("last").getField(c).alias(c) for c in rest])


def public_jobs(jobs: DataFrame) -> DataFrame:
    """What callers see of jobs: no times."""
    return jobs.select(*[c for c in PUBLIC if c in jobs.columns])


def unwrap_results(jobs: DataFrame) -> DataFrame:
    """The results of jobs, flattened; a job without one ends the query with an error."""
    checked = F.when(F.col("result").isNotNull(), F.col("result")).otherwise(F.raise_error(F.lit("a job has no result")))
    return jobs.select(checked.alias("result")).select("result.*")


def split_by_status(jobs: DataFrame) -> dict[str, DataFrame]:
    """Jobs that succeeded, failed, and those to ask for again."""
    known = F.col("status").isin("succeeded", "failed")
    return {
        "succeeded": jobs.where("status = 'succeeded'"),
        "failed": jobs.where("status = 'failed'"),
        "pending": jobs.where(~F.coalesce(known, F.lit(False))),
    }


def find_jobs(wanted: DataFrame, jobs: DataFrame) -> DataFrame:
    """``wanted`` (job_id) with what callers see of the job, or the code JOB_NOT_FOUND and 404."""
    shown = [c for c in PUBLIC if c in jobs.columns and c != "job_id"]
    found = wanted.select("job_id").join(jobs.select("job_id", F.struct(*shown).alias("job")), "job_id", "left")
    missing = F.col("job").isNull()
    only = lambda x: F.when(missing, F.lit(x))
    return found.select("job_id", *[F.col("job").getField(c).alias(c) for c in shown], F.when(missing, 404).otherwise(200).alias("http"), only("JOB_NOT_FOUND").alias("code"), only("Conversion job no existe.").alias("message"))


def error_records(items: DataFrame, filename: str = "filename") -> DataFrame:
    """The record and file name of each failed item; the time is the query's."""
    item = F.to_json(F.struct(*items.columns))
    return items.select(
        F.col(filename), item.alias("error"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("happened_at"),
        text.safe_filename(F.col(filename)).alias("record_name"),
    )


def fifo(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy("created_at", "job_id")


def with_places(jobs: DataFrame, *order: str, out: str = "place") -> DataFrame:
    """``jobs`` with their places, from 1, in the order of columns ``order``; nulls come first.

    Ranges of rows are sorted on their own and numbered from the sizes of the
    ranges before them, so no task gets all rows. Equal rows are numbered in any order. The
    sorted ranges are written, as a range that is made anew could be another.
    """
    ranges = jobs.repartitionByRange(*order).sortWithinPartitions(*order)
    # The identifier counts a partition's rows in its lower 33 bits.
    numbered = ranges.select(F.struct(*jobs.columns).alias("row"), F.monotonically_increasing_id().alias("id"))
    placed = materialize(numbered.select("row", F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND((1 << 33) - 1).alias("nth")), "places")
    sizes = placed.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    ahead = sizes.select(F.col("range").alias("r"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    met = placed.join(F.broadcast(ahead), F.col("range") == F.col("r"))
    return met.select(*[F.col("row").getField(c).alias(c) for c in jobs.columns if c != out], (F.col("ahead") + F.col("nth") + 1).alias(out))
