"""Sources and sinks: page images, multipart ingestion, media checks, merges, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import every_failure, first_failure

# First bytes (hex) of the accepted media types, and the largest size.
SIGNATURES = {"image/jpeg": "FFD8FF", "image/png": "89504E47", "image/webp": "52494646", "application/pdf": "25504446"}
MAX_BYTES = 25 * 1024 * 1024


def page_images(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """Files as rows (``path``, ``length``, ``content``), sorted by no one: sort where it matters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def media_problem(mime: Column, content: Column) -> Column:
    """The first reason not to take a file, or null."""
    head = F.hex(F.substring(content, 1, 4))
    signature = F.lit(False)
    for kind, start in SIGNATURES.items():
        signature = signature | ((mime == kind) & F.startswith(head, F.lit(start)))
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return first_failure((F.coalesce(~mime.isin(list(SIGNATURES)), F.lit(True)), "UNSUPPORTED_TYPE"), (size < 16, "EMPTY"), (size > MAX_BYTES, "TOO_LARGE"), (~signature, "BAD_SIGNATURE"))


def page_number(field: Column, index: Column) -> Column:
    """From a file field's name (``page_3``, ``file-07``, ``12``), else its place plus 1."""
    found = F.regexp_extract(field, r"^(?:page|file)?[_\-]?([0-9]+)$", 1)
    return F.coalesce(F.when(found != "", found.cast("int")), index + 1)


def object_key(exam: Column, book: Column, page: Column) -> Column:
    return F.format_string("exams/%s/answer-books/%s/pages/page-%04d", exam.cast("string"), book.cast("string"), page)


def first_source(**candidates: Column) -> tuple[Column, Column]:
    """(name, value) of the first candidate that is there and not empty."""
    there = [(k, F.nullif(v, F.lit(""))) for k, v in candidates.items()]
    return F.coalesce(*[F.when(v.isNotNull(), k) for k, v in there]), F.coalesce(*[v for _, v in there])


def extracted_questions(reply: Column) -> Column:
    """Questions out of a model's reply: fences go, fields get defaults (number: the place; marks: at least 0.5, else 10)."""
    bare = F.trim(F.regexp_replace(reply, "(?s)```(?:json)?", ""))
    parsed = F.from_json(bare, "array<struct<number: int, text: string, marks: double>>", {"mode": "PERMISSIVE"})
    return F.transform(
        F.coalesce(parsed, F.array().cast("array<struct<number: int, text: string, marks: double>>")),
        lambda q, i: F.struct(F.coalesce(q.number, i + 1).alias("number"), F.coalesce(q.text, F.lit("")).alias("text"), F.greatest(F.lit(0.5), F.coalesce(F.nullif(q.marks, F.lit(0.0)), F.lit(10.0))).alias("marks")),
    )


def merged(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: the newest change of each key over the current row; nulls in a change keep what was there.

    ``changes`` has the columns of ``current`` and ``order``. A key may be in either or both.
    """
    values = [c for c in current.columns if c not in keys]
    newest = changes.groupBy(*keys).agg(*[F.max_by(F.struct(F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values])
    old, new = current.alias("o"), newest.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    return old.join(new, on, "full_outer").select(*[F.coalesce(F.col(f"o.{k}"), F.col(f"n.{k}")).alias(k) for k in keys], *[F.coalesce(F.col(f"n.{c}.{c}"), F.col(f"o.{c}")).alias(c) for c in values])


def insert_new(current: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, rows refused): a key that exists, or that came before in the same batch, is refused."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in incoming.columns])
    ranked = incoming.withColumn("_k", F.row_number().over(w))
    known = current.select(*keys).distinct().withColumn("_known", F.lit(True))
    marked = ranked.join(known, keys, "left").withColumn("_ok", (F.col("_k") == 1) & F.col("_known").isNull())
    return marked.where("_ok").select(*incoming.columns), marked.where("not _ok").select(*incoming.columns)


def with_mark(marks: Column, question: Column, field: str, value: Column) -> Column:
    """The array of marks with ``field`` of the matching question replaced."""
    return F.transform(marks, lambda m: F.when(m.question_number == question, m.withField(field, value)).otherwise(m))


def finalization_problems(expected: Column, n_pages: Column, n_distinct: Column, low: Column, top: Column, bad_quality: Column, in_progress: Column) -> Column:
    """Every reason why a script cannot be finalized yet, in order."""
    return every_failure(
        (expected.isNull() | (expected <= 0), "PAGE_COUNT_UNKNOWN"), (n_pages == 0, "NO_PAGES"), (n_pages != expected, "PAGE_COUNT_MISMATCH"), (n_distinct != n_pages, "DUPLICATE_PAGES"),
        ((low != 1) | (top != n_distinct), "PAGES_NOT_SEQUENTIAL"), (bad_quality > 0, "QUALITY_NOT_PASSED"), (in_progress > 0, "STILL_PROCESSING"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """A header, quoted strings, and an em dash where there is nothing."""
    rows.select([F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c) for c in rows.columns]).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One object in each line, nulls kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """Audit rows are only ever added."""
    rows.write.mode("append").parquet(path)
