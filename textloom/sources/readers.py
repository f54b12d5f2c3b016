"""Loading tables by file format."""

from __future__ import annotations

import zipfile
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.textfix import repair_text_columns
from textloom.operators.paging import rows_between
from textloom.operators.schema import col

# Formats by file extension, text members of an archive.
FORMATS = {
    "csv": "csv",
    "json": "json",
    "jsonl": "jsonl",
    "parquet": "parquet",
    "xlsx": "excel",
    "xls": "excel",
    "xlsm": "excel",
    "xlsb": "excel",
    "ods": "excel",
    "txt": "text",
    "text": "text",
    "md": "text",
    "rst": "text",
    "log": "text",
    "tsv": "tsv",
    "zip": "zip",
}
TEXT_EXTENSIONS = [
    ".txt",
    ".md",
    ".rst",
    ".log",
    ".csv",
    ".tsv",
    ".json",
    ".jsonl",
    ".ndjson",
    ".xml",
    ".html",
    ".htm",
    ".yaml",
    ".yml",
    ".toml",
    ".ini",
    ".cfg",
    ".text",
]
FRAME_BYTES = 4 << 20  # of archive members or texts held at one time


def detect_format(name: str) -> str:
    """Format by extension, or ``unknown``."""
    suffix = PurePosixPath(name.rstrip("/")).suffix.lower().lstrip(".")
    return FORMATS.get(suffix, "unknown")


def format_of(name: Column) -> Column:
    """``detect_format`` for a column of file names, as in a listing; null has no format."""
    suffix = F.lower(F.regexp_extract(name, r"(?:^|/)[^/]+\.([^./]+)/*$", 1))
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.when(name.isNotNull(), F.coalesce(F.try_element_at(known, suffix), F.lit("unknown")))


def read_csv(
    spark: SparkSession,
    path: str,
    separator: str = ",",
    schema: str | T.StructType | None = None,
    multiline: bool = False,
) -> DataFrame:
    """A delimited file with a header.

    Types are inferred in an extra pass unless a schema is given. Quoted line
    breaks need ``multiline``, and then a file is one task; without it, large
    files are split.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
    )
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file holding one JSON array (or object)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of a text file, column ``text``."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def read_archives(
    spark: SparkSession,
    path: str,
    encoding: str = "utf-8",
    errors: str = "ignore",
    extensions: Iterable[str] | None = None,
    extensionless: bool = True,
) -> DataFrame:
    """One row per text member of every ZIP archive under ``path``.

    System members, other extensions and undecodable texts are skipped.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return unpack_archives(files, encoding, errors, extensions, extensionless)


def unpack_archives(
    files: DataFrame,
    encoding: str = "utf-8",
    errors: str = "ignore",
    extensions: Iterable[str] | None = None,
    extensionless: bool = True,
) -> DataFrame:
    """``read_archives`` for archives held in a binary column ``content``.

    Archives are spread over the executors, which only list and unzip; which
    members are texts is a filter on the listing, and bytes become text in Spark
    for the encodings it knows.
    """
    listed = [e.lower().lstrip(".") for e in (TEXT_EXTENSIONS if extensions is None else extensions)]
    members = files.select("content").mapInArrow(_members, "file_path string, content binary")
    leaf = F.regexp_extract("file_path", r"([^/]*)$", 1)
    suffix = F.regexp_extract(leaf, r"^.+(\.[^.]+)$", 1)
    system = leaf.startswith("._") | F.col("file_path").startswith("__MACOSX/")
    allowed = F.lower(F.substring(suffix, 2, 1000)).isin(listed)
    named = F.when(suffix == "", F.lit(extensionless)).otherwise(allowed)
    chosen = members.filter((leaf != "") & ~system & named)
    decoded = chosen.withColumn("document", _decoder(encoding, errors)("content"))
    return decoded.filter(F.col("document").isNotNull()).select(
        "file_path",
        F.substring(leaf, F.lit(1), F.length(leaf) - F.length(suffix)).alias("base_name"),
        suffix.alias("extension"),
        "document",
    )


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every member of every archive, a few at a time."""
    for batch in batches:
        for content in batch.column("content"):
            with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                names, raw, size = [], [], 0
                for name in archive.namelist():
                    names.append(name)
                    raw.append(archive.read(name))
                    size += len(raw[-1])
                    if size >= FRAME_BYTES:
                        yield _frame(names, raw)
                        names, raw, size = [], [], 0
                if names:
                    yield _frame(names, raw)


def _frame(names: list[str], raw: list[bytes]) -> pa.RecordBatch:
    columns = [pa.array(names, pa.string()), pa.array(raw, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["file_path", "content"])


def _decoder(encoding: str, errors: str):
    """Bytes to text, a few at a time; null where they cannot be decoded."""

    def one(raw: bytes) -> str | None:
        try:
            return str(raw, encoding, errors)
        except UnicodeDecodeError:
            return None

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for contents in batches:
            texts, size = [], 0
            for content in contents:
                raw = content.as_py()
                texts.append(one(raw))
                size += len(raw)
                if size >= FRAME_BYTES:
                    yield pa.array(texts, pa.string())
                    texts, size = [], 0
            if texts or not len(contents):
                yield pa.array(texts, pa.string())

    return decode


def load(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    repair: bool = True,
    schema: str | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Load a table by its extension and repair broken text in string columns.

    ``schema`` saves the pass that infers types of CSV, TSV and JSON;
    ``multiline`` allows line breaks inside quoted CSV and TSV fields.
    """
    kind = fmt or detect_format(path)
    if kind in ("csv", "tsv"):
        table = read_csv(spark, path, "\t" if kind == "tsv" else ",", schema, multiline)
    elif kind in ("json", "jsonl"):
        table = (read_json if kind == "json" else read_json_lines)(spark, path, schema)
    elif kind == "parquet":
        table = spark.read.parquet(path)
    elif kind == "text":
        table = read_lines(spark, path)
    elif kind == "zip":
        table = read_archives(spark, path)
    else:
        raise ValueError(f"unsupported file type: {kind}")
    return repair_text_columns(table) if repair else table


def preview(df: DataFrame, order_by: list[str], page: int = 0, size: int = 20) -> DataFrame:
    """One page of a table as texts, nulls shown as ``None``."""
    if page < 0 or size < 1:
        raise ValueError("page is 0 or more and size 1 or more")
    rows = rows_between(df, order_by, page * size, size)
    return rows.select(
        *[F.coalesce(col(c).cast("string"), F.lit("None")).alias(c) for c in df.columns]
    )
