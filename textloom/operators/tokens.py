"""Tokenising, token columns, and incremental stores of tokens and vectors."""

from __future__ import annotations

import math
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from textloom.functions.packed import pack_tokens, unpack_tokens
from textloom.functions.spans import regex_spans
from textloom.operators.ranks import salted_join
from textloom.session import release_shuffles, staged

# Rule tokenisers. Punctuation is never part of a token. ``char`` gives one
# token per CJK character and whole runs for the other scripts.
CJK = "\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsHangul}"
MODELS = {
    "word": "[\\p{L}\\p{N}]+",
    "whitespace": "[^\\s]+",
    "char": f"[{CJK}]|[\\p{{L}}\\p{{N}}&&[^{CJK}]]+",
}
CASE_FREE_MODELS = frozenset({"char"})

TOKEN_TYPE = "array<struct<token:string,start:bigint,end:bigint>>"
PREFIX = "__derived__"


def model_pattern(model: str) -> str:
    if model not in MODELS:
        raise ValueError(f"unknown token model {model!r}; use one of {sorted(MODELS)}")
    return MODELS[model]


def token_words(text: Column, model: str = "word", lowercase: bool | None = None) -> Column:
    """Tokens without offsets: the cheap form for counting."""
    fold = model not in CASE_FREE_MODELS if lowercase is None else lowercase
    body = F.lower(text) if fold else text
    return F.regexp_extract_all(body, F.lit(model_pattern(model)), F.lit(0))


def token_spans(text: Column, model: str = "word", lowercase: bool | None = None) -> Column:
    """Tokens with character offsets into the untouched text."""
    fold = model not in CASE_FREE_MODELS if lowercase is None else lowercase
    return regex_spans(text, model_pattern(model), "token", fold)


def derived_name(source: str, model: str, form: str = "tokens") -> str:
    return f"{PREFIX}{form}__{source}__{model}"


def is_derived(name: str) -> bool:
    return name.startswith(PREFIX)


def tokenise(
    df: DataFrame,
    text_col: str,
    model: str = "word",
    language: str | None = None,
    tokens: Column | None = None,
) -> DataFrame:
    """Add (or replace) the token column of ``text_col`` for ``model``.

    Where it came from is kept as column metadata, which Spark carries through
    filters, projections, joins and unions.
    """
    if text_col not in df.columns:
        raise ValueError(f"column {text_col!r} is not in the table")
    name = derived_name(text_col, model)
    about = {
        "source_column": text_col,
        "form": "tokens",
        "model": model,
        "language": language or "",
        "generated_at": datetime.now(UTC).isoformat(timespec="seconds"),
    }
    value = token_spans(F.col(text_col), model) if tokens is None else tokens
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*kept, value.alias(name, metadata=about))


def find_derived(
    df: DataFrame, source: str, form: str = "tokens", model: str | None = None
) -> str | None:
    """Name of the first column derived from ``source``, or None."""
    for field in df.schema.fields:
        about = field.metadata or {}
        if about.get("source_column") == source and about.get("form") == form:
            if model is None or about.get("model") == model:
                return field.name
    return None


def derived_registry(df: DataFrame) -> dict[str, dict]:
    return {f.name: f.metadata for f in df.schema.fields if "source_column" in (f.metadata or {})}


def drop_derived(df: DataFrame, name: str) -> DataFrame:
    if name not in derived_registry(df):
        raise ValueError(f"{name!r} is not a derived column")
    return df.drop(name)


def explode_tokens(df: DataFrame, tokens_col: str, keep: list[str]) -> DataFrame:
    """One row per token: the kept columns, then token, start and end.

    The generator reads an expression, not the bare column: for a bare column
    Spark adds a filter on its size below all that comes before, and a column
    that is still to be computed would be computed twice more there.
    """
    fields = ("token", "start", "end")
    parts = F.transform(F.col(f"`{tokens_col}`"), lambda t: F.struct(*[t[f].alias(f) for f in fields]))
    return df.select(*keep, F.explode(parts).alias("t")).select(*keep, "t.token", "t.start", "t.end")


# --- incremental token store ------------------------------------------------

# Both stores lie in one folder per key prefix. Each file is sorted by key and has a Bloom filter of it.
STORE_SCHEMA = f"text_hash string, tokens {TOKEN_TYPE}, bucket string"

BUCKET_DIGITS = 1  # of the hexadecimal key; 16 ** digits folders

# Starts and ends grow in a list, so that their differences take little room. Dictionaries of them would be kept instead.
STORE_FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary#tokens.list.element.start": "false",
    "parquet.enable.dictionary#tokens.list.element.end": "false",
}

PART_BYTES = 32 << 20  # of new texts or vectors, or of stored files, that one task writes to a folder

ARROW_BATCH = "16m"  # of token lists, of which a task holds several copies

FEW_COPIES = 4  # of a text, up to which they are sent to the task that writes one; more become one on the way

BROADCAST_HASHES = 1_000_000  # unseen texts whose hashes are broadcast, about 100 bytes each


def content_key(text: Column, model: str = "word") -> Column:
    """Content hash inside one token model."""
    return F.sha2(F.concat_ws("\u0001", F.lit(model), F.coalesce(text, F.lit(""))), 256)


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The store's table; a store that does not exist yet is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_store(rows: DataFrame, path: str, digits: int = BUCKET_DIGITS, size: int = 0) -> None:
    """Add rows of about ``size`` bytes to a store; their first column is the key.

    ``digits`` is a matter of the store: all appends to it take the same.
    """
    _write_store(_placed(rows, digits, size).drop("salt"), path)


def _salt(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts))


def _placed(rows: DataFrame, digits: int, size: int) -> DataFrame:
    """Rows with ``bucket``, their folder, and ``salt``: one task for each folder up to ``PART_BYTES``, more for larger ones."""
    key, folders = rows.columns[0], 16**digits
    parts = max(1, math.ceil(size / (folders * PART_BYTES)))
    # A bucket that cannot be null is written as it is, so rows that are sorted need no other sort.
    bucket = F.coalesce(F.substring(key, 1, digits), F.lit(""))
    rows = rows.withColumns({"bucket": bucket, "salt": _salt(key, parts)})
    if parts == 1:
        return rows.repartition("bucket", "salt")
    return rows.repartition(folders * parts, "bucket", "salt")


def _write_store(rows: DataFrame, path: str) -> None:
    _written(rows.sortWithinPartitions("bucket", rows.columns[0]), path)


def _written(rows: DataFrame, path: str) -> None:
    """Add sorted rows to a store; their first column is the key."""
    key = rows.columns[0]
    (
        rows.write.partitionBy("bucket").mode("append")
        .options(**STORE_FORMAT)
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .parquet(path)
    )


def near_keys(store: DataFrame, keys: DataFrame, digits: int = BUCKET_DIGITS) -> DataFrame:
    """The part of a store in whose folders some of ``keys`` belong, at most 16 ** digits names."""
    key = keys.columns[0]
    names = keys.select(F.substring(key, 1, digits).alias("b")).distinct().collect()
    return store.filter(F.col("bucket").isin([r["b"] for r in names]))


def unseen_texts(
    df: DataFrame, text_col: str, store: DataFrame, model: str = "word",
    broadcast_hashes: int = BROADCAST_HASHES, digits: int = BUCKET_DIGITS,
) -> DataFrame:
    """Distinct texts whose tokens of ``model`` are not in the store.

    Hashes are compared first, copies collapsing inside every task, so a known
    text never travels and no stored token is read: of the folders that the
    wanted hashes belong to, the key column alone. Only the texts of unseen
    hashes are fetched, by a broadcast of these if they are few, else by a
    shuffle.
    """
    return _one_each(_unseen(df, text_col, store, model, broadcast_hashes, digits)[0])


def _one_each(texts: DataFrame) -> DataFrame:
    return texts.groupBy("text_hash").agg(F.first("text").alias("text"))


def _unseen(
    df: DataFrame, text_col: str, store: DataFrame, model: str, broadcast_hashes: int, digits: int
) -> tuple[DataFrame, int]:
    """``text_hash, text, copies`` of all rows with unseen texts, and the bytes of the distinct ones."""
    keyed = df.select(
        content_key(F.col(text_col), model).alias("text_hash"), F.col(text_col).alias("text")
    )
    sizes = keyed.groupBy("text_hash").agg(
        F.max(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("copies")
    )
    hashes = staged(sizes, "wanted")
    known = near_keys(store, hashes, digits).select("text_hash")
    fresh = staged(hashes.join(known, "text_hash", "left_anti"), "unseen")
    n, size = fresh.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    wanted = fresh.select("text_hash", "copies")
    texts = keyed.join(F.broadcast(wanted) if n <= broadcast_hashes else wanted, "text_hash")
    return texts, size or 0


def update_token_store(
    df: DataFrame, text_col: str, path: str, model: str = "word", digits: int = BUCKET_DIGITS
) -> None:
    """Tokenise texts the store has not seen and append them to it.

    The texts go to the tasks that write them, once, and are sorted there; only
    then they become tokens, a multiple of their bytes.
    """
    store = read_store(df.sparkSession, path, STORE_SCHEMA)
    texts, size = _unseen(df, text_col, store, model, BROADCAST_HASHES, digits)
    many = F.col("copies") > FEW_COPIES
    few = texts.filter(~many).select("text_hash", "text")
    placed = _placed(few.unionByName(_one_each(texts.filter(many))), digits, size)
    # Copies of a text are in one task, and grouping leaves its rows sorted by folder and key.
    single = placed.groupBy("bucket", "text_hash", "salt").agg(F.first("text").alias("text"))
    _written(single.select("text_hash", token_spans(F.col("text"), model).alias("tokens"), "bucket"), path)
    release_shuffles(df.sparkSession)


def distinct_keys(store: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """A store without double keys, which two updates at one time can leave.

    They are found in the key column; other rows are read where they lie.
    """
    key = store.columns[0]
    double = store.groupBy(key).count().filter("count > 1").select(key)
    double = staged(double, "double-keys")
    n = double.count()
    if n == 0:
        return store
    side = F.broadcast(double) if n <= broadcast_hashes else double
    single = store.join(side, key, "left_anti")
    return single.unionByName(store.join(side, key, "left_semi").dropDuplicates([key]))


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """``text_hash, tokens``, one row per hash of model and text."""
    return distinct_keys(read_store(spark, path, STORE_SCHEMA)).select("text_hash", "tokens")


def stored_bytes(store: DataFrame) -> int:
    """Bytes of the files of a store."""
    files = store.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]


def compact_store(spark: SparkSession, path: str, target: str, schema: str, files: int) -> int:
    """Rewrite a store under ``target``, about ``files`` files or one per folder; double keys go.

    More files are made of folders of which one would hold over half of ``PART_BYTES``. Returns the number of files read. The old files are left to the caller.
    """
    store = spark.read.schema(schema).parquet(path)
    folders = store.select("bucket").distinct().count()
    size = stored_bytes(store)
    # Stored tokens take a half of the bytes of their texts or more, new ones are bounded by these.
    parts = max(1, files // max(1, folders), math.ceil(2 * size / (max(1, folders) * PART_BYTES)))
    tasks = max(files, folders * parts, 1)
    rows = distinct_keys(store).repartition(tasks, "bucket", _salt(store.columns[0], parts))
    _write_store(rows, target)
    return len(store.inputFiles())


def compact_when(
    spark: SparkSession, path: str, target: str, schema: str, files: int, limit: int
) -> bool:
    """``compact_store`` once the store has more than ``limit`` files; whether it did."""
    if len(spark.read.schema(schema).parquet(path).inputFiles()) <= limit:
        return False
    compact_store(spark, path, target, schema, files)
    return True


def tokenise_from_store(df: DataFrame, text_col: str, path: str, model: str = "word") -> DataFrame:
    """Bring the store up to date and attach its tokens to every row.

    A text with very many copies is a hot join key on the table's side; such
    keys are salted. Tokens travel packed, for which the session's Arrow batches
    are held to ``ARROW_BATCH``.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    update_token_store(df, text_col, path, model)
    stored = read_token_store(df.sparkSession, path).select(
        F.col("text_hash").alias("__stored"), pack_tokens("tokens").alias("__tokens")
    )
    hashed = df.withColumn("__hash", content_key(F.col(text_col), model))
    joined = salted_join(hashed, stored, "__hash", "__stored", "left")
    named = tokenise(joined, text_col, model, tokens=unpack_tokens("__tokens"))
    return named.drop("__hash", "__stored", "__tokens")


# --- incremental vector store -----------------------------------------------

VECTOR_SCHEMA = (
    "content_hash string, space string, embedding array<float>, stored_at timestamp, bucket string"
)


def vector_key(text: Column, model: str, provider: str) -> Column:
    """Content hash inside one (model, provider) space."""
    return F.sha2(F.concat_ws("\u0001", F.lit(provider), F.lit(model), text), 256)


def newest_vectors(store: DataFrame) -> DataFrame:
    """One vector per key: the newest, by partial aggregation."""
    value = F.struct("embedding", "space")
    return (
        store.groupBy("content_hash")
        .agg(F.max_by(value, "stored_at").alias("v"), F.max("stored_at").alias("stored_at"))
        .select("content_hash", "v.space", "v.embedding", "stored_at")
    )


def lookup_vectors(keys: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (key, vector) and the distinct keys that are missing.

    Only the folders of wanted keys are read, and the store is cut down to the
    keys before its newest vectors are found.
    """
    wanted = staged(keys.select("content_hash").distinct(), "wanted")
    near = near_keys(store, wanted)
    hits = newest_vectors(near.join(wanted, "content_hash", "left_semi")).select("content_hash", "embedding")
    missing = wanted.join(near.select("content_hash"), "content_hash", "left_anti")
    return hits, missing


def store_vectors(vectors: DataFrame, path: str, space: str, stored_at: str) -> None:
    """Append (content_hash, embedding) rows to the store."""
    rows = vectors.select(
        "content_hash",
        F.lit(space).alias("space"),
        F.col("embedding").cast(T.ArrayType(T.FloatType())).alias("embedding"),
        F.lit(stored_at).cast("timestamp").alias("stored_at"),
    )
    rows = staged(rows, "new-vectors")
    size = rows.agg(F.sum(F.size("embedding").cast("bigint") * 4)).first()[0]
    append_store(rows, path, size=size or 0)
