"""One query per operator, over its whole table, and the SQL it must equal where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import (
    decontaminate,
    learned_partitions,
    line_dedup,
    near_dup,
    ngram_join,
    poisson_mix,
    quote_links,
    slot_shards,
    spelling,
    suffix_dedup,
    token_align,
    toxicity,
    wrappers,
)
from textloom.llm.scratch import Scratch

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SHARDS = 24

# DuckDB text shared by several queries.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op2_minhash_near_dup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies over 2-word shingles."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query("op3_slot_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards of near-equal bytes."""
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", crc.alias("text_crc32"))
    return slot_shards.assign(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


@query(
    "op4_line_dedup",
    f"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
  FROM line),
common AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE common.k IS NULL), ''))
         AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY doc_id""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in ten documents or more go."""
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )


@query(
    "op5_poisson_mix",
    """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source),
rate AS (
  SELECT source, (SELECT sum(n) FROM counts)::DOUBLE * 1.0 / (SELECT count(*) FROM counts) / n AS rate
  FROM counts),
step AS (
  SELECT source, rate, 1 AS k, exp(-rate) AS p, 0.0::DOUBLE + exp(-rate) AS c FROM rate
  UNION ALL
  SELECT source, rate, k + 1, p * rate / k, c + p * rate / k FROM step
  WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
u AS (
  SELECT doc_id, source,
         (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)
           / 4294967296.0 AS u
  FROM documents),
drawn AS (
  SELECT doc_id, u.source, count(*) FILTER (WHERE step.c < u.u) AS copies
  FROM u JOIN step ON u.source IS NOT DISTINCT FROM step.source GROUP BY ALL)
SELECT doc_id, source, copies::INTEGER AS copies, copy::INTEGER AS copy,
       md5('17-order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn)""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source to the same weight."""
    mixed = poisson_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copies", "copy", "shuffle_key")


@query(
    "op6_quote_links",
    """
WITH RECURSIVE line AS (
  SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS x,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM conversations),
marked AS (
  SELECT *, regexp_extract(x, '^(?:[ \t]{0,3}>)+') AS mark FROM line),
parsed AS (
  SELECT conv_id, turn, pos, len(mark) - len(replace(mark, '>', '')) AS level,
         substr(x, len(mark) + 1) AS body,
         lower(trim(regexp_replace(substr(x, len(mark) + 1), '[ \t\\x0B\\f\\r]+', ' ', 'g'),
                    ' ' || chr(9) || chr(11) || chr(12) || chr(13))) AS norm
  FROM marked),
plain AS (SELECT DISTINCT conv_id, turn, norm FROM parsed WHERE level = 0 AND norm <> ''),
near AS (SELECT conv_id, norm, min(turn) AS turn FROM plain GROUP BY ALL),
far AS (SELECT norm, min(ROW(conv_id, turn)) AS o FROM plain GROUP BY ALL),
found AS (
  SELECT q.conv_id, q.turn, q.level,
         CASE WHEN near.turn < q.turn THEN ROW(q.conv_id, near.turn)
              WHEN far.o[1] < q.conv_id THEN far.o END AS o
  FROM parsed q LEFT JOIN near ON near.conv_id = q.conv_id AND near.norm = q.norm
       LEFT JOIN far ON far.norm = q.norm
  WHERE q.level > 0 AND q.norm <> ''),
votes AS (SELECT conv_id, turn, level, o, count(*) AS n FROM found GROUP BY ALL),
links AS (
  SELECT conv_id, turn, sum(n)::BIGINT AS n_quoted,
         coalesce(sum(n) FILTER (WHERE o IS NOT NULL), 0)::BIGINT AS n_linked,
         arg_max(o, ROW(-level, n, o[1], o[2])) FILTER (WHERE o IS NOT NULL) AS parent
  FROM votes GROUP BY ALL),
chain AS (
  SELECT conv_id, turn, parent AS root, 1 AS depth FROM links WHERE parent IS NOT NULL
  UNION ALL
  SELECT chain.conv_id, chain.turn, links.parent, depth + 1
  FROM chain JOIN links ON links.conv_id = chain.root[1] AND links.turn = chain.root[2]
  WHERE links.parent IS NOT NULL),
ends AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(root, depth) AS root FROM chain GROUP BY ALL),
own AS (
  SELECT conv_id, turn, coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (WHERE level = 0), '')
    AS own_text
  FROM parsed GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, own_text, coalesce(n_quoted, 0)::BIGINT AS n_quoted,
       coalesce(n_linked, 0)::BIGINT AS n_linked, parent[1] AS parent_conv, parent[2] AS parent_turn,
       coalesce(root[1], m.conv_id) AS thread_conv, coalesce(root[2], m.turn) AS thread_turn,
       coalesce(depth, 0)::BIGINT AS depth
FROM conversations m JOIN own USING (conv_id, turn) LEFT JOIN links USING (conv_id, turn)
     LEFT JOIN ends USING (conv_id, turn)""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in reply order without quotes."""
    return quote_links.link_quotes(table(spark, sf_dir, "conversations")).drop("text")


_WORDS = f"regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op9_benchmark_scan",
    f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
gram AS (
  SELECT item_id, least(len(w), 10) AS n,
         unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
                               lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
  FROM b WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM gram),
win AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS pos,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))
           AS g
  FROM d, size WHERE len(w) >= n),
hit AS (SELECT doc_id, pos, win.n, item_id FROM win JOIN gram USING (g, n)),
word AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS p FROM hit),
words AS (SELECT doc_id, count(*) AS n_hit FROM word GROUP BY doc_id),
item AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN item USING (doc_id)""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op1_learned_partitions")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return learned_partitions.search(
        table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0
    )


@query("op7_toxic_distance")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op8_page_wrappers")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    scratch = Scratch(spark, "wrappers")
    text = wrappers.extract(table(spark, sf_dir, "pages"), scratch)
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


@query("op10_bwt_repeats")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document holds go."""
    scratch = Scratch(spark, "repeats")
    cut = suffix_dedup.removals(table(spark, sf_dir, "documents"), scratch)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["len"])
    digest = cut.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    return scratch.finish(digest)


@query("op11_spelling_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the words one edit away."""
    words = spelling.word_counts(table(spark, sf_dir, "documents"))
    return spelling.variants(words.filter((F.char_length("word") >= 7) & (F.col("n") >= 2)))


@query("op13_token_align")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of byte-level and piece tokens of all documents."""
    scratch = Scratch(spark, "token-align")
    vocabularies = token_align.files(spark)
    aligned = token_align.align(table(spark, sf_dir, "documents"), vocabularies)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    aligned = scratch.table(
        aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "aligned"
    )
    return token_align.with_link_counts(aligned, scratch, token_align.size_b(vocabularies))


@query(
    "op12_ngram_join",
    f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w
  FROM documents),
gram AS (
  SELECT DISTINCT doc_id,
         unnest(list_transform(range(1, len(w) - least(len(w), 3) + 2),
                               lambda i: array_to_string(w[i:i + least(len(w), 3) - 1], ' '))) AS g
  FROM words WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM gram x JOIN gram y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * c >= 90 * (x.n + y.n - c)),
step AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT doc_id, b FROM reach JOIN step ON a = other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN size USING (doc_id) GROUP BY doc_id""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share 90 % of their 3-word n-grams."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))
