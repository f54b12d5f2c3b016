"""Queries on tokens, concordances, token frequencies and keyness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import stopwords
from textloom.operators import keyness, kwic, tokens
from textloom.operators.columns import add_columns
from textloom.operators.sampling import head_and_tail
from textloom.plans.registry import documents, query, table
from textloom.session import scratch_path

WORD = "[\\p{L}\\p{N}]+"


# --- SQL building blocks ----------------------------------------------------


def spans_sql(source: str, ids: str, pattern: str, by: str = "doc_id") -> str:
    """All matches of a pattern with offsets, as rows (ids, text, matched, start, stop)."""
    return f"""(SELECT {ids}, text, matched, CAST(before + skipped AS BIGINT) AS start,
                       CAST(before + skipped + length(matched) AS BIGINT) AS stop
        FROM (SELECT {ids}, text, matched,
                     sum(length(gap)) OVER (PARTITION BY {by} ORDER BY i) AS before,
                     coalesce(sum(length(matched)) OVER (PARTITION BY {by} ORDER BY i
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS skipped
              FROM (SELECT {ids}, text, unnest(regexp_extract_all(text, '{pattern}')) AS matched,
                           unnest(regexp_split_to_array(text, '{pattern}')) AS gap,
                           generate_subscripts(regexp_split_to_array(text, '{pattern}'), 1) AS i
                    FROM {source}))
        WHERE matched IS NOT NULL)"""


def kwic_sql(
    source: str, ids: str, pattern: str, left: int = 10, right: int = 10, by: str = "doc_id"
) -> str:
    """The flat hit table of a pattern search."""
    lead = f"^\\s*(\\S+(?:\\s+\\S+){{0,{max(left, 1) - 1}}})"
    tail = f"^\\s*(\\S+(?:\\s+\\S+){{0,{max(right, 1) - 1}}})"
    return f"""(SELECT {ids}, text, length(text) AS doc_length, l AS left_context, matched,
            r AS right_context, start, stop, regexp_extract(l, '(\\S+)$', 1) AS l1,
            regexp_extract(r, '^(\\S+)', 1) AS r1,
            substring(text, greatest(0, start - pl) + 1,
                      stop + pr - greatest(0, start - pl)) AS extraction
        FROM (SELECT *, length(l) + CASE WHEN l <> '' THEN 1 ELSE 0 END AS pl,
                     length(r) + CASE WHEN r <> '' THEN 1 ELSE 0 END AS pr
              FROM (SELECT *,
                       reverse(regexp_extract(reverse(text[1:start]), '{lead}', 1)) AS l,
                       regexp_extract(substring(text, stop + 1), '{tail}', 1) AS r
                    FROM {spans_sql(source, ids, pattern, by)})))"""


HIT_COLUMNS = """left_context AS "CONC_left_context", matched AS "CONC_matched_text",
    right_context AS "CONC_right_context", start AS "CONC_start_idx", stop AS "CONC_end_idx",
    l1 AS "CONC_l1", r1 AS "CONC_r1" """


def token_table_sql(source: str, ids: str, by: str = "doc_id") -> str:
    return f"""(SELECT {ids}, text, lower(matched) AS token, start, stop,
                       row_number() OVER (PARTITION BY {by} ORDER BY start) AS place
                FROM {spans_sql(source, ids, WORD, by)})"""


def token_hits_sql(source: str, ids: str, wanted: list[str], width: int, by: str = "doc_id") -> str:
    """The flat hit table of a token search."""
    doc = f"(PARTITION BY {by} ORDER BY place)"
    listed = ", ".join(f"'{w}'" for w in wanted)
    return f"""(SELECT {ids}, text, token AS matched, start, stop, l1, r1,
                  substring(text, first_start + 1, start - first_start) AS left_context,
                  substring(text, stop + 1, last_stop - stop) AS right_context,
                  substring(text, first_start + 1, last_stop - first_start) AS extraction
        FROM (SELECT *, lag(token) OVER {doc} AS l1, lead(token) OVER {doc} AS r1,
                     min(start) OVER (PARTITION BY {by} ORDER BY place
                        ROWS BETWEEN {width} PRECEDING AND CURRENT ROW) AS first_start,
                     max(stop) OVER (PARTITION BY {by} ORDER BY place
                        ROWS BETWEEN CURRENT ROW AND {width} FOLLOWING) AS last_stop
              FROM {token_table_sql(source, ids, by)}) WHERE token IN ({listed}))"""


# --- tokens -----------------------------------------------------------------


@query(
    "k1_tokenise",
    f"""SELECT doc_id, count(*) AS n, min_by(token, start) AS first, max_by(token, start) AS last,
               CAST(sum(start) AS BIGINT) AS starts, CAST(sum(stop) AS BIGINT) AS ends
        FROM {token_table_sql("documents", "doc_id")} GROUP BY doc_id""",
)
def k1_tokenise(spark: SparkSession, sf: str) -> DataFrame:
    # A text without a word has no first and last one, and no row. Asked of the text: the token
    # column would be computed twice for a filter on its size.
    worded = documents(spark, sf).filter(F.col("text").rlike(tokens.model_pattern("word")))
    docs = tokens.tokenise(worded, "text", "word", "en")
    column = F.col(tokens.find_derived(docs, "text"))

    def total(field: str):
        return F.aggregate(column, F.lit(0).cast("bigint"), lambda s, t: s + t[field])

    return docs.select(
        "doc_id",
        F.size(column).cast("bigint").alias("n"),
        F.element_at(column, 1)["token"].alias("first"),
        F.element_at(column, -1)["token"].alias("last"),
        total("start").alias("starts"),
        total("end").alias("ends"),
    )


@query(
    "k1_models",
    """SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) AS whitespace,
              len(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS word,
              len(regexp_extract_all(text, '[\\p{Han}]|[\\p{L}\\p{N}]+')) AS char
       FROM documents""",
)
def k1_models(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id",
        *[
            F.size(tokens.token_spans(F.col("text"), m)).cast("bigint").alias(m)
            for m in ("whitespace", "word", "char")
        ],
    )


@query(
    "k2_explode_tokens",
    f"""SELECT doc_id, token, start, stop AS "end" FROM {token_table_sql("documents", "doc_id")}""",
)
def k2_explode_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = tokens.tokenise(documents(spark, sf), "text")
    return tokens.explode_tokens(docs, tokens.find_derived(docs, "text"), ["doc_id"])


@query(
    "k4_carry_derived",
    f"""SELECT doc_id, lang, len(regexp_extract_all(text, '{WORD}')) AS n FROM documents
        WHERE n_chars > 500 UNION ALL
        SELECT doc_id, lang, len(regexp_extract_all(text, '{WORD}')) FROM documents
        WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def k4_carry_derived(spark: SparkSession, sf: str) -> DataFrame:
    docs = tokens.tokenise(documents(spark, sf), "text")
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    long = docs.filter("n_chars > 500")
    both = long.unionByName(docs.join(toxic, "doc_id", "left_semi"))
    name = tokens.find_derived(both, "text", model="word")
    counted = add_columns(both, f"n = CAST(size(`{name}`) AS BIGINT)")
    return tokens.drop_derived(counted, name).select("doc_id", "lang", "n")


STORE_SQL = f"""SELECT sha256('word' || chr(1) || text) AS text_hash, len(regexp_extract_all(text, '{WORD}')) AS n
    FROM (SELECT DISTINCT text FROM documents)"""


def filled_store(spark: SparkSession, sf: str) -> str:
    """A store filled in two steps, the second one bringing mostly known texts."""
    path = scratch_path(spark, "token-store")
    docs = documents(spark, sf)
    tokens.update_token_store(docs.filter("lang <> 'en'"), "text", path)
    tokens.update_token_store(docs, "text", path)
    return path


@query("k5_token_store", STORE_SQL)
def k5_token_store(spark: SparkSession, sf: str) -> DataFrame:
    stored = tokens.read_token_store(spark, filled_store(spark, sf))
    return stored.select("text_hash", F.size("tokens").cast("bigint").alias("n"))


@query("k5_compaction", STORE_SQL)
def k5_compaction(spark: SparkSession, sf: str) -> DataFrame:
    path, target = filled_store(spark, sf), scratch_path(spark, "token-store-compact")
    tokens.compact_when(spark, path, target, tokens.STORE_SCHEMA, files=4, limit=1)
    stored = spark.read.parquet(target)
    return stored.select("text_hash", F.size("tokens").cast("bigint").alias("n"))


@query(
    "k5_two_models",
    """SELECT doc_id, len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS n FROM documents""",
)
def k5_two_models(spark: SparkSession, sf: str) -> DataFrame:
    """A store filled with the tokens of one model, read with another."""
    path = filled_store(spark, sf)
    docs = tokens.tokenise_from_store(documents(spark, sf), "text", path, "whitespace")
    column = tokens.find_derived(docs, "text", model="whitespace")
    return docs.select("doc_id", F.size(column).cast("bigint").alias("n"))


@query("k5_tokens_from_store", f"SELECT doc_id, len(regexp_extract_all(text, '{WORD}')) AS n FROM documents")
def k5_tokens_from_store(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "token-store")
    docs = tokens.tokenise_from_store(documents(spark, sf), "text", path)
    column = tokens.find_derived(docs, "text", model="word")
    return docs.select("doc_id", F.size(column).cast("bigint").alias("n"))


@query(
    "k6_vector_store",
    """WITH keys AS (SELECT DISTINCT CAST(vec_id AS VARCHAR) AS t FROM embeddings UNION
                     SELECT 'item ' || item_id FROM benchmark)
       SELECT sha256('local' || chr(1) || 'mini' || chr(1) || t) AS content_hash,
              CASE WHEN label < 3 THEN CAST(embedding[2] AS DOUBLE)
                   WHEN label < 6 THEN CAST(embedding[1] AS DOUBLE) END AS value
       FROM keys LEFT JOIN embeddings ON t = CAST(vec_id AS VARCHAR)""",
)
def k6_vector_store(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    vectors = table(spark, sf, "embeddings").select(
        tokens.vector_key(F.col("vec_id").cast("string"), "mini", "local").alias("content_hash"),
        "label",
        "embedding",
    )
    tokens.store_vectors(vectors.filter("label < 6"), path, "mini", "2024-01-01 00:00:00")
    newer = vectors.filter("label < 3").withColumn("embedding", F.expr("slice(embedding, 2, 63)"))
    tokens.store_vectors(newer, path, "mini", "2024-02-01 00:00:00")
    items = table(spark, sf, "benchmark").select(
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("t")
    )
    texts = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("t"))
    keys = texts.unionByName(items).select(
        tokens.vector_key(F.col("t"), "mini", "local").alias("content_hash")
    )
    store = tokens.read_store(spark, path, tokens.VECTOR_SCHEMA)
    hits, missing = tokens.lookup_vectors(keys, store)
    found = hits.select("content_hash", F.element_at("embedding", 1).cast("double").alias("value"))
    return found.unionByName(missing.withColumn("value", F.lit(None).cast("double")))


def word_list_sql(language: str) -> str:
    return ", ".join(f"'{w}'" for w in stopwords.default_stop_words(language))


COUNTS = f"""(SELECT token, count(*) AS frequency FROM (
    SELECT unnest(regexp_extract_all(lower(text), '{WORD}')) AS token FROM documents)
    GROUP BY token)"""


@query("k7_stop_words", f"SELECT * FROM {COUNTS} WHERE token NOT IN ({word_list_sql('fr')})")
def k7_stop_words(spark: SparkSession, sf: str) -> DataFrame:
    counts = keyness.token_frequencies(documents(spark, sf), "text")
    return keyness.without_stop_words(counts, stopwords.default_stop_words("french"))


@query(
    "k8_language",
    """SELECT doc_id, coalesce(nullif(lang, 'es'), 'en') AS own,
              'de' AS requested FROM documents""",
)
def k8_language(spark: SparkSession, sf: str) -> DataFrame:
    blanked = F.when(F.col("lang") == "es", F.lit(" ")).otherwise(F.upper("lang"))
    return documents(spark, sf).select(
        "doc_id",
        stopwords.language_column(None, blanked).alias("own"),
        stopwords.language_column(" DE ", F.col("lang")).alias("requested"),
    )


# --- concordance ------------------------------------------------------------


@query(
    "k9_whole_word",
    """SELECT doc_id, count(*) AS hits FROM (
         SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+')) AS w
         FROM documents) WHERE w = 'the' GROUP BY doc_id""",
)
def k9_whole_word(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.matches(documents(spark, sf), "text", "the", ["doc_id"], whole_word=True)
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


ROW_LANGUAGE = "CASE WHEN doc_id % 3 = 0 THEN ' ZH ' WHEN doc_id % 3 = 1 THEN lang END"


def row_language_sql(word: str, unspaced: str) -> str:
    """Hits per document: anywhere in texts that meet ``unspaced``, as whole words in the others."""
    return f"""SELECT doc_id, count(*) AS hits FROM (
          SELECT doc_id, unnest(CASE WHEN {unspaced} THEN regexp_extract_all(lower(text), '{word}')
             ELSE list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+'),
                              lambda w: w = '{word}') END)
          FROM documents) GROUP BY doc_id"""


@query("k9_row_language", row_language_sql("the", f"({ROW_LANGUAGE}) = ' ZH '"))
def k9_row_language(spark: SparkSession, sf: str) -> DataFrame:
    """Whole words in a table where every third text is of a language without spaces."""
    docs = documents(spark, sf).withColumn("own", F.expr(ROW_LANGUAGE))
    hits = kwic.matches(docs, "text", "the", ["doc_id"], whole_word=True, language_col="own")
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query("k10_row_language", row_language_sql("her", "lang = 'de'"))
def k10_row_language(spark: SparkSession, sf: str) -> DataFrame:
    """The German texts are searched as if they had no spaces, the others by whole words."""
    own = F.when(F.col("lang") == "de", "ko").otherwise(F.col("lang"))
    docs = documents(spark, sf).withColumn("own", own)
    hits = kwic.concordance(docs, "text", "her", ["doc_id"], whole_word=True, language_col="own")
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "k10_concordance",
    f"SELECT doc_id, {HIT_COLUMNS} FROM {kwic_sql('documents', 'doc_id', '(?i)th[a-z]+on')}",
)
def k10_concordance(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.concordance(documents(spark, sf), "text", "th[a-z]+on", ["doc_id"], regex=True)
    return hits.select("doc_id", *kwic.CORE)


@query(
    "k10_literal_case",
    f"SELECT doc_id, {HIT_COLUMNS} FROM {kwic_sql('documents', 'doc_id', 'ung. ', 3, 5)}",
)
def k10_literal_case(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.concordance(
        documents(spark, sf), "text", "ung. ", ["doc_id"], left=3, right=5, regex=True,
        case_sensitive=True,
    )
    return hits.select("doc_id", *kwic.CORE)


@query(
    "k11_flat_hits",
    f"""SELECT doc_id, lang, source, {HIT_COLUMNS}, extraction AS "CONC_extraction"
        FROM {kwic_sql("documents", "doc_id, lang, source", "(?i)(keit|heit|ción)")}""",
)
def k11_flat_hits(spark: SparkSession, sf: str) -> DataFrame:
    keep = ["doc_id", "lang", "source"]
    hits = kwic.concordance(documents(spark, sf), "text", "(keit|heit|ción)", keep, regex=True)
    return hits.drop("CONC_doc_length")


@query(
    "k11_blank",
    "SELECT doc_id, 1::BIGINT AS hits, 1::BIGINT AS counted FROM documents WHERE doc_id % 5 <> 0",
)
def k11_blank(spark: SparkSession, sf: str) -> DataFrame:
    """A text of white space only has no hits, in the table or in the counts."""
    text = "CASE WHEN doc_id % 5 = 0 THEN '\n\t ' ELSE concat(lang, '\t', source) END AS t"
    docs = documents(spark, sf).selectExpr("doc_id", text)
    hits = kwic.concordance(docs, "t", "[\\t]", ["doc_id"], regex=True)
    counted = kwic.matches(docs, "t", "[\\t]", ["doc_id"], regex=True)
    both = hits.select("doc_id", F.lit(1).alias("h")).unionByName(
        counted.select("doc_id", F.lit(0).alias("h"))
    )
    return both.groupBy("doc_id").agg(
        F.count_if(F.col("h") == 1).alias("hits"), F.count_if(F.col("h") == 0).alias("counted")
    )


@query(
    "k12_extraction",
    f"""SELECT doc_id, start AS "CONC_start_idx", extraction, extraction AS again
        FROM {kwic_sql("documents", "doc_id", "(?i)qu", 2, 2)}""",
)
def k12_extraction(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.concordance(
        documents(spark, sf), "text", "qu", ["doc_id", "text"], left=2, right=2
    )
    return hits.select(
        "doc_id",
        "CONC_start_idx",
        F.col("CONC_extraction").alias("extraction"),
        kwic.extraction(F.col("text")).alias("again"),
    )


def with_freqs_sql(hits: str, columns: str) -> str:
    return f"""WITH h AS (SELECT * FROM {hits}),
        l AS (SELECT l1, count(*) AS l1_freq FROM h GROUP BY l1),
        r AS (SELECT r1, count(*) AS r1_freq FROM h GROUP BY r1)
        SELECT {columns}, l.l1_freq AS "CONC_l1_freq", r.r1_freq AS "CONC_r1_freq"
        FROM h LEFT JOIN l ON h.l1 = l.l1 LEFT JOIN r ON h.r1 = r.r1"""


@query(
    "k13_neighbour_freqs",
    with_freqs_sql(
        kwic_sql("documents", "doc_id", "(?i)tion"),
        'doc_id, start AS "CONC_start_idx", h.l1 AS "CONC_l1", h.r1 AS "CONC_r1"',
    ),
)
def k13_neighbour_freqs(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.concordance(documents(spark, sf), "text", "tion", ["doc_id"])
    return kwic.with_neighbour_freqs(hits).select(
        "doc_id", "CONC_start_idx", "CONC_l1", "CONC_r1", "CONC_l1_freq", "CONC_r1_freq"
    )


@query(
    "f10_token_neighbour_freqs",
    with_freqs_sql(
        token_hits_sql("documents", "doc_id", ["the", "und", "les"], 1),
        'doc_id, start AS "CONC_start_idx", h.l1 AS "CONC_l1", h.r1 AS "CONC_r1"',
    ),
)
def f10_token_neighbour_freqs(spark: SparkSession, sf: str) -> DataFrame:
    docs = tokens.tokenise(documents(spark, sf), "text")
    name = tokens.find_derived(docs, "text")
    hits = kwic.token_concordance(
        docs, "text", name, "the, und|les", ["doc_id"], left=1, right=1
    )
    return kwic.with_neighbour_freqs(hits).select(
        "doc_id", "CONC_start_idx", "CONC_l1", "CONC_r1", "CONC_l1_freq", "CONC_r1_freq"
    )


@query(
    "k14_token_hits",
    f"""SELECT doc_id, coalesce(hits, 0) AS hits, least, last_end FROM documents LEFT JOIN (
          SELECT doc_id AS id, count(*) AS hits, min(matched) AS least, max(stop) AS last_end
          FROM {token_hits_sql("documents", "doc_id", ["the", "der"], 3)} GROUP BY doc_id)
        ON doc_id = id""",
)
def k14_token_hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.token_hits(F.col("text"), tokens.token_spans(F.col("text")), "The DER", 3, 3)
    return documents(spark, sf).select("doc_id", hits.alias("h")).select(
        "doc_id",
        F.size("h").cast("bigint").alias("hits"),
        F.array_min("h.CONC_matched_text").alias("least"),
        F.array_max("h.CONC_end_idx").alias("last_end"),
    )


@query(
    "k15_token_concordance",
    f"""SELECT doc_id, lang, {HIT_COLUMNS}, extraction AS "CONC_extraction"
        FROM {token_hits_sql("documents", "doc_id, lang", ["the", "und", "les"], 5)}""",
)
def k15_token_concordance(spark: SparkSession, sf: str) -> DataFrame:
    docs = tokens.tokenise(documents(spark, sf), "text")
    name = tokens.find_derived(docs, "text")
    hits = kwic.token_concordance(
        docs, "text", name, "the,und | LES", ["doc_id", "lang"], left=5, right=5
    )
    return hits.drop("CONC_doc_length")


@query(
    "k16_non_empty",
    f"""SELECT doc_id, start AS "CONC_start_idx" FROM {spans_sql("documents", "doc_id", "[,\\s]")}
        WHERE matched = ','""",
)
def k16_non_empty(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.concordance(
        documents(spark, sf), "text", "[,\\s]", ["doc_id"], left=0, right=0, regex=True
    )
    return kwic.non_empty(hits).select("doc_id", "CONC_start_idx")


PAGE = "(SELECT * FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 20)"


@query("k17_document_page", f"SELECT doc_id, {HIT_COLUMNS} FROM {kwic_sql(PAGE, 'doc_id', '(?i)ou', 4, 4)}")
def k17_document_page(spark: SparkSession, sf: str) -> DataFrame:
    page = kwic.document_page(
        documents(spark, sf), ["n_chars", "doc_id"], page=2, page_size=20, descending=True
    )
    hits = kwic.concordance(page, "text", "ou", ["doc_id"], left=4, right=4)
    return hits.select("doc_id", *kwic.CORE)


@query(
    "k18_page_size",
    """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r,
                         len(regexp_extract_all(text, 'ü')) AS n FROM documents),
            s AS (SELECT size, coalesce(sum(n), 0) AS hits
                  FROM (VALUES (10), (20), (50), (100)) v(size) JOIN d ON r <= size GROUP BY size)
       SELECT CAST(coalesce(min(size) FILTER (hits >= 10), 100) AS BIGINT) AS page_size FROM s""",
)
def k18_page_size(spark: SparkSession, sf: str) -> DataFrame:
    return kwic.estimate_page_size(documents(spark, sf), "text", "ü", ["doc_id"])


def two_sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    items = table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    hits = [
        kwic.concordance(df, "text", word, ["doc_id"], left=3, right=3)
        for df, word in ((documents(spark, sf), "heron"), (items, "then"))
    ]
    return hits[0], hits[1]


ITEMS = "(SELECT item_id AS doc_id, text FROM benchmark)"


@query(
    "k19_interleave",
    f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY doc_id, start) AS n, 'docs' AS src
                   FROM {kwic_sql("documents", "doc_id", "(?i)heron", 3, 3)}),
             r AS (SELECT *, row_number() OVER (ORDER BY doc_id, start) AS n, 'items' AS src
                   FROM {kwic_sql(ITEMS, "doc_id", "(?i)then", 3, 3)}),
             u AS (SELECT *, 0 AS side FROM l UNION ALL SELECT *, 1 FROM r)
        SELECT doc_id, {HIT_COLUMNS}, src AS __source_node,
               row_number() OVER (ORDER BY n, side) AS position FROM u""",
)
def k19_interleave(spark: SparkSession, sf: str) -> DataFrame:
    left, right = two_sources(spark, sf)
    both = kwic.interleave(left, right, ["doc_id", "CONC_start_idx"], "docs", "items")
    return both.select("doc_id", *kwic.CORE, "__source_node", "position")


TURNS = "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"


@query(
    "k20_append_sources",
    f"""SELECT doc_id, start AS "CONC_start_idx", matched AS "CONC_matched_text",
               src AS __source_node, o AS __source_order FROM (
          SELECT *, 'docs' AS src, 0 AS o FROM {spans_sql("documents", "doc_id", "(?i)heron")}
          UNION ALL
          SELECT *, 'items', 1 FROM {spans_sql(ITEMS, "doc_id", "(?i)then")} UNION ALL
          SELECT *, 'turns', 2 FROM {spans_sql(TURNS, "doc_id", "(?i)ier")})""",
)
def k20_append_sources(spark: SparkSession, sf: str) -> DataFrame:
    left, right = two_sources(spark, sf)
    turns = table(spark, sf, "conversations").withColumn("doc_id", F.expr("conv_id * 1000 + turn"))
    third = kwic.concordance(turns, "text", "ier", ["doc_id"], left=3, right=3)
    rows = kwic.append_sources([("docs", left), ("items", right), ("turns", third)])
    return rows.select(
        "doc_id", "CONC_start_idx", "CONC_matched_text", "__source_node", "__source_order"
    )


@query(
    "k21_detach",
    with_freqs_sql(
        kwic_sql("documents", "doc_id, lang", "(?i)uever|onth", 4, 4),
        """lang, doc_id, left_context AS "CONC_left_context", matched AS "CONC_matched_text",
           right_context AS "CONC_right_context", start AS "CONC_start_idx",
           stop AS "CONC_end_idx", h.l1 AS "CONC_l1", h.r1 AS "CONC_r1",
           extraction AS "CONC_extraction" """,
    ),
)
def k21_detach(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.concordance(
        documents(spark, sf), "text", "uever|onth", ["doc_id", "lang"], left=4, right=4, regex=True
    )
    return kwic.detach(kwic.with_neighbour_freqs(hits), ["lang", "doc_id"], with_extraction=True)


@query(
    "k22_hits_by_document",
    f"""SELECT doc_id, count(*) AS n, string_agg(matched || '@' || start, ' ' ORDER BY start) AS hits
        FROM {spans_sql("documents", "doc_id", "(?i)the[a-z]")} GROUP BY doc_id""",
)
def k22_hits_by_document(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.matches(documents(spark, sf), "text", "the[a-z]", ["doc_id"], regex=True)
    grouped = kwic.hits_by_document(
        hits.select("doc_id", "CONC_start_idx", "CONC_matched_text"), "doc_id"
    )
    shown = F.transform(
        "hits",
        lambda h: F.concat(
            h["CONC_matched_text"], F.lit("@"), h["CONC_start_idx"].cast("string")
        ),
    )
    return grouped.select(
        "doc_id", F.size("hits").cast("bigint").alias("n"), F.array_join(shown, " ").alias("hits")
    )


@query(
    "h4_hit_summary",
    f"""SELECT count(*) AS record_count, count(DISTINCT doc_id) AS unique_documents_with_hits,
               (SELECT count(*) FROM documents) AS total_source_documents
        FROM {spans_sql("documents", "doc_id", "(?i)und")}""",
)
def h4_hit_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return kwic.hit_summary(kwic.matches(docs, "text", "und", ["doc_id"]), "doc_id", docs)


FINE = f"""(SELECT *, least(99, greatest(0, floor(start / length(text) * 100))) AS bin
    FROM {spans_sql("documents", "doc_id, lang", "(?i)the|und")})"""


@query(
    "k23_dispersion",
    f"""SELECT matched AS matched_text, CAST(bin AS BIGINT) AS bin_idx, count(*) AS count
        FROM {FINE} GROUP BY 1, 2""",
)
def k23_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.matches(documents(spark, sf), "text", "the|und", ["doc_id"], regex=True)
    return kwic.dispersion(hits)


@query(
    "k24_rebin",
    f"""SELECT lang, lower(matched) AS matched_text, CAST(floor(bin / 5) AS BIGINT) AS bin_idx,
               count(*) AS count FROM {FINE} GROUP BY 1, 2, 3""",
)
def k24_rebin(spark: SparkSession, sf: str) -> DataFrame:
    keep = ["doc_id", "lang"]
    hits = kwic.matches(documents(spark, sf), "text", "the|und", keep, regex=True)
    fine = kwic.dispersion(hits, ["lang"])
    return kwic.rebin(fine, 20, merge_case=True, by=["lang"])


def bullets_sql(source: str, key: str, extra: str = "", where: str = "TRUE") -> str:
    bullet = "'- ' || trim(regexp_replace(extraction, '\\s+', ' ', 'g'))"
    return f"""SELECT {key}, string_agg({bullet}, chr(10) ORDER BY start) AS "CONC_extraction",
               string_agg(matched, '|' ORDER BY start) AS matched,
               string_agg(l1, '|' ORDER BY start) AS l1{extra}
        FROM {source} WHERE {where} GROUP BY {key}"""


def joined_lists(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "matched": F.array_join("CONC_matched_text", "|"),
            "l1": F.array_join("CONC_l1", "|"),
        }
    ).drop("CONC_matched_text", "CONC_l1", "CONC_r1")


@query(
    "k25_dispersion_detach",
    bullets_sql(
        kwic_sql("documents", "doc_id, lang", "(?i)the|und", 3, 3),
        "doc_id",
        ", min(lang) AS lang",
        "lower(matched) IN ('the') AND floor(start / doc_length * 4) IN (0, 3)",
    ),
)
def k25_dispersion_detach(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.concordance(
        documents(spark, sf), "text", "the|und", ["doc_id", "lang"], left=3, right=3, regex=True
    )
    rows = kwic.dispersion_detach(
        hits, "doc_id", ["lang"], bins=[0, 3], total_bins=4, matched_texts=["THE"], fold_case=True
    )
    return joined_lists(rows)


@query(
    "k25_detach_by_text",
    bullets_sql(
        "(SELECT text AS t, * FROM "
        + kwic_sql("(SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)",
                   "doc_id", "(?i)heron", 3, 3)
        + " JOIN (SELECT text AS tt, count(*) AS copies FROM documents GROUP BY text) "
          "ON text = tt)",
        "t",
        ", min(copies) AS copies",
    ).replace("SELECT t,", "SELECT t AS text,", 1),
)
def k25_detach_by_text(spark: SparkSession, sf: str) -> DataFrame:
    hits = kwic.concordance(documents(spark, sf), "text", "heron", ["text"], left=3, right=3)
    return joined_lists(kwic.dispersion_detach(hits, "text", merge_copies=True))


# --- frequencies and keyness ------------------------------------------------


@query("k26_frequencies", f"SELECT * FROM {COUNTS}")
def k26_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return keyness.token_frequencies(documents(spark, sf), "text")


@query("k26_from_tokens", f"SELECT * FROM {COUNTS}")
def k26_from_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return keyness.token_frequencies(tokens.tokenise(documents(spark, sf), "text"), "text")


def keyness_sql(columns: str, reference: str = "en", study: str = "de") -> str:
    return f"""WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '{WORD}')) AS token
                          FROM documents WHERE lang IN ('{reference}', '{study}')),
      o AS (SELECT token, CAST(count_if(lang = '{reference}') AS BIGINT) AS freq_reference,
                   CAST(count_if(lang = '{study}') AS BIGINT) AS freq_study FROM t GROUP BY token),
      c AS (SELECT *, CAST(freq_reference AS DOUBLE) AS o1, CAST(freq_study AS DOUBLE) AS o2,
                   CAST(sum(freq_reference) OVER () AS DOUBLE) AS c1,
                   CAST(sum(freq_study) OVER () AS DOUBLE) AS c2 FROM o),
      e AS (SELECT *, c1 * (o1 + o2) / (c1 + c2) AS e1, c2 * (o1 + o2) / (c1 + c2) AS e2,
                   o1 / c1 AS nf1, o2 / c2 AS nf2 FROM c),
      k AS (SELECT *, 2 * (CASE WHEN o1 > 0 THEN o1 * ln(o1 / e1) ELSE 0 END
                         + CASE WHEN o2 > 0 THEN o2 * ln(o2 / e2) ELSE 0 END) AS ll FROM e)
      SELECT {columns} FROM k"""


KEYNESS_COLUMNS = """token, freq_reference, freq_study, CAST(c1 AS BIGINT) AS reference_total,
    CAST(c2 AS BIGINT) AS study_total, round(e1, 6) AS expected_reference,
    round(e2, 6) AS expected_study, round(nf1 * 100, 6) AS percent_reference,
    round(nf2 * 100, 6) AS percent_study,
    CASE WHEN o1 > 0 THEN round((nf2 - nf1) / nf1 * 100, 6) END AS percent_diff,
    round(ll, 6) AS log_likelihood_llv, round(ll - ln(c1 + c2), 6) AS bayes_factor_bic,
    CASE WHEN least(e1, e2) <> 1 THEN round(ll / ((c1 + c2) * ln(least(e1, e2))), 6) END
      AS effect_size_ell,
    CASE WHEN o2 > 0 THEN round(nf1 / nf2, 6) END AS relative_risk,
    CASE WHEN o1 > 0 AND o2 > 0 THEN round(log2(nf2 / nf1), 6) END AS log_ratio,
    CASE WHEN o2 > 0 THEN round(o1 * (c2 - o2) / (o2 * (c1 - o1)), 6) END AS odds_ratio,
    CASE WHEN ll >= 15.13 THEN '****' WHEN ll >= 10.83 THEN '***' WHEN ll >= 6.63 THEN '**'
         WHEN ll >= 3.84 THEN '*' ELSE '' END AS significance"""


def corpora(spark: SparkSession, sf: str, *languages: str) -> list[DataFrame]:
    docs = documents(spark, sf)
    return [keyness.token_rows(docs.filter(F.col("lang") == x), "text") for x in languages]


def finite(df: DataFrame) -> DataFrame:
    """Doubles rounded, infinities as null."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    inf = float("inf")
    return df.withColumns(
        {n: F.when(F.abs(F.col(n)) < inf, F.round(n, 6)) for n in names}
    )


@query("k28_keyness", keyness_sql(KEYNESS_COLUMNS))
def k28_keyness(spark: SparkSession, sf: str) -> DataFrame:
    return finite(keyness.keyness(*corpora(spark, sf, "en", "de")))


@query(
    "k28_keyness_of_counts",
    keyness_sql("token, freq_reference, freq_study, round(ll, 6) AS log_likelihood_llv", "fr", "es"),
)
def k28_keyness_of_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    counts = [
        keyness.token_frequencies(docs.filter(F.col("lang") == x), "text") for x in ("fr", "es")
    ]
    names = ["token", "freq_reference", "freq_study", "log_likelihood_llv"]
    return finite(keyness.keyness_of_counts(*counts).select(*names))


@query(
    "k27_stop_words_after",
    keyness_sql("token, freq_study, round(ll, 6) AS log_likelihood_llv")
    + f" WHERE token NOT IN ({word_list_sql('en')})",
)
def k27_stop_words_after(spark: SparkSession, sf: str) -> DataFrame:
    scored = keyness.keyness(*corpora(spark, sf, "en", "de"))
    kept = keyness.without_stop_words(scored, stopwords.default_stop_words("en"))
    return finite(kept.select("token", "freq_study", "log_likelihood_llv"))


@query(
    "k29_infinities",
    keyness_sql(
        """token, CASE WHEN o1 = 0 THEN '+Inf' WHEN o2 = 0 THEN '-Inf' ELSE 'finite' END AS log_ratio,
           CASE WHEN o2 = 0 THEN '+Inf' ELSE 'finite' END AS relative_risk,
           CASE WHEN o1 = 0 THEN '+Inf' ELSE 'finite' END AS percent_diff"""
    ),
)
def k29_infinities(spark: SparkSession, sf: str) -> DataFrame:
    names = ["log_ratio", "relative_risk", "percent_diff"]
    spelled = keyness.spelled_infinities(keyness.keyness(*corpora(spark, sf, "en", "de")), names)
    kind = {
        n: F.when(F.col(n).endswith("Inf") | F.col(n).isNull(), F.col(n)).otherwise("finite")
        for n in names
    }
    return spelled.withColumns(kind).select("token", *names)


@query("k30_wildcard", f"SELECT * FROM {COUNTS} WHERE token LIKE 'the%on' OR token LIKE '%heit%'")
def k30_wildcard(spark: SparkSession, sf: str) -> DataFrame:
    counts = keyness.token_frequencies(documents(spark, sf), "text")
    return keyness.wildcard(counts, "the*on").unionByName(
        keyness.wildcard(counts, "*heit*")
    ).distinct()


CONTRAST = keyness_sql(
    "token, round(log10(o1 + o2) * log2(nf2 / nf1), 6) AS score"
) + " WHERE o1 > 0 AND o2 > 0"


@query(
    "k31_contrast",
    f"""(SELECT * FROM ({CONTRAST}) ORDER BY score DESC, token LIMIT 50) UNION
        (SELECT * FROM ({CONTRAST}) ORDER BY score, token LIMIT 50)""",
)
def k31_contrast(spark: SparkSession, sf: str) -> DataFrame:
    scored = keyness.contrast(keyness.keyness(*corpora(spark, sf, "en", "de")))
    rows = scored.select("token", F.round("score", 6).alias("score"))
    top = [F.desc("score"), F.asc("token")]
    return head_and_tail(rows, top, [F.asc("score"), F.asc("token")], 50)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    scored = finite(keyness.keyness(*corpora(spark, sf, "en", "de")))
    best = [F.desc("log_likelihood_llv"), F.asc("token")]
    return scored.orderBy(*best).limit(25)


@query(
    "flagship_keyness",
    f"SELECT * FROM ({keyness_sql(KEYNESS_COLUMNS)}) ORDER BY log_likelihood_llv DESC, token LIMIT 25",
)
def flagship_keyness(spark: SparkSession, sf: str) -> DataFrame:
    return flagship(spark, sf)
