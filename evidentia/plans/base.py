"""What the query modules share: test tables in the roles of the engine's entities, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index, lexical, vector_index
from ..operators.keyword_index import KeywordIndex, ensure, joined
from ..operators.layout import files_signature

#: Text columns of the keyword index.
FIELDS = ["page_content", "title_text"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, and its SQL if SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, values: str, names: str) -> DataFrame:
    """Literal rows, written as VALUES that both dialects read."""
    return spark.sql(f"SELECT * FROM (VALUES {values}) AS t({names})")


def big(df: DataFrame, *cols: str) -> DataFrame:
    """Whole numbers as bigint, as SQL gives them."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: family by language, role and file by source, page by id, first line as heading."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("page_content"), F.col("source").alias("source_file"), F.col("lang").alias("doc_family"), F.col("source").alias("doc_role"),
        F.col("lang").alias("clause_id"), F.substring_index("text", "\n", 1).alias("heading"), F.col("doc_id").alias("page"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


_indexes: dict[tuple[str, str], str] = {}


def keyword_index(spark: SparkSession, sf_dir: str, *fields: str) -> KeywordIndex:
    """The stored index of the chunks' texts and titles, or of the named field alone: each field is built by the first query that needs it, then opened while the table's files stay as they are."""
    signed = files_signature(spark, f"{sf_dir}/documents.parquet")
    at = (spark.sparkContext.applicationId, signed)
    if at not in _indexes:
        _indexes[at] = index.scratch_path(spark, "keywords")
    made = lexical.title_field(chunks(spark, sf_dir))
    return joined(*[ensure(made, [f], _indexes[at], f"{signed} {f}") for f in fields or FIELDS])


def stored_vectors(spark: SparkSession, sf_dir: str, by: str = "label") -> vector_index.VectorIndex:
    """The stored index of the vectors, grouped by label, or by the language of the document with the same id."""
    sources = ["embeddings"] if by == "label" else ["embeddings", "documents"]
    signed = f"{by} {files_signature(spark, *[f'{sf_dir}/{name}.parquet' for name in sources])}"
    at = (spark.sparkContext.applicationId, signed)
    if at not in _indexes:
        _indexes[at] = index.scratch_path(spark, "vector-index")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label", F.col("embedding").alias("vec"))
    if by != "label":
        rows = rows.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id", "left")
    return vector_index.ensure(rows, _indexes[at], signed, group=F.col("label" if by == "label" else "lang"))


def standing(spark: SparkSession, sf_dir: str) -> dict[str, KeywordIndex | vector_index.VectorIndex]:
    """Of the stored indexes that a hybrid search can use (`index`, and `vector_index` by family) those that this session has built for other queries. To build them takes longer than to answer one batch of questions without."""
    found: dict[str, KeywordIndex | vector_index.VectorIndex] = {}
    app, signed = spark.sparkContext.applicationId, files_signature(spark, f"{sf_dir}/documents.parquet")
    signs = [f"{signed} {f}" for f in FIELDS]
    if (path := _indexes.get((app, signed))) and all(index.stored_signature(spark, index.state(path, s)) == s for s in signs):
        found["index"] = keyword_index(spark, sf_dir)
    signed = f"family {files_signature(spark, *[f'{sf_dir}/{name}.parquet' for name in ('embeddings', 'documents')])}"
    if (path := _indexes.get((app, signed))) and index.stored_signature(spark, index.state(path, signed)) == signed:
        found["vector_index"] = stored_vectors(spark, sf_dir, "family")
    return found


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("page"), "text")


def spec_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with heading lines put in by rule: invented prose has none."""
    d, i = F.col("doc_id"), F.col

    def line(x, n):
        m = (d * 3 + n) % 8
        n = n.cast("bigint")
        a, b = (1 + n % 3).cast("string"), (1 + d % 4).cast("string")
        return (
            F.when(m == 0, F.concat(a, F.lit("."), b, F.lit(" Coating requirements "), d.cast("string")))
            .when(m == 1, F.concat(a, F.lit("."), b, F.lit("."), (1 + n % 5).cast("string")))
            .when(m == 2, F.concat(a, F.lit(". The rules of part "), n.cast("string")))
            .when((m == 3) & (d % 3 == 0), F.lit("Scope:"))
            .when(m == 4, F.concat(F.lit("Part "), F.char(65 + n % 3), F.lit(" - Tier events")))
            .otherwise(x)
        )

    return table(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), d.alias("page"), F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("text"))


# The same in SQL.
TOKENS = r"""flatten(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9][a-z0-9\-.]*'), lambda t: CASE WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN [t, substr(t, 1, length(t) - 1)] ELSE [t] END))"""
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
NORMAL = r"lower(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')))"
CHUNKS = "chunks AS (SELECT doc_id AS chunk_id, text AS page_content, source AS source_file, lang AS doc_family, source AS doc_role, lang AS clause_id, string_split(text, chr(10))[1] AS heading, doc_id AS page FROM documents)"
QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
LINES = "lines AS (SELECT source_file, page, u.i - 1 AS line_no, ls[u.i] AS line FROM (SELECT source_file, page, string_split(text, chr(10)) AS ls FROM {0}), unnest(range(1, len(ls) + 1)) AS u(i))"
PAGES = "pg AS (SELECT source AS source_file, doc_id AS page, text FROM documents)"
SPEC = """spec AS (SELECT source AS source_file, doc_id AS page, array_to_string(list_transform(range(0, len(ls)), lambda n: CASE
  WHEN (doc_id * 3 + n) % 8 = 0 THEN (1 + n % 3) || '.' || (1 + doc_id % 4) || ' Coating requirements ' || doc_id
  WHEN (doc_id * 3 + n) % 8 = 1 THEN (1 + n % 3) || '.' || (1 + doc_id % 4) || '.' || (1 + n % 5)
  WHEN (doc_id * 3 + n) % 8 = 2 THEN (1 + n % 3) || '. The rules of part ' || n
  WHEN (doc_id * 3 + n) % 8 = 3 AND doc_id % 3 = 0 THEN 'Scope:'
  WHEN (doc_id * 3 + n) % 8 = 4 THEN 'Part ' || chr(CAST(65 + n % 3 AS INTEGER)) || ' - Tier events' ELSE ls[n + 1] END), chr(10)) AS text
  FROM (SELECT *, string_split(text, chr(10)) AS ls FROM documents))"""


def bm25(field: str = "page_content", name: str = "bm", source: str = "chunks") -> str:
    """CTEs that end in {name}(query_id, chunk_id, score)."""
    return f"""
{name}_t AS (SELECT chunk_id, {TOKENS.format(field)} AS toks FROM {source}),
{name}_s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM {name}_t),
{name}_p AS (SELECT chunk_id, u.term, count(*) AS tf FROM {name}_t, unnest(toks) AS u(term) GROUP BY 1, 2),
{name}_i AS (SELECT term, ln((s.n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM {name}_p, {name}_s s GROUP BY term, s.n),
{name}_q AS (SELECT DISTINCT query_id, u.term FROM questions, unnest({TOKENS.format("question")}) AS u(term)),
{name} AS (SELECT q.query_id, p.chunk_id, sum(i.idf * p.tf * 2.5::DOUBLE / (p.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t.toks) / s.avgdl))) AS score
  FROM {name}_q q JOIN {name}_p p USING (term) JOIN {name}_i i USING (term) JOIN {name}_t t USING (chunk_id), {name}_s s GROUP BY 1, 2)"""


def ranked(scores: str, name: str, k: int) -> str:
    return f"{name} AS (SELECT query_id, chunk_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {scores} WHERE score > 0) WHERE rank <= {k})"
