"""The corpora the registered queries run over, all derived from the given tables.

``code``   one code-like artifact per order: four fragments picked by the order key
``text``   the documents table
``mixed``  both together
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcesift.functions.dialect import sql_text
from sourcesift.functions.text import local_table
from sourcesift.plans.fragments import FRAGMENTS
from sourcesift.sources.corpus import read_table_corpus

# Each order takes the fragments numbered (key * a + b) modulo their count.
PICKS = ((1, 0), (7, 3), (31, 11), (57, 29))
ARTIFACT_COLUMNS = ["artifact_id", "path", "src"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Artifacts a task reads. How many tasks there are follows from the rows, as files may hold them in a few large groups.
TASK_ROWS = 20_000


def spread(df: DataFrame) -> DataFrame:
    """Deal narrow rows evenly over tasks of at most ``TASK_ROWS``, two tasks per core at least."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores * 2, -(-df.count() // TASK_ROWS)))


def spread_texts(df: DataFrame) -> DataFrame:
    """Use every core when the input has fewer splits than cores; larger inputs keep their splits, so that their texts stay put."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * 2) if df.rdd.getNumPartitions() < cores else df


def code_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One artifact per order; the fragment table is a fixed handful of rows, so it is broadcast."""
    n = len(FRAGMENTS)
    out = spread(table(spark, sf_dir, "orders").select("o_orderkey"))
    fragments = local_table(spark, list(enumerate(FRAGMENTS)), "frag_id int, body string")
    for i, (a, b) in enumerate(PICKS):
        part = fragments.select(F.col("frag_id").alias(f"f{i}"), F.col("body").alias(f"b{i}"))
        key = F.pmod(F.col("o_orderkey") * a + b, F.lit(n))
        out = out.join(F.broadcast(part), key == F.col(f"f{i}"))
    text = F.concat_ws("\n", *[f"b{i}" for i in range(len(PICKS))])
    number = (F.col("o_orderkey") % 89).cast("string")
    key = F.col("o_orderkey").cast("string")
    return out.select(
        (F.col("o_orderkey") * 2).alias("artifact_id"),
        F.concat(F.lit("orders/"), key, F.lit(".js")).alias("path"),
        F.replace(text, F.lit("@K@"), number).alias("src"),
    )


def text_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return read_table_corpus(
        docs, F.col("doc_id") * 2 + 1, "text",
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")),
    ).select(*ARTIFACT_COLUMNS)


def mixed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_corpus(spark, sf_dir).unionByName(text_corpus(spark, sf_dir))


def stream_corpus(spark: SparkSession, events: DataFrame) -> DataFrame:
    """One artifact per event, stamped with the event's time; works on streams as well."""
    n = len(FRAGMENTS)
    fragments = local_table(spark, list(enumerate(FRAGMENTS)), "frag_id int, body string")
    joined = events.join(
        F.broadcast(fragments), F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(n)) == F.col("frag_id")
    )
    return joined.select(
        F.col("event_id").alias("artifact_id"),
        F.concat(F.lit("events/"), F.col("event_id").cast("string"), F.lit(".js")).alias("path"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), F.col("body").alias("src"),
    )


_CODE = (
    "SELECT o_orderkey * 2 AS artifact_id, 'orders/' || CAST(o_orderkey AS VARCHAR) || '.js' AS path, "
    "replace("
    + " || chr(10) || ".join(f"f{i}.body" for i in range(len(PICKS)))
    + ", '@K@', CAST(o_orderkey % 89 AS VARCHAR)) AS src FROM orders "
    + " ".join(
        f"JOIN frag f{i} ON f{i}.frag_id = (o_orderkey * {a} + {b}) % {len(FRAGMENTS)}"
        for i, (a, b) in enumerate(PICKS)
    )
)
_TEXT = (
    "SELECT doc_id * 2 + 1 AS artifact_id, 'documents/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, "
    "text AS src FROM documents"
)
_EVENTS = (
    "SELECT event_id AS artifact_id, 'events/' || CAST(event_id AS VARCHAR) || '.js' AS path, f.body AS src "
    f"FROM events JOIN frag f ON f.frag_id = (event_id * 7 + user_id) % {len(FRAGMENTS)}"
)
_FRAG = "frag(frag_id, body) AS (VALUES " + ", ".join(
    f"({i}, {sql_text(body)})" for i, body in enumerate(FRAGMENTS)
) + ")"


def corpus_sql(kind: str) -> str:
    """CTEs that end in ``corpus(artifact_id, path, src)``, without the leading WITH."""
    if kind == "text":
        return f"corpus AS MATERIALIZED ({_TEXT})"
    body = {"code": _CODE, "events": _EVENTS, "mixed": f"{_CODE} UNION ALL {_TEXT}"}[kind]
    return f"{_FRAG}, corpus AS MATERIALIZED ({body})"
