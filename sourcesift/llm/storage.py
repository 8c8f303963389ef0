"""Tables in the cluster's shared folder, and connected components over them."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcesift.functions.lineage import shared_folder


_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the session's Python workers, once; Spark hands the archive to every executor.

    The archive lies on the driver, which serves it as long as it runs.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package, folder = Path(__file__).resolve().parents[1], tempfile.TemporaryDirectory()
        _SHIPPED[context.applicationId] = folder
        tree = Path(folder.name) / "tree"
        shutil.copytree(package, tree / package.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder.name}/sourcesift-{context.applicationId}", "zip", tree))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def row_key() -> dict[str, Column]:
    """Key columns that tell rows of documents apart by doc_id and text, a null doc_id being a value of its own."""
    return {"_null": F.col("doc_id").isNull(), "_id": F.coalesce("doc_id", F.lit(0)), "_text": F.xxhash64("text")}


#: With it Spark removes a query's shuffle files as soon as the query is done.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, *done: DataFrame) -> DataFrame:
    """Write the rows as Parquet to a new folder in the shared folder and go on from there.

    Later steps neither repeat the work nor depend on the executors that did it, so the shuffle files
    that led here are removed, and so are the stored tables ``done`` that nothing reads any more.
    """
    spark = df.sparkSession
    path = shared_folder(spark) + "/table"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    for table in done:
        place = spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    out = spark.read.parquet(path)
    out._stored_at = path
    return out


def _folded(edges: DataFrame) -> DataFrame:
    return edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the undirected ``edges`` (a, b); component is the smallest node.

    Alternating large-star and small-star steps, each an aggregation and an equi join, until the
    edges no longer change. Every round is written to the shared folder. Nodes without an edge to
    another node do not appear; an empty edge table gives an empty result.
    """
    edges = stored(_folded(edges))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _folded(large)
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(_folded(small.unionByName(lower.select("a", F.col("m").alias("b")))), edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
