"""Reading artifacts: one row per text, with its size and content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcesift.functions.dialect import java_regex


def _artifacts(df: DataFrame) -> DataFrame:
    return df.select(
        "artifact_id",
        "path",
        "src",
        F.octet_length("src").cast("bigint").alias("n_bytes"),
        F.md5("src").alias("content_md5"),
    )


def read_table_corpus(
    df: DataFrame, artifact_id: Column | str, text: str, path: Column | str | None = None
) -> DataFrame:
    """Any table with a text column as artifacts."""
    key = F.col(artifact_id) if isinstance(artifact_id, str) else artifact_id
    name = F.col(path) if isinstance(path, str) else path
    return _artifacts(
        df.select(
            key.cast("bigint").alias("artifact_id"),
            (key.cast("string") if name is None else name).alias("path"),
            F.coalesce(F.col(text), F.lit("")).alias("src"),
        )
    )


def read_corpus(spark: SparkSession, directory: str, suffix: str = ".js") -> DataFrame:
    """Every file of a directory (not its subfolders) with the suffix, whole, as artifacts.

    The id is a 64-bit hash of the path, so it is the same in every run and needs no counter.
    """
    files = spark.read.option("pathGlobFilter", f"*{suffix}").text(directory, wholetext=True)
    if files.isEmpty():
        raise FileNotFoundError(f"no *{suffix} files in {directory}")
    files = files.select("value", F.input_file_name().alias("path"))
    return _artifacts(
        files.select(F.xxhash64("path").alias("artifact_id"), "path", F.col("value").alias("src"))
    )


def split_oversized(artifacts: DataFrame, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Artifacts to scan and the ones over the size limit, kept apart rather than dropped."""
    fits = F.octet_length("src") <= max_bytes
    return artifacts.filter(fits), artifacts.filter(~fits)


def extract_inline_scripts(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """One row per inline script body of an HTML page."""
    found = F.regexp_extract_all(
        html, F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1)
    )
    rows = pages.select(page_id, F.posexplode(found).alias("script_no", "script"))
    return rows.filter("script != ''")


def harvest_urls(*url_lists: DataFrame) -> DataFrame:
    """Union of URL lists, scripts only, each once, with the file name it is stored under."""
    urls = url_lists[0].select("url")
    for more in url_lists[1:]:
        urls = urls.unionByName(more.select("url"))
    scripts = urls.filter(F.col("url").rlike(java_regex(r"(?i)\.(js|mjs)$"))).distinct()
    return scripts.select("url", F.concat(F.md5("url"), F.lit(".js")).alias("file_name"))
