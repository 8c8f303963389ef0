"""Benchmark decontamination by winnowing.

Each window of ``window`` words is stood for by the smallest hash of its k-word grams. Equal windows have
equal fingerprints, so joining the fingerprints of documents and items finds every shared window;
the windows behind each hit are then compared word by word and extended to covered spans.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcesift.llm.storage import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    """Words after lower-casing A-Z; none of a null text."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _fingerprints(window: int, gram: int) -> str:
    """SQL over ``h``, hashes of words: per window, the smallest gram hash."""
    grams = ", ".join(f"h[i + {j}]" for j in range(gram))
    windows = window - gram + 1
    return (
        f"CASE WHEN size(h) < {window} THEN cast(array() AS array<bigint>) ELSE "
        f"transform(array(transform(sequence(0, size(h) - {gram}), i -> xxhash64({grams}))), g -> "
        f"transform(sequence(1, size(g) - {windows - 1}), i -> array_min(slice(g, i, {windows}))))[0] END"
    )


def _windows(n: str) -> str:
    return f"transform(sequence(0, size(words) - {n}), i -> array_join(slice(words, i + 1, {n}), ' '))"


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): per document its text key and word count; per distinct text its hit words and items.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text.
    """
    marks = _fingerprints(window, gram)
    hashed = "transform(words, w -> xxhash64(w))"
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), words_of("text").alias("words"))
    rows = rows.selectExpr("doc_id", "key", "size(words) AS n_words", f"{hashed} AS h")
    rows = stored(rows.selectExpr("doc_id", "key", "n_words", f"array_distinct({marks}) AS marks"))
    items = stored(benchmark.select("item_id", words_of("text").alias("words")).filter("size(words) > 0"))

    long_items = items.filter(f"size(words) >= {window}")
    spans = long_items.selectExpr("item_id", f"explode({_windows(str(window))}) AS span").distinct()
    item_marks = long_items.selectExpr(f"{hashed} AS h").selectExpr(f"explode({marks}) AS mark").distinct()
    found = rows.selectExpr("key", "explode(marks) AS mark").join(item_marks, "mark")
    found = found.groupBy("key").agg(F.collect_set("mark").alias("found"))
    source = docs.select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key"), "text")
    near = source.join(found, "key").select("key", "found", words_of("text").alias("words"))
    near = near.selectExpr("key", "found", "words", f"{hashed} AS h").selectExpr("key", "found", "words", f"{marks} AS marks")
    shown = (
        f"filter(transform(marks, (m, i) -> CASE WHEN array_contains(found, m) THEN "
        f"named_struct('i', i, 'span', array_join(slice(words, i + 1, {window}), ' ')) END), x -> x IS NOT NULL)"
    )
    hits = near.selectExpr("key", f"inline({shown})").distinct()
    hits = hits.join(spans, "span").selectExpr("key", f"i AS begin", f"i + {window} AS stop", "item_id")

    # an item of fewer words is one window, looked for at every position
    short = items.filter(f"size(words) < {window}").selectExpr("item_id", "size(words) AS n", "array_join(words, ' ') AS span")
    for (n,) in short.select("n").distinct().orderBy("n").collect():  # at most window - 1 lengths
        every = source.select("key", words_of("text").alias("words")).filter(f"size(words) >= {n}")
        every = every.selectExpr("key", f"posexplode({_windows(str(n))}) AS (i, span)")
        every = every.join(short.filter(f"n = {n}").select("item_id", "span"), "span")
        hits = hits.unionByName(every.selectExpr("key", "i AS begin", f"i + {n} AS stop", "item_id").distinct())
    hits = stored(hits)
    spans_of = hits.select("key", "begin", "stop").distinct().groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "stop"))).alias("s"))
    covered = "aggregate(s, named_struct('n', 0L, 'upto', 0), (a, x) -> named_struct('n', a.n + greatest(x.stop - greatest(x.begin, a.upto), 0), 'upto', greatest(a.upto, x.stop)), a -> a.n)"
    spans_of = spans_of.selectExpr("key", f"{covered} AS n_hit", "s AS spans")
    names = hits.select("key", "item_id").distinct().groupBy("key").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ",").alias("items"))
    return rows.select("doc_id", "key", "n_words"), spans_of.join(names, "key")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of ``docs``.

    A null or empty text has no words and is clean; items without words match nothing, an empty benchmark
    leaves every document clean; repeated rows and items each count as rows. Other columns are not read.
    """
    rows, hits = contaminated_spans(docs, benchmark, window, gram)
    out = rows.join(hits.drop("spans"), "key", "left")
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, columns unchanged."""
    _, hits = contaminated_spans(docs, benchmark, window, gram)
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    bad = hits.select(F.col("key").alias("_hit_key"))
    return docs.join(bad, key == F.col("_hit_key"), "left_anti")
