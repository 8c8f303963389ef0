"""The registered queries of the subpackage: name -> query, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcesift.llm import decontamination, embedding_dedup, merkle, mixing, ngram_jaccard, periodic_runs, sharding, substring_dedup, suffix_dedup, token_counts, token_planes, toxicity, warc
from sourcesift.llm.storage import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_words(read(spark, sf_dir, "documents"), window=35).drop("kept_text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), shards=40)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    chain = toxicity.fit_chain(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, chain)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(read(spark, sf_dir, "pages")).drop("payload")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.near_duplicate_groups(read(spark, sf_dir, "documents"), k=4, percent=85)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(read(spark, sf_dir, "documents"), window=200).drop("kept")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(read(spark, sf_dir, "documents"), copies=4, least=6, rewrite=periodic_runs.repeated_tail)
    best = periodic_runs.greatest_exponent(F.col("runs"))
    found = found.select("doc_id", "runs", "collapsed_text", best.alias("best"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = read(spark, sf_dir, "documents").select(*columns)
    # a row that is tampered with keeps its digest and gets that of its changed text
    changed = merkle.leaf_digest([*(F.col(c) for c in columns[:4]), F.replace("text", F.lit("\n"), F.lit(""))])
    tampered = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n")), changed)
    manifest = merkle.build_manifest(docs, columns, "source", "doc_id", {"doc_id": F.col("doc_id"), "tampered": tampered})
    found = merkle.proofs(manifest).withColumn("root", F.lit(manifest.root))
    folded = found.withColumn("folded_root", merkle.climbed(F.coalesce("row.tampered", "leaf"), F.col("proof")))
    return folded.select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.encode_documents(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False, end_id=1)


for _query in (op1_embedding_dedup, op2_substring_dedup, op3_token_counts, op4_mixing, op5_sharding, op6_decontamination, op7_toxicity, op8_warc, op9_ngram_jaccard, op10_suffix_dedup, op11_periodic_runs, op12_merkle, op13_token_planes):
    QUERIES[_query.__name__] = _query
