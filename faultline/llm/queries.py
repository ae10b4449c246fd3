"""The thirteen operators' queries over whole tables, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import ann, divergence, embedding_dedup, hard_negatives, jaccard_join, mixing, packing, quality, suffix_dedup, topk, toxicity, url_filter, warc
from faultline.llm.shared import fold_of, stored


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents``: null and empty texts are scored like any, null ids fall in no fold, repeated rows are scored each, long texts whole; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(fold_of(F.col("doc_id"), 5) > 0)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents``; nulls, empty and long texts, repeated ids, empty tables as in ``jaccard_join.groups``."""
    return jaccard_join.groups(table(spark, sf_dir, "documents", "doc_id", "text"), jaccard_join.Jaccard(words=4, num=85, den=100))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``; invalid vectors, other lengths, repeated ids and empty tables as in ``topk.search``."""
    return topk.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), every=100, k=10)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents``: null and empty texts have size 0 and are never taken, a null source is the last one, equal rows are placed one after another; an empty table gives no rows."""
    mixed = mixing.copies(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``pages``: a null page is an empty payload, equal payloads are revisits whatever their urls; an empty table gives no rows."""
    archives = stored(warc.write(warc.plan(table(spark, sf_dir, "pages", "page_id", "url", "html"), least=0)), "archives")
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents``: null and empty texts are scored like any, null ids fall in no fold, repeated rows are scored each, long texts whole; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(fold_of(F.col("doc_id"), 3) != 1)
    model, stats = quality.train(docs, labels)
    return quality.score(stats, model).select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``pages``: a null url or one without a scheme has an empty host and path, repeated rows are judged each; an empty table gives no rows."""
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents``: null and empty texts are their end token alone, repeated rows are packed each, long texts are cut over sequences; an empty table gives no rows."""
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text", "source"), tokenizer_path())


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``; invalid vectors, other lengths, repeated ids and empty tables as in ``ann.search``."""
    return ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), every=20, k=20)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents``; null, empty and long texts, repeated ids and empty tables as in ``suffix_dedup.dedup``."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"), length=100)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents``; nulls, empty and long texts, repeated rows and empty tables as in ``divergence.audit``."""
    return divergence.audit(table(spark, sf_dir, "documents", "lang", "source", "text"), least=30, top=50)


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``; nulls, repeated ids and empty tables as in ``embedding_dedup.groups``."""
    return embedding_dedup.groups(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), least=0.98)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``embeddings``, every seventh relabelled; nulls, repeated ids and empty tables as in ``hard_negatives.mine``."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), every=100, k_positive=5, k_negative=10, low=30, high=90, scale=256.0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_jaccard_join, op3_topk, op4_mixing, op5_warc, op6_quality, op7_url_filter, op8_packing, op9_ann, op10_suffix_dedup, op11_divergence, op12_embedding_dedup, op13_hard_negatives)}
