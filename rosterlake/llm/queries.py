"""The queries of this subpackage: each applies one operator to its whole table. SQL for them is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, common, decontaminate, html_text, licenses, line_dedup, mixing, ngram_join, resample, token_ids, topk, toxicity, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch_path(spark, "token-files")
    token_ids.write_token_files(common.table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_ids.read_token_files(spark, path)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    chats = common.written(chat.format_chats(turns.unionByName(extra)), "chats")
    back = chat.read_chats(chats)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    path = common.scratch_path(spark, "archives")
    odd = F.coalesce(F.col("page_id") % 2 != 0, F.lit(False))
    warc.write_arc(pages.where(~odd), f"{path}/arc1", 1)
    warc.write_arc(pages.where(odd), f"{path}/arc2", 2)
    warc.convert_arc(spark, f"{path}/warc", f"{path}/arc1", f"{path}/arc2")
    got = warc.read_warc(spark, f"{path}/warc")
    return got.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(common.table(spark, sf_dir, "pages"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(common.table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the model rejects. toxicity.score gives the severity of all documents."""
    return toxicity.rejected(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(common.table(spark, sf_dir, "documents")).drop("n_blocks")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(common.table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches are inserted, so that the second one meets the filters of the first."""
    docs = common.table(spark, sf_dir, "documents")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    index = line_dedup.empty(spark, line_dedup.shards_for(docs.count()), dict(docs.dtypes)["doc_id"])
    for k in range(2):
        index = line_dedup.insert(index, docs.where(half == k))
    return line_dedup.clean(docs, index).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(centroids.whole_vectors(common.table(spark, sf_dir, "embeddings")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_ids, op2_chat_formatting, op3_warc, op4_decontamination, op5_html_extraction, op6_top_k, op7_toxicity, op8_license_scan, op9_ngram_jaccard, op10_mixing, op11_line_dedup, op12_importance_resampling, op13_centroids)
    return {f.__name__: f for f in found}
