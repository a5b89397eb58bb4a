"""One registered query per training-data operator: production parameters, whole tables, the agreed result columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import alignment, chat, language, lines, minhash, packing, pages, postings, quality, resample, shards, topk, toxicity
from cuelake.llm.common import Work, read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(Work(spark, "packing"), read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = minhash.near_duplicates(Work(spark, "minhash"), read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def held_out(remainder: int, divisor: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs.where(~held_out(1, 3)), read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    out = toxicity.score(docs.withColumn("held_out", held_out(1, 3)), machine)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    out = postings.contamination(Work(spark, "postings"), docs.select("doc_id", "text"), items)
    n_items, digest = F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, its numbers of lines and of lines that went, and the text that stays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(Work(spark, "lines"), docs)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = language.train(docs.where(~held_out(2, 4)))
    out = language.predict(docs.select("doc_id", "text", held_out(2, 4).alias("held_out")), net)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{probe}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    out = chat.render(chat.final_messages(chat.log_of_turns(turns.unionByName(extra))))
    out = out.select("conv", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("said"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "quality")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    seen = work.cut(quality.counts(docs, "text").drop("text"))  # each text is read once
    cutoffs = work.cut(quality.calibrate(seen, read(spark, sf_dir, "labels")))
    judged = quality.judge(seen, cutoffs)
    q = [F.col(f"q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *q, "base_failed", "kept")


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(read(spark, sf_dir, "embeddings"))
    return topk.top_k(Work(spark, "topk"), vectors, vectors.where("vec_id % 100 = 0"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(Work(spark, "alignment"), docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return resample.resample(Work(spark, "resample"), docs, items).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_line_dedup": op5_line_dedup,
    "op6_sharding": op6_sharding,
    "op7_language": op7_language,
    "op8_chat_format": op8_chat_format,
    "op9_html_text": op9_html_text,
    "op10_quality_rules": op10_quality_rules,
    "op11_topk": op11_topk,
    "op12_alignment": op12_alignment,
    "op13_resampling": op13_resampling,
}
