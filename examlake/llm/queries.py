"""Registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, fingerprints, lexical, licences, near_dedup, oracle, packing, prefix_trie, quality_rules, rule_ensemble, sharding, tokens, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_paragraph_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fingerprints.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op2_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _judged(scores: DataFrame, threshold: float) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_quality_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _judged(rule_ensemble.with_score(docs, rule_ensemble.train(docs, labels)), 0.3)


def op7_toxicity_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return _judged(toxicity.with_score(docs, toxicity.train(docs, labels)), 0.5)


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = licences.licence_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return report.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    # References in a user's text become typed parts; what an assistant says stays one text, so its loss is that text alone.
    parts = F.when(F.col("role") == "assistant", chat.text_part(F.col("text"))).otherwise(chat.referenced_parts(F.col("text")))
    turns = given.unionByName(extra).select("conv_id", "turn", "role", parts.alias("parts"))
    read = chat.read_back(chat.format_turns(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "n_expanded",
        F.concat_ws(",", F.transform("attachments", lambda a: F.concat(a.type, F.lit(":"), a.ref))).alias("attachments"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in counts], "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


def word_bpe() -> str:
    """The public tokenizer file that the queries use."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe(), 2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe())


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 80, 4)


def op11_word_shuffle_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = byte_bpe.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie_nodes(prefix_trie.conversations(turns, shared_of=20))


def op13_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"), 20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_paragraph_sketches": op1_paragraph_sketches,
        "op2_byte_shards": op2_byte_shards,
        "op3_quality_ensemble": op3_quality_ensemble,
        "op4_licence_scan": op4_licence_scan,
        "op5_chat_format": op5_chat_format,
        "op6_quality_rules": op6_quality_rules,
        "op7_toxicity_kernel": op7_toxicity_kernel,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_bpe_round_trip": op9_bpe_round_trip,
        "op10_minhash_near_dedup": op10_minhash_near_dedup,
        "op11_word_shuffle_bpe": op11_word_shuffle_bpe,
        "op12_burst_trie": op12_burst_trie,
        "op13_pair_bound_search": op13_pair_bound_search,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
