"""Catalogue queries of the operators: whole tables, production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm import (
    chat, embeddings, fim, fingerprints, language, minhash, mixing, packing, quality, search, sharding,
    suffix, warc,
)
from tonewright.llm.sql import SQL  # noqa: F401 - registered with the queries
from tonewright.sources.tables import table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op1_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(packing.pack(documents(spark, sf_dir, "doc_id", "text"), TOKENIZER))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return done.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.cascade(documents(spark, sf_dir, "doc_id", "text"), report=COUNTS)
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language.fit_language_model(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), percent=85)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = warc.mark_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    files = warc.write_archives(pages, warc.archive_folder(spark))
    records = warc.read_archives(files)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: texts made of control strings."""
    text = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", text), (-1, 1, "assistant", text)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = chat.format_turns(rows.unionByName(control_conversation(spark)))
    examples = chat.expand_targets(turns)
    formatted = chat.format_conversations(turns)
    back, loss = chat.read_back(formatted), chat.read_loss(formatted, examples)
    said = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss_text = F.coalesce("loss", F.lit(""))
    return back.alias("b").join(
        loss.alias("l"), F.col("b.conv_id").eqNullSafe(F.col("l.conv_id")), "left"
    ).select(
        "b.conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss_text).cast("long").alias("loss_chars"), F.sha2(loss_text, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op9_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir, "doc_id", "text"), 40)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_schedule(documents(spark, sf_dir, "doc_id", "text", "source")).drop("k")


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op12_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return fingerprints.edit_trial(docs, fingerprints.rarity(docs))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.fill_in_middle(documents(spark, sf_dir, "doc_id", "text"))
    restored = fim.restore(F.col("output"), F.col("form"))
    return done.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f for f in (
        op1_curve_packing, op2_suffix_dedup, op3_vector_dedup, op4_quality_cascade, op5_language, op6_minhash,
        op7_warc, op8_chat, op9_jump_shards, op10_mixing,
        op11_reversed_search, op12_improbable_features, op13_fill_in_middle,
    )
}
