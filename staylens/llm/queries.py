"""The registered queries of the text operators and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from staylens.llm import (
    decontam, divergence, fingerprints, langid, license_scan, ngram_join, packing, pii, quality, resample, substring_dedup,
    suffix_dedup, token_output,
)
from staylens.llm.common import Stored, documents

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_packing")
def op1(spark, sf_dir):
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


@query("op10_token_output")
def op10(spark, sf_dir):
    store = Stored(spark, "op10")
    token_output.write_tokens(documents(spark, sf_dir), store.path("files"), tokenizer_file("word_bpe_49k.json"), store)
    return token_output.read_tokens(spark, store.path("files")).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_fingerprints")
def op6(spark, sf_dir):
    found = fingerprints.fingerprint_documents(documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
                        "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op4_language_id")
def op4(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score",
                                              "languages")


@query("op5_personal_data")
def op5(spark, sf_dir):
    return pii.find(documents(spark, sf_dir)).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans")


@query("op3_quality_classifier")
def op3(spark, sf_dir):
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), Stored(spark, "op3"))


@query("op8_ngram_jaccard_join")
def op8(spark, sf_dir):
    return ngram_join.jaccard_classes(documents(spark, sf_dir), Stored(spark, "op8"))


@query("op9_substring_dedup")
def op9(spark, sf_dir):
    kept = substring_dedup.remove_repeats(documents(spark, sf_dir), Stored(spark, "op9"))
    return kept.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op7_decontamination")
def op7(spark, sf_dir):
    return decontam.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    kept = suffix_dedup.remove_repeats(documents(spark, sf_dir), Stored(spark, "op2"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_source_divergence", divergence.SQL)
def op11(spark, sf_dir):
    return divergence.audit(documents(spark, sf_dir), Stored(spark, "op11"))


@query("op13_target_resampling", resample.SQL)
def op13(spark, sf_dir):
    found = resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), Stored(spark, "op13"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_license_scan")
def op12(spark, sf_dir):
    return license_scan.labelled(license_scan.scan(documents(spark, sf_dir)))
