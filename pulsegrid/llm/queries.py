"""One thin query for each operator: production parameters, whole tables, digest columns of real outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, language_model, licenses, media, merkle, mixing, passages, personal, quality, repetitions, simhash, token_files, urls
from .common import only, table

#: The places of public vocabularies; a parameter of every operator that reads one.
RANKS_50K = "byte_bpe_50k.tiktoken"
TOKENIZER_50K = "byte_bpe_50k.json"

URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    path = vocabulary(RANKS_50K)
    return bpe.digests(bpe.encode(docs, path, offsets=False, decoded=True))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.store(table(spark, sf_dir, "documents"), vocabulary(TOKENIZER_50K), end=2)
    found = token_files.read_tokens(spark, folder)
    return found.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = only(table(spark, sf_dir, "pages"), "page_id", "url")
    return urls.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")


def op7_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = media.stored(media.encode_media(only(table(spark, sf_dir, "documents"), "doc_id", "text")))
    size, payload = F.length("payload"), F.col("payload")
    digests = media.decode_media(files, packed=True).select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "format",
        "pcm",
    )
    return media.with_features(media.stored(digests, "pcm"), packed=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = quality.quality_rules(docs, table(spark, sf_dir, "labels"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base, own = F.col("places"), F.col("matches")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base.word).alias("first_word"),
        F.array_max(base.word).alias("last_word"),
        joined(base.label).alias("base_labels"),
        joined(F.concat(base.label, own.label)).alias("labels"),
        F.coalesce(F.array_max(own.containment), F.lit(0.0)).alias("score"),
    )


def op6_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    shares = [F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(mixing.DOMAINS)]
    return mixed.select("doc_id", "n_tokens", *shares, "rate", "copies")


def op10_perplexity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered=merkle.third_of_ids())
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(personal.of_kinds("spans", (k,))).cast("long").alias(f"n_{k}") for k in personal.BASE]
    base = personal.listed(personal.of_kinds("spans", personal.BASE))
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), personal.listed(F.col("spans")).alias("spans"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetitions.collapse_runs(table(spark, sf_dir, "documents"), rewrite=True, texts=False)
    best = [F.col("best")[c].alias(c) for c in ("start", "length", "period")]
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, exponent, "runs_sha256", "collapsed_sha256")
