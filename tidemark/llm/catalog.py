"""Registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, collocations, jaccard, langid, licenses, media, neighbours, oracle, packing, quality, repeats, sharding, suffix_lm, variants
from tidemark.llm.common import crc_mod, prepared, staged, utf8

SHARDS = 40
QUERIES_EVERY = 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def shipped(fn):
    """The workers need this package's sources."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepared(spark), sf_dir)
    return run


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entire texts and lines of all documents against the built-in licences and notices."""
    return licenses.scan(documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    ids = bpe.encode_texts(documents(spark, sf_dir).select("doc_id", "text"), ranks).drop("text")
    return bpe.decode_ids(ids, ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(crc_mod("doc_id", 4) != 2))
    rows = docs.select("doc_id", "text", langid.held_out("doc_id").alias("held_out"))
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    judged = quality.judge(docs, store=lambda rows: staged(rows.drop("text"), "measured"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         F.round("quality", 4).alias("quality"), "kept")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = utf8("text")
    rows = documents(spark, sf_dir).select("doc_id", "source", (F.octet_length(data) + 16).cast("long").alias("size"),
                                           F.crc32(data).alias("text_crc32"))
    return sharding.interleave(rows, SHARDS).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                                                    F.lit(None).cast("int").alias("grown_shard"))


def op7_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that also start elsewhere."""
    found = repeats.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    size, kept = F.octet_length("text").cast("long"), F.octet_length("kept").cast("long")
    return found.select("doc_id", size.alias("n_bytes"), (size - kept).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score(documents(spark, sf_dir), crc_mod("doc_id", 5) == 1)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of near copies: five-word n-grams, similarity of 0.8 or more."""
    return jaccard.near_classes(documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length(utf8("text")).cast("long").alias("n_bytes"), media.payload_of("text").alias("payload"))
    found = media.media_columns(media.store(docs).drop("payload"))
    read = found.withColumn("read", media.sample_bytes("media", "facts"))
    ranges = F.transform("facts.keyframes", lambda k: F.concat_ws("+", k["offset"].cast("string"), k["length"].cast("string")))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("read").cast("long").alias("payload_bytes"), F.sha2("read", 256).alias("payload_sha256"),
        F.crc32(F.substring("read", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.lit("codec="), "facts.codec"), F.concat(F.lit("timescale="), "facts.timescale"),
                    F.concat(F.lit("duration="), "facts.duration"), F.concat(F.lit("samples="), "facts.n_samples"),
                    F.concat(F.lit("keyframes="), F.array_join(ranges, ","))).alias("feature"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their near words, and the frequent word that each leads to."""
    return variants.group_variants(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language by the score of their weakest cut."""
    return collocations.mine(documents(spark, sf_dir))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, F.pmod("id", F.lit(QUERIES_EVERY)) == 0)


OPERATORS = [op1_license_scan, op2_best_fit_packing, op3_byte_bpe, op4_language_id, op5_quality_rules, op6_sharding, op7_suffix_repeats,
             op8_suffix_tree_lm, op9_ngram_jaccard, op10_media_columns, op11_spelling_variants, op12_collocations, op13_nearest_vectors]
QUERIES = {fn.__name__: shipped(fn) for fn in OPERATORS} | {"pipeline": shipped(corpus_pipeline.run)}
SQL = {"op1_license_scan": oracle.license_scan(),
       "op5_quality_rules": oracle.quality_rules(), "op6_sharding": oracle.sharding(SHARDS),
       "op7_suffix_repeats": oracle.repeats(repeats.LENGTH), "op9_ngram_jaccard": oracle.near_classes(jaccard.WORDS, jaccard.THRESHOLD),
       "op11_spelling_variants": oracle.spelling_variants(variants.SLIP, variants.MIN_LENGTH, variants.MIN_COUNT),
       "op12_collocations": oracle.collocations(collocations.LONGEST, collocations.MIN_COUNT, collocations.TOP, collocations.COVERED),
       "op13_nearest_vectors": oracle.nearest_vectors(neighbours.K, QUERIES_EVERY)}
