"""A training corpus from raw documents: language, quality, near copies, repeated passages, packed sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, langid, packing, quality, repeats
from tidemark.llm.common import crc_mod, prepared, staged

#: Least posterior probability of the predicted language.
LANGUAGE_SCORE = 0.5


def apart(docs: DataFrame, *named: str) -> DataFrame:
    """The named columns, and all others as one, so that none clashes with a column that an operator adds."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in named]
    return docs.select(*named, F.struct(*rest).alias("_row") if rest else F.lit(None).alias("_row"))


def together(rows: DataFrame, columns: list[str], *named: str, **changed: Column) -> DataFrame:
    """The columns of the documents again, in their order."""
    value = lambda c: changed.get(c, F.col(c) if c in named else F.col(f"_row.`{c}`"))
    return rows.select(*[value(c).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter, with a doubtful prediction, or whose n-grams are less
    probable than those of labelled rows of the predicted language that were not learned from, go.

    NULL and empty texts go.  Repeated rows are judged alike and all stay or go.  Where no label is known, no document is
    identified.  Other columns have any names.  An empty table gives no rows.
    """
    prepared(spark)
    labelled = docs.select("doc_id", "text", "lang")
    model = langid.train(labelled.where(crc_mod("doc_id", 4) != 2))
    bounds = langid.calibrate(labelled.where(crc_mod("doc_id", 4) == 2), model)
    found = langid.predict(apart(docs, "text"), model, prediction="_language", score="_language_score", fit="_language_fit")
    sure = (F.col("_language") != langid.UNKNOWN) & (F.col("_language_score") >= LANGUAGE_SCORE)
    return together(found.where(sure & langid.fits(bounds, "_language", "_language_fit")), docs.columns, "text")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voting rules find good.

    NULL and empty texts fail the base rule and go; repeated rows are judged alike.  Other columns have any names.  An empty
    table gives no rows.
    """
    prepared(spark)
    named = docs.select([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("text")])
    return quality.judge(named, store=lambda rows: staged(rows.drop("text"), "measured")).where("kept").select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies.

    NULL, empty and blank texts are no copies and stay; of repeated rows one stays.  Other columns have any names.  An empty
    table gives no rows.
    """
    prepared(spark)
    kept = jaccard.first_of_class(apart(docs, "doc_id", "text"), jaccard.near_classes(docs.select("doc_id", "text")))
    return together(kept, docs.columns, "doc_id", "text")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; those of which nothing but blanks is left go.

    NULL and empty texts go.  Repeated rows repeat their whole text and go, unless it is shorter than a passage.  n_chars
    follows the text; other columns have any names.  An empty table gives no rows.
    """
    prepared(spark)
    cut = repeats.remove_repeats(apart(docs, "doc_id", "text"), characters=True)
    text = F.when(F.size("removed") == 0, F.decode("text", "UTF-8")).otherwise(F.decode("kept", "UTF-8"))
    kept = cut.withColumn("text", text).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return together(kept, docs.columns, "doc_id", "text", **changed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their sequences and offsets.

    NULL and empty texts are pieces of their end alone; repeated rows have places of their own.  Only doc_id and text are
    read.  An empty table gives no rows.
    """
    import public_tokenizers  # where it is missing, only this stage is

    prepared(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]

#: Trained models and n-gram joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
