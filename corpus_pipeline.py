"""The corpus pipeline: from raw documents to token ids.

Each stage takes all that the one before kept and returns the columns of ``documents``; the last
returns the encoded mix.  ``run`` writes what a stage returns and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm import bpe, language, minhash, mixing, substring_dedup
from pagewright.runtime import cut_to_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose words are labelled less surely than this in the mean is rejected, as is one without a letter.
#: Code-switched text stays: its words are clear, though no language has most of them.
LEAST_SURE = 0.5
#: Bytes of the strings whose repeats are removed: shorter than any passage of more than 50 words.
REPEAT = 200
VOCABULARY = "byte_bpe_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; ``lang`` becomes the language found."""
    found = language.identify(docs.select(*COLUMNS), language.train(docs))
    clear = found.where((F.col("lang_pred") != "und") & (F.col("sure") >= LEAST_SURE))
    return clear.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, likeness 0.8)."""
    return minhash.drop_near_duplicates(docs.select(*COLUMNS))


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat within or across documents; every document stays.

    A character whose bytes are removed in part is removed.  ``n_chars`` is counted again.
    """
    cut = substring_dedup.remove_repeats(docs.select(*COLUMNS), REPEAT, as_text=True)
    return cut.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at the target weights; a document is repeated as often as the mix takes it."""
    mixed = mixing.mix(docs.select(*COLUMNS), mixing.WEIGHTS, keep=[c for c in COLUMNS if c != "source"], extra_source=True)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with digests of the ids and of the decoded text."""
    import public_tokenizers

    return bpe.encode_texts(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"])


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("repeat_removal", repeat_removal), ("source_mix", source_mix), ("encode", encode)]
#: Trained models, byte spans and token ids are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        # else each action of a later stage would run the earlier ones again
        docs = cut_to_table(docs) if k < len(STAGES) else docs
    return docs


QUERY = {"pipeline": run}
