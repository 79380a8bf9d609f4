"""The corpus pipeline: language ID, line dedup, near-duplicate documents, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents; the
last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cellstream.llm import langid, linededup, ngramjoin, packing, secrets
from cellstream.llm.common import checkpointed, fold, quoted, unused

#: Texts whose best language has a lower calibrated probability go, as do those without a letter.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` without the rows of no sure language.

    Those of a null or empty text, or one without a letter, go; null keys and repeated rows stay or go by their texts, very
    long texts are scored whole, and an empty table stays empty. Columns of any name are kept.
    """
    model = langid.train(docs.where(fold("doc_id", 3) != 1))
    told, sure = unused(docs.columns, "lang_pred", "score")
    found = langid.identify(docs, model, tuple(docs.columns), (told, sure))
    return found.where((quoted(told) != langid.UNKNOWN) & (quoted(sure) >= LEAST_SCORE)).drop(told, sure)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` with the lines that a smaller doc_id has too cut out of `text`.

    Null and empty texts, null keys (whose lines all stay), repeated rows and all columns stay; no row goes.
    """
    return linededup.apply(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more.

    The smallest doc_id stays. Null and empty texts link with nothing and stay, as do null keys; repeated rows of one
    doc_id and text count once, and different texts of one doc_id stay or go together. All columns are kept.
    """
    return ngramjoin.keep_one(docs, size=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` with secrets masked in `text`; null and empty texts, null keys, repeated rows and all columns stay."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents; a null or empty text is its end token, an empty table gives no piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("best-fit packing", pack),
]

#: Stages of a trained model and of tokenizers have no SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
