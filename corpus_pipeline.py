"""From raw documents to encoded training data, in stages that the caller writes between.

Every stage but the last returns the columns of its documents, whatever their names. Null texts
count as empty, rows that repeat an id are rows like others unless a stage says otherwise, and
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdigest.llm import exact_dedup, langid, mixing, pieces, simhash
from loomdigest.llm.common import remainder, remove, table
from loomdigest.llm.queries import public, vocabulary_pieces
from loomdigest.llm.token_file import fresh_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language stay; those without letters or text go, of repeated rows each by itself."""
    model = langid.train(docs, vocabulary_pieces(public("piece_bpe_32k.model")), remainder(F.col("doc_id"), 5) != 0)
    return docs.where(langid.predictor(spark, model)(F.col("text"))["lang_pred"] != langid.UNDETERMINED)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, null ids last; of rows that repeat it, one."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a component of near copies the smallest doc_id stays; rows of one id stay or go together, those without id stay."""
    return simhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in training order, repeats as rows of their own."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece counts and digests of each row: doc_id (null and repeated ones too), n_tokens, ids_sha256, decoded_sha256."""
    return pieces.digests(docs, public("piece_bpe_32k.model"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Fingerprints, piece models and merges are no SQL; tests/llm/test_edges.py compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over what the others wrote; a stage's folder goes once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{fresh_path(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
