"""From raw documents to token ids: five stages over a whole corpus.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and is written as Parquet before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridia.llm import minhash, mixing, quality, sentencepiece_tok, toxicity
from veridia.llm.common import mark, release, store
from veridia.llm.queries import TOKENIZERS, table

#: per cent of shared five-word shingles from which documents are near copies (op4's own contract is 85)
NEAR_COPY = 80


def apart(docs: DataFrame, *used: str):
    """``docs`` with all columns but the ``used`` ones renamed, so that a stage may add any, and the selection that restores its columns."""
    names = {c: c if c in used else f"own_{i}_of_document" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed({c: n for c, n in names.items() if c != n}), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows, columns = apart(docs, "text")
    return toxicity.score(rows, model).where("predicted = 0").select(*columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's threshold."""
    rows, columns = apart(docs, "doc_id", "lang", "text")
    return quality.classify(rows, table(spark, sf_dir, "labels")).where("kept").select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies.

    Rows of equal id and text become one. An id with several texts is one
    document of all their links; rows with a null id link with nothing and stay.
    """
    found = store(minhash.near_duplicates(docs, threshold=NEAR_COPY), "pipe-dups")
    few = lambda ids: F.broadcast(ids) if ids.count() <= minhash.BROADCAST_IDS else ids
    kept = docs.join(few(found.where("not kept").select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    repeated = few(repeated)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(kept.join(repeated, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return sentencepiece_tok.encode_documents(docs, f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: the stages hold trained models and a knapsack program; tests compare with brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; only the last one's output stays in the shared folder."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), "pipe-" + name.split()[0].lower())
        release(spark, since, docs)
    return docs
