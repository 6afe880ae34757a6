"""Training-corpus pipeline over a table of documents.

``STAGES`` in order: quality filter, line dedup, near dedup, benchmark
decontamination, tokenisation. Each stage takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of ``docs``. ``run``
writes each stage's result as Parquet into the session's shared folder and
reads it back as the next one's documents.

Cases: nulls, empty texts, repeated rows and further columns pass as each
operator defines; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrix.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality_classifier
from calibrix.llm.scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and text beside the whole row, so no further column can clash."""
    return docs.select(F.col("doc_id"), F.col("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score >= 0.3). It learns
    from the labels of these documents, held-out rows aside; without labels of
    both classes every document stays."""
    labels = _table(spark, sf_dir, "labels")
    model = quality_classifier.learn(docs, labels)
    scored = quality_classifier.score(_rows(docs), model, keep=("row",))
    return scored.filter("predicted = 1").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents stay only where they occur first;
    a document that loses all its lines with a word goes. ``n_chars``
    follows the text; a text that loses nothing, null included, is unchanged."""
    own = line_dedup.keyed(docs, "doc_id", "text")
    bitmaps = line_dedup.keep_bitmaps(own, min_docs=10, keep_first=True)
    rows = _rows(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "row")
    out = line_dedup.apply_bitmaps(rows.withColumn("k", F.xxhash64("text")), bitmaps)
    blank = F.length(F.btrim("kept_text", F.lit(line_dedup.STRIP))) == 0
    out = out.filter((F.col("n_dropped") == 0) | ~blank)
    changed = F.col("n_dropped") > 0
    cols = []
    for c in docs.columns:
        old = F.col("row")[c]
        if c == "text":
            old = F.when(changed, F.col("kept_text")).otherwise(old)
        elif c == "n_chars":
            old = F.when(changed, F.length("kept_text")).otherwise(old).cast(docs.schema[c].dataType)
        cols.append(old.alias(c))
    return out.select(*cols)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles,
    similarity 0.8): the one with the smallest id."""
    found = near_dedup.near_dedup(docs).filter("not kept").select(
        F.col("doc_id").alias("_id"), F.col("k").alias("_k")).distinct()
    own = _rows(docs).withColumn("k", F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b"").cast("binary"))))
    gone = own.join(found, own["doc_id"].eqNullSafe(found["_id"]) & (own["k"] == found["_k"]), "left_anti")
    return gone.select("row.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    out = decontaminate.with_overlaps(_rows(docs).select("text", "row"), _table(spark, sf_dir, "benchmark"))
    return out.filter(F.size("found_items") == 0).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): token ids of each
    whole text (little-endian unsigned 32-bit) and the digest of what they
    decode to."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    out = byte_bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("near dedup", near),
    ("benchmark decontamination", benchmark),
    ("byte BPE", tokens),
]

# A fitted model cannot be written in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table goes once
    the next one's is written."""
    docs, tmp = _table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES:
        done = tmp.put(stage(spark, docs, sf_dir))
        tmp.drop(docs)
        docs = done
    return docs
