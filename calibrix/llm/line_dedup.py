"""Line dedup: range-partitioned line hashes, compressed keep bitmaps.

DataFrame functions only. Each line's key (stripped, A-Z lower-cased) becomes
two 64-bit hashes; the hash rows are range-partitioned by (hash, document,
position) and sorted so inside the partitions, which spreads even a line of
every document over many tasks, and written once. Each hash's first occurrence
and number of documents are grouped sums over them (tasks combine before the
exchange); they do not rely on the order. What comes back for a document is its run-length
compressed keep bitmap, not text: runs of (lines kept, lines dropped).

Cases: a null or empty text is one empty line; an empty key is never dropped;
rows of the same id and text are one document (each gets the result), an id
with another text is another; ids may be null; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrix.session import materialize

# [\x20\x09-\x0D], stripped at both ends of a line.
STRIP = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Stripped, with A-Z lower-cased (other letters unchanged)."""
    x = F.btrim(line, F.lit(STRIP))
    ascii_only = F.length(x) == F.octet_length(x)
    return F.when(ascii_only, F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, k): k tells rows of the same id but another text apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
                       ).withColumn("k", F.xxhash64("text"))


def hash_rows(docs: DataFrame, min_key: int = 1) -> DataFrame:
    """(h1, h2, doc_id, k, pos) of each line whose key has ``min_key`` code
    points, range-partitioned and sorted by all of them."""
    rows = docs.select("doc_id", "k", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    rows = rows.select("doc_id", "k", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_key)
    rows = rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"),
                       "doc_id", "k", "pos")
    order = ["h1", "h2", "doc_id", "k", "pos"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def occurrences(rows: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, first): documents that hold each line and its first
    occurrence. Both steps combine in the tasks before they exchange, so a line
    of every document is never gathered as one group."""
    per_doc = rows.groupBy("h1", "h2", "doc_id", "k").agg(F.min("pos").alias("pos"))
    return per_doc.groupBy("h1", "h2").agg(
        F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "k", "pos")).alias("first"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_key: int = 1) -> DataFrame:
    """(doc_id, k, bitmap, n_dropped) of the documents that lose a line.

    Lines found in at least ``min_docs`` documents are dropped everywhere, or
    all but the first occurrence with ``keep_first``. ``docs`` is ``keyed``.
    The join of the hash rows with the frequent hashes has one row a hash on
    one side, so a hot hash is split as a skewed key. It merges at every size:
    Spark sizes the rows by their documents, however many lines these have."""
    rows = materialize(hash_rows(docs, min_key))
    frequent = occurrences(rows).filter(F.col("n_docs") >= min_docs)
    dropped = rows.join(frequent.drop("n_docs").hint("merge"), ["h1", "h2"])
    if keep_first:
        dropped = dropped.filter(F.struct("doc_id", "k", "pos") != F.col("first"))
    return compress(dropped.select("doc_id", "k", "pos"))


def compress(dropped: DataFrame) -> DataFrame:
    """Run-length bitmaps from dropped positions: each run is so many lines
    kept, then so many dropped; the lines after the last run are kept."""
    by_doc = Window.partitionBy("doc_id", "k")
    runs = (dropped.withColumn("island", F.col("pos") - F.dense_rank().over(by_doc.orderBy("pos")))
            .groupBy("doc_id", "k", "island").agg(F.min("pos").alias("start"), F.max("pos").alias("last")))
    runs = runs.withColumn("before", F.lag("last", 1, -1).over(by_doc.orderBy("start")))
    run = F.struct("start", (F.col("start") - F.col("before") - 1).alias("keep"),
                   (F.col("last") - F.col("start") + 1).alias("drop"))
    return runs.groupBy("doc_id", "k").agg(
        F.sort_array(F.collect_list(run)).alias("bitmap"),
        F.sum(F.col("last") - F.col("start") + 1).cast("long").alias("n_dropped"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` (``keyed``, any further columns) with the kept lines as
    ``kept_text``, and n_lines and n_dropped."""
    b = bitmaps.select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), F.col("bitmap").alias("_bitmap"),
                       F.col("n_dropped").alias("_dropped"))
    joined = docs.join(b, docs["doc_id"].eqNullSafe(b["_id"]) & (docs["k"] == b["_k"]), "left")
    bits = F.flatten(F.transform("_bitmap", lambda r: F.concat(
        F.array_repeat(F.lit(True), r["keep"]), F.array_repeat(F.lit(False), r["drop"]))))
    # zip_with pads the kept tail with null bits; array_join skips null lines.
    kept = F.array_join(F.zip_with(lines_of(F.col("text")), bits, lambda line, bit: F.when(
        F.coalesce(bit, F.lit(True)), line)), "\n")
    return joined.select(*docs.columns, F.when(F.col("_bitmap").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
                         F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
                         F.coalesce("_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
               keep_first: bool = False) -> DataFrame:
    """(doc_id, text, k, kept_text, n_lines, n_dropped) per input row."""
    own = keyed(docs, id_col, text_col)
    return apply_bitmaps(own, keep_bitmaps(own, min_docs, keep_first))
