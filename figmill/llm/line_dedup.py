"""Line dedup: hashes of lines, partitioned by range and sorted by document and position, say which lines stay.

All of it is DataFrame functions.  A line's key is the line without white space at its ends, A-Z in
lower case; two hashes of 64 bits stand for it.  The hashes are dealt by range of (hash, document), so
a line that a third of all documents hold is spread over as many tasks as it fills, and sorted there
with the largest document first.  The sorted stream gives one row for each hash and document, then
one for each hash: how many documents hold it and which is the last.  These go back to the hashes'
rows (Spark splits the partition of a frequent hash by the tasks that wrote it), and what a document
loses becomes a bitmap of its lines, kept as runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import checkpointed

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITMAP = ["doc_id", "text_hash", "n_lines", "n_dropped", "keep"]


def lines(text: Column) -> Column:
    """The lines of a text, split at \\n: one at least."""
    return F.split(text, "\n", -1)


def lower(text: Column) -> Column:
    """A-Z in lower case; letters beyond ASCII stay as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _by_range(items: DataFrame) -> DataFrame:
    """The items dealt by range and sorted.

    They are written before, as Spark looks for the ranges' bounds in a pass of its own, which then needn't split all texts
    again; and after, in a plan that isn't adaptive, so that later steps know how they lie.
    """
    items = checkpointed(items)
    conf, key = items.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    try:
        conf.set(key, "false")
        return checkpointed(items.repartitionByRange("h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "text_hash", "pos"))
    finally:
        conf.set(key, before)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, n_lines, n_dropped, keep) of the documents that lose lines.

    keep is the bitmap of kept lines as runs: an array of (start, length), lines counted from 0; it is empty
    if no line stays.  A line goes if its key has at least min_chars code points, at least min_docs documents
    hold it and this one isn't the largest doc_id of them.  A null text has one empty line.  Rows of one doc_id
    are one document for these counts, and each gets the bitmap of its own text; text_hash tells them apart.
    Rows with a null doc_id aren't counted and lose nothing.
    """
    line = F.btrim(F.col("line"), F.lit(SPACE))
    split = _rows(docs, id_col, text_col).filter("doc_id IS NOT NULL").withColumn("lines", lines(F.col("text")))
    items = split.select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line")).withColumn("line", line).filter(F.char_length("line") >= min_chars).withColumn("line", lower(F.col("line")))
    items = _by_range(items.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), "doc_id", "text_hash", "pos", "n_lines"))
    held = items.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last")).filter(F.col("n_docs") >= min_docs)
    # written once, so that both sides of the join are dealt by Spark, which then splits a frequent hash
    dropped = items.join(checkpointed(held.select("h1", "h2", "last")), ["h1", "h2"]).filter("doc_id < last")
    found = dropped.groupBy("doc_id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("gone"))
    return found.withColumns({"n_dropped": F.size("gone"), "keep": _runs(F.col("gone"), F.col("n_lines"))}).select(BITMAP)


def _runs(gone: Column, n: Column) -> Column:
    """The runs of numbers below n between the sorted numbers of `gone`."""

    def run(k: Column) -> Column:
        start = F.when(k == 0, 0).otherwise(F.get(gone, k - 1) + 1)
        return F.struct(start.alias("start"), (F.coalesce(F.get(gone, k), n) - start).alias("length"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(gone)), run), lambda r: r["length"] > 0)


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row: the lines that stay, joined by \\n.

    The bitmaps go to the texts by document; only they are held in a task, and texts aren't sorted.
    """
    maps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs).withColumnRenamed("n_lines", "n").hint("shuffle_hash")
    rows = _rows(docs, id_col, text_col).join(maps, ["doc_id", "text_hash"], "left")
    all_lines = lines(F.col("text"))
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice(all_lines, r["start"] + 1, r["length"]))), "\n")
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rows.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept).alias("kept"))


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""
    return drop_lines(docs, **options).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
