"""Removal of lines that many documents share, without Python on the executors.

Each long line is reduced to a 128-bit hash of its key. The hashes are range-partitioned by (hash,
block of documents) and sorted within each partition by document and position; one pass over that
order sees the first occurrence of a hash in every document. A block is a hash of the document id,
so a line that a third of the corpus repeats spreads over one range for each ``BLOCK_ROWS`` of its
occurrences, and its blocks are only counted together after each has been summed. What goes back to the documents is a bitmap of kept
lines per document, in 64-line words of which those that keep everything are left out.

Defined results: a null text is one empty line; a row whose ``doc_id`` is null keeps every line and
counts for none; rows that repeat a ``doc_id`` count as one document, and each row is cut by its own
lines; columns other than ``doc_id`` and ``text`` are ignored or, in ``drop_lines``, kept as they are,
whatever their names. Texts are read whole, however long; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import discard, staged

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Occurrences of one line that a range holds, about.
BLOCK_ROWS = 1_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, its ASCII capitals lowered."""
    bare = F.btrim(line, F.lit(WHITE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def fingerprint(text: Column) -> Column:
    """Tells rows apart that share a doc_id."""
    return F.hash(F.coalesce(text, F.lit("")))


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row (fingerprint), pos and the key's hash (h1, h2) of each line of at least min_chars."""
    exploded = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", fingerprint(F.col("text")).alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    )
    keyed = exploded.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key"))
    return keyed.where(F.char_length("key") >= min_chars).select(
        "doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")
    )


def with_blocks(lines: DataFrame, block_rows: int) -> DataFrame:
    """``lines`` with the number of blocks of their hash and the block that each is in."""
    counts = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    # One row for more than block_rows lines: at most a millionth of the lines, so that it can be broadcast.
    hot = counts.where(F.col("n") > block_rows).select("h1", "h2", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"))
    marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return marked.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, keep_doc and blocks of each line hash that at least min_docs documents hold."""
    ranged = lines.select("h1", "h2", "blocks", "block", "doc_id", "pos").repartitionByRange("h1", "h2", "block")
    order = Window.partitionBy("h1", "h2", "block").orderBy(F.col("doc_id").desc(), F.col("pos"))
    before = F.lag("doc_id").over(order)
    first = ranged.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("doc_id")))
    held = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep_doc"), F.max("blocks").alias("blocks"))
    return held.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keep_doc", "blocks")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, row, keep: for each document that loses lines, the words of its bitmap that lose any.

    ``keep`` is an array of (word, bits); bit b of word w is 1 if line 64 * w + b stays. Words that
    are not listed keep all their lines.
    """
    plain = staged(long_lines(docs, min_chars), "line-hashes")
    lines = staged(with_blocks(plain, block_rows), "line-blocks")
    discard(plain)
    shared = shared_lines(lines, min_docs).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    dropped = lines.join(shared, ["h1", "h2", "block"]).where(F.col("doc_id") != F.col("keep_doc"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos") % 64)
    words = dropped.groupBy("doc_id", "row", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bitwise_not(F.bit_or(bit)).alias("bits")
    )
    return words.groupBy("doc_id", "row").agg(F.collect_list(F.struct("word", "bits")).alias("keep"))


def kept_lines(lines: Column, keep: Column) -> Column:
    """The lines of an array that a bitmap keeps (all of them if it is null)."""
    sparse = F.map_from_entries(keep)
    dense = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 64).cast("int")),
        lambda w: F.coalesce(F.try_element_at(sparse, w), F.lit(-1).cast("bigint")),
    )

    def stays(_: Column, i: Column) -> Column:
        return F.getbit(F.element_at(dense, F.floor(i / 64).cast("int") + 1), i % 64) == 1

    return F.when(keep.isNull(), lines).otherwise(F.filter(lines, stays))


def with_kept_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, whose names cannot clash so), ``all_lines`` and ``kept`` (arrays of lines)."""
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("doc"), fingerprint(F.col("text")).alias("print"))
    here = (packed["doc"] == bitmaps["doc_id"]) & (packed["print"] == bitmaps["row"])
    # A bitmap is a small part of the text it belongs to, and so is a partition's of what it reads anyway.
    joined = packed.join(bitmaps.select("doc_id", "row", "keep").hint("shuffle_hash"), here, "left")
    split = joined.select(packed["row"], "keep", lines_of(packed["row"]["text"]).alias("all_lines"))
    return split.select("row", "all_lines", kept_lines(F.col("all_lines"), F.col("keep")).alias("kept"))


def drop_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with shared lines cut from ``text`` and ``n_chars`` set anew; a document left without text goes."""
    cut = with_kept_lines(docs, min_chars, min_docs)
    lost = F.size("kept") < F.size("all_lines")
    new = cut.select("row", lost.alias("lost"), F.when(lost, F.array_join("kept", "\n")).otherwise(F.col("row.text")).alias("text"))
    new = new.where(~F.col("lost") | (F.length(F.btrim(F.col("text"), F.lit(WHITE))) > 0))
    count = F.when(F.col("lost"), F.char_length("text").cast("bigint"))
    changed = {"text": F.col("text"), "n_chars": F.coalesce(count, F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return new.select(*(changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = with_kept_lines(docs)
    return cut.select(
        "row.doc_id",
        F.size("all_lines").cast("bigint").alias("n_lines"),
        (F.size("all_lines") - F.size("kept")).cast("bigint").alias("n_dropped"),
        F.sha2(F.array_join("kept", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keep_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keep_doc AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
