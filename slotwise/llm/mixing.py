"""Mixing sources to target shares by pivotal rounding.

Every document starts with the same number of copies, its source's target divided by the source's
size. The whole part is taken for certain. The fractions are made whole in pairs: of two parties
with fractional copies, words move at random from one to the other, so that neither's expectation nor
the pair's total of words changes, until one of them has no fraction left. A large document cannot be
made whole by a small one, and would be left over. So the at most ``PIECES`` documents of a source that
hold more than 1 / ``PIECES`` of its words come first, the largest in front; each is paired with all the
smaller documents together, which share what it gives or takes. The rest is paired two by two, in groups
of a few thousand documents of one source; each group leaves one document with a fraction, these are
grouped again, and so on up a tree until a source has one, which is drawn. So each source comes within
1 / ``PIECES`` of its size, or within its smallest documents if it has few; only where one document
outweighs what the others can give or take, the nearer of its two choices stands.

Draws come from hashes of the document and the level of the tree, so reruns agree, whatever the
partitioning, and no level sees a draw that an earlier one used.

Defined results: a null text has size 0 and is taken 0 words; a null source is a source, the last in
order; rows that repeat a doc_id are rounded separately (numbered by their hash, then alike); a null
doc_id is one like any other. Texts are counted whole, however long. An empty table gives no rows.
Other columns are ignored, or kept by ``resampled``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import staged

MAX_COPIES = 3
WEIGHTS = (1.0, 2.0, 3.0)
GROUP = 2048
LEVELS = 20
#: A document with more than one in so many of its source's words is rounded against all smaller ones.
PIECES = 4096


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space.

    Counted as the places where a word starts, in two native passes over the text.
    """
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " ", -1), lambda w: w != "")).cast("bigint")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size and target of each source; one row per source.

    Sources are ranked by code point in range partitions and given their weights in turn. The level
    that the capped shares leave for the others is found by repeating one small aggregate.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    ranged = staged(ranged, "sources")
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, seen = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(seen)
        seen += counts.get(part, 0)
    order = Window.partitionBy("part").orderBy(F.col("source").isNull(), F.col("source"))
    start = F.element_at(F.array(*map(F.lit, starts or [0])), F.col("part") + 1)
    turn = F.pmod(start + F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    weighted = staged(ranged.select("source", "source_size", weight.alias("weight")), "weights")
    cap = F.col("source_size") * F.lit(max_copies)
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        row = weighted.agg(
            F.count_if(full).alias("n"),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, level = row["n"], (total - row["taken"]) / row["open"]
    share = F.lit(0.0) if level is None else F.least(F.col("weight") * F.lit(level), cap.cast("double"))
    return weighted.select("source", "source_size", share.alias("target"))


def _whole(p: float) -> float:
    return float(round(p)) if abs(p - round(p)) < 1e-9 else p


def _round_large(rows: pd.DataFrame) -> pd.DataFrame:
    """The large documents of one source made whole, each against all that is smaller.

    ``rest`` is the words of the source's other open documents, all with fraction ``p``. Every row
    gets the fraction ``left`` that these have in the end.
    """
    rows = rows.sort_values(["size", "draw", "doc_id", "key"], ascending=[False, True, True, True], kind="stable")
    size, draw = rows["size"].to_numpy(np.float64), rows["draw"].to_numpy(np.float64)
    smaller = size[::-1].cumsum()[::-1] - size + rows["rest"].iloc[0]
    want = rows["p"].iloc[0] * (smaller[0] + size[0])  # words still to be taken, of this document and the smaller ones
    p = np.zeros(len(rows))
    for i, (a, w) in enumerate(zip(size, smaller, strict=True)):
        can_take, can_leave = want >= a, want <= w
        if can_take and can_leave:
            p[i] = draw[i] * (a + w) < want
        elif can_take or can_leave:
            p[i] = can_take
        else:  # what is over or short after taking it, and after leaving it
            p[i] = a - want < want - w
        want = min(max(want - p[i] * a, 0.0), w)
    rest = rows["rest"].iloc[0]
    return rows.assign(p=p, left=_whole(want / rest) if rest else 0.0)


def _round_group(rows: pd.DataFrame) -> pd.DataFrame:
    """Pivotal rounding of one group: every row gets a whole ``p`` but one at most.

    Large documents are paired first, so that what is left over is a small one as a rule.
    """
    rows = rows.sort_values(["size", "draw", "doc_id", "key"], ascending=[False, True, True, True], kind="stable")
    size, p = rows["size"].to_numpy(np.float64), rows["p"].to_numpy(np.float64).copy()
    draw = rows["draw"].to_numpy(np.float64)
    held = -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up = min((1 - p[held]) * a, p[i] * b)  # words that could move from i to held
        down = min(p[held] * a, (1 - p[i]) * b)  # and the other way
        words = up if draw[i] * (up + down) < down else -down
        p[held] = _whole(p[held] + words / a)
        p[i] = _whole(p[i] - words / b)
        if p[held] in (0, 1):
            held = i if 0 < p[i] < 1 else -1
    return rows.assign(p=p)


def draw_of(level: int) -> Column:
    """A number in [0, 1) for a row and a level of the tree."""
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", "key", "size", "source", F.lit(level)), 11)
    return bits / F.lit(float(1 << 53))


_ROW = "key int, source string, doc_id bigint, size bigint"


def rounded(fractions: DataFrame, group_of: int = GROUP, pieces: int = PIECES) -> DataFrame:
    """``key, source, doc_id, size, p`` with every ``p`` made 0 or 1.

    All rows of a source come with the same ``p``. Large ones go first; each level of the tree then
    rounds groups of one source and passes on the row that each leaves.
    """
    kinds = f"{_ROW}, p double"
    totals = fractions.groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("words"))
    judged = fractions.join(totals, F.col("source").eqNullSafe(F.col("s"))).withColumn("large", F.col("size") * pieces > F.col("words"))
    judged = staged(judged, "fractions")
    rest = judged.groupBy("s").agg(F.coalesce(F.sum(F.when(~F.col("large"), F.col("size"))), F.lit(0)).alias("rest"))
    # At most ``pieces`` rows of a source.
    large = judged.where("large").drop("s", "words", "large").join(rest, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("draw", draw_of(-1))
    firm = staged(large.groupBy("source").applyInPandas(lambda pdf: _round_large(pdf)[["key", "source", "doc_id", "size", "p", "left"]], f"{kinds}, left double"), "large")
    left = firm.groupBy(F.col("source").alias("s")).agg(F.first("left").alias("left"))
    small = judged.where("not large").drop("s", "words", "large").join(left, F.col("source").eqNullSafe(F.col("s")), "left")
    level = staged(small.withColumn("p", F.coalesce("left", "p")).drop("s", "left"), "small")
    done = [firm.drop("left"), level.where(F.col("p").isin(0.0, 1.0))]
    level = level.where(~F.col("p").isin(0.0, 1.0))
    for depth in range(LEVELS):
        sources = level.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        groups = sources.select(F.col("source").alias("s"), F.ceil(F.col("n") / group_of).alias("groups"))
        grouped = level.join(groups, level["source"].eqNullSafe(groups["s"])).withColumn("draw", draw_of(depth))
        grouped = grouped.withColumn("group", F.pmod(F.xxhash64("draw", "key"), F.col("groups"))).drop("s", "groups")
        result = grouped.groupBy("source", "group").applyInPandas(lambda pdf: _round_group(pdf)[["key", "source", "doc_id", "size", "p"]], kinds)
        result = staged(result, f"rounding-{depth}")
        whole = F.col("p").isin(0.0, 1.0)
        done.append(result.where(whole))
        level = result.where(~whole)
        most = level.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            break
    else:
        raise RuntimeError("pivotal rounding did not settle")
    out = level.withColumn("p", F.when(draw_of(LEVELS) < F.col("p"), 1.0).otherwise(0.0))
    for part in done:
        out = out.unionByName(part)
    return out


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """doc_id, key (a row's number within its doc_id), source, size, source_size, target, copies."""
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    targets = source_targets(sized, weights, max_copies)
    # One row per row of ``docs``; equal rows are told apart by a number.
    repeat = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(1))) - 1
    keyed = sized.withColumn("key", repeat)
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    with_ratio = keyed.join(t, keyed["source"].eqNullSafe(t["s"])).drop("s").withColumn("ratio", F.least(ratio, F.lit(float(max_copies))))
    parts = staged(with_ratio.withColumn("base", F.floor("ratio")), "ratios")
    open_ = (F.col("ratio") > F.col("base")) & (F.col("size") > 0)
    fractions = parts.where(open_).select("key", "source", F.col("doc_id").cast("bigint"), "size", (F.col("ratio") - F.col("base")).alias("p"))
    columns = ["doc_id", "key", "source", "size", "source_size", "target"]
    extra = rounded(fractions).select("doc_id", "key", "source", "size", F.col("p").cast("bigint").alias("extra"))
    closed = parts.where(~open_).withColumn("extra", F.lit(0).cast("bigint"))
    e = extra.select(*[F.col(c).alias(f"{c}_") for c in ("doc_id", "key", "source", "size")], "extra")
    opened = parts.where(open_)
    on = [opened[c].eqNullSafe(e[f"{c}_"]) for c in ("doc_id", "key", "source", "size")]
    both = opened.join(e, on).select(*columns, "base", "extra").unionByName(closed.select(*columns, "base", "extra"))
    return both.select(*columns, (F.col("base") + F.col("extra")).cast("bigint").alias("copies"))


def resampled(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (not at all for 0 copies).

    A document without words counts for no target; it is kept once.
    """
    n = copies(docs, weights, max_copies).groupBy("doc_id", "source", "size").agg(F.array_sort(F.collect_list("copies")).alias("each"))
    n = n.select(F.struct("doc_id", "source", "size").alias("of"), "each")
    # The caller's columns stay in a struct, so that their names cannot clash. Fields of structs are
    # compared null for null, and the join and the window use one exchange.
    packed = docs.select(F.struct("doc_id", "source", word_count(F.col("text")).alias("size")).alias("of"), F.struct(*docs.columns).alias("row"))
    joined = packed.join(n, "of")
    turn = F.row_number().over(Window.partitionBy("of").orderBy(F.xxhash64("row.text")))
    times = F.when(F.col("of.size") == 0, F.lit(1)).otherwise(F.element_at("each", turn)).cast("int")
    repeated = joined.withColumn("times", times).where("times > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return repeated.select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
