"""The trie of what conversations have in common at their beginning, with sums over its subtrees.

A turn is known by two 64-bit hashes of role and text, and the first d turns of a conversation by the XOR of
the hashes of each turn with its place, a running fold that no task holds whole. Equal beginnings are one
node; the smallest conversation through it and its depth name it.

Sums over subtrees come from an Euler tour. Each node has an arc that enters it and one that leaves it; the
arc that follows another is known from first children, next siblings and parents. The tour is a linked
list, which is ranked in two steps: in batches of nodes sorted by conversation and depth, where most arcs
follow each other, chains are contracted to one element; these are ranked by pointer jumping, a join a
round, in a logarithmic number of rounds. Arcs then have positions, values are summed up along them in
blocks, and a subtree's sum is the difference between its node's leaving and entering.

Defined results: within a conversation, rows are ordered by turn (null first), then role, then the hash of the text; a
null role or text is empty; rows without a conversation belong to none and count nowhere; equal rows are turns
each. Texts of any length are hashed whole. No rows give no nodes. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .sql_text import crc32_sql
from .staging import discard, staged
from .sweeps import SUM, XOR, followed, in_parts, running

WORD = r"[^\x20\x09-\x0D]+"
#: Blocks of positions over which values are summed; more rows make blocks longer, not more.
BLOCKS = 1024
#: Decimal ids that are joined before the one task that hashes a node's ids reads them.
IDS_A_CHUNK = 4096


def turns_of(rows: DataFrame) -> DataFrame:
    """conv_id, k (the turn's place from 0), a and b (hashes) and words of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashed = rows.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
    )
    order = ["turn", "role", "a", "b"]
    placed = in_parts(hashed, "conv_id", *order)
    out = running(placed, ["conv_id"], order, k=(SUM, F.lit(1).cast("bigint")))
    return out.select("conv_id", (F.col("k") - 1).alias("k"), "a", "b", "words")


def rebuilt(turns: DataFrame, most: int, base: Column, borrowed: Column) -> tuple[DataFrame, DataFrame]:
    """The turns (k, a, b, words) of every conversation with its first ones from another, and all conversations.

    ``base`` names the other conversation and ``borrowed`` how many of its turns are taken, ``most`` at most.
    """
    ids = turns.select("conv_id").distinct().withColumn("base", base).withColumn("h", borrowed)
    # At most ``most`` turns a row, so that the array is short.
    bases = turns.where(F.col("k") < most).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("k", "a", "b", "words"))).alias("first"))
    met = staged(ids.join(bases, "base", "left").select("conv_id", "h", F.slice(F.coalesce("first", F.array().cast(bases.schema["first"].dataType)), F.lit(1), F.col("h").cast("int")).alias("first")), "bases")
    heads = met.select("conv_id", F.explode("first").alias("t")).select("conv_id", "t.*")
    # Only where the other conversation is shorter than what is to be taken do the turns move up.
    short = met.where(F.size("first") < F.col("h")).select("conv_id", (F.col("h") - F.size("first")).alias("up"))
    own = turns.where(F.col("k") >= borrowed).join(short, "conv_id", "left").select("conv_id", (F.col("k") - F.coalesce("up", F.lit(0))).alias("k"), "a", "b", "words")
    return heads.unionByName(own), met.select("conv_id")


def _ids_hash(ends: DataFrame) -> DataFrame:
    """x, y, d and ends_sha256: the hash of the decimal ids (conv_id) of each key, ascending, joined by commas.

    Ranges of sorted ids are joined to texts in parallel; a key's texts are then hashed one after another.
    """
    placed = in_parts(ends, "d", "x", "y", "conv_id")
    keys = ["d", "x", "y"]
    within = Window.partitionBy("part", *keys).orderBy("conv_id")
    numbered = placed.withColumn("chunk", F.floor((F.row_number().over(within) - 1) / IDS_A_CHUNK))
    # At most IDS_A_CHUNK ids a row.
    texts = numbered.groupBy(*keys, "part", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    placed_texts = texts.repartition(*keys).sortWithinPartitions(*keys, "part", "chunk").select(*keys, "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def rows(found: dict[tuple, str]) -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(list(found.values()))], names=[*keys, "ends_sha256"])

        for batch in batches:
            out: dict[tuple, str] = {}
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*keys, "ids")), strict=True):
                if tuple(now) != key:
                    if state is not None:
                        out[key] = state.hexdigest()
                    key, state = tuple(now), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield rows(out)
        if state is not None:
            yield rows({key: state.hexdigest()})

    return placed_texts.mapInArrow(run, "d bigint, x bigint, y bigint, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, words and ends_sha256 of each node."""
    placed = in_parts(turns, "conv_id", "k")
    own = {"x": F.xxhash64("k", "a", "b"), "y": F.xxhash64(F.lit(2), "b", "k", "a")}
    walked = running(placed, ["conv_id"], ["k"], x=(XOR, own["x"]), y=(XOR, own["y"]))
    steps = staged(walked.select("conv_id", (F.col("k") + 1).alias("d"), "x", "y", *(F.col(n).bitwiseXOR(own[n]).alias(f"p{n}") for n in own), "words"), "steps")
    discard(placed)
    smallest = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    none = F.lit(0).cast("bigint")
    root = smallest.select(none.alias("d"), none.alias("x"), none.alias("y"), F.lit(None).cast("bigint").alias("px"), F.lit(None).cast("bigint").alias("py"), "conv_id", "n_convs", none.alias("words"))
    inner = steps.groupBy("d", "x", "y").agg(F.min("px").alias("px"), F.min("py").alias("py"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    nodes = staged(inner.unionByName(root), "nodes")

    last = steps.groupBy("conv_id").agg(F.max_by(F.struct("d", "x", "y"), "d").alias("end"))
    ends = conversations.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(F.col(f"end.{c}"), none).alias(c) for c in ("d", "x", "y")))
    hashed = _ids_hash(ends)

    children = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("first_child"))
    named = nodes.select((F.col("d") + 1).alias("d"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(children, ["d", "x", "y"], "left").join(hashed, ["d", "x", "y"], "left").join(named, ["d", "px", "py"], "left")
    return full.select(
        "conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), "first_child", "words",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


_ARCS = "conv_id bigint, depth bigint, leaving boolean, head_conv bigint, head_depth bigint, head_leaving boolean, place bigint, tail boolean, next_conv bigint, next_depth bigint, next_leaving boolean"


def _contracted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Both arcs of each node of a batch (sorted by conv_id, depth), each with the head of its chain within the batch."""
    column = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    conv, depth = column("conv_id"), column("depth")
    n = len(conv)
    missing = np.int64(np.iinfo(np.int64).min)
    filled = lambda name: batch.column(name).fill_null(missing).to_numpy()
    child, sibling, parent = filled("first_child"), filled("sibling"), filled("parent_conv_id")
    # What follows an arc, as (conv, depth, leaving); a node of a batch is found by conv and depth.
    next_conv = np.where(child != missing, child, conv), np.where(sibling != missing, sibling, parent)
    next_depth = np.where(child != missing, depth + 1, depth), np.where(sibling != missing, depth, depth - 1)
    next_leaving = child == missing, sibling == missing
    ended = np.concatenate([np.zeros(n, dtype=bool), (sibling == missing) & (parent == missing)])
    to_conv, to_depth, to_leaving = (np.concatenate(x) for x in (next_conv, next_depth, next_leaving))
    # Depths of one conversation follow each other, so that a conversation's first row finds all of its rows.
    names, first, size = np.unique(conv, return_index=True, return_counts=True)
    slot = np.minimum(np.searchsorted(names, to_conv), len(names) - 1)
    away = to_depth - depth[first[slot]]
    here = (names[slot] == to_conv) & (away >= 0) & (away < size[slot]) & ~ended
    follower = np.where(here, first[slot] + away + n * to_leaving, -1)
    leads = np.full(2 * n, -1, dtype=np.int64)
    leads[follower[here]] = np.flatnonzero(here)
    # Pointer doubling towards the head of each chain.
    head, place = np.where(leads >= 0, leads, np.arange(2 * n)), (leads >= 0).astype(np.int64)
    while True:
        further = place[head]
        if not further.any():
            break
        place = place + further
        head = head[head]
    both = lambda x: np.concatenate([x, x])
    convs, depths, leaving = both(conv), both(depth), np.repeat([False, True], n)
    blank = lambda values: pa.array(values, mask=ended)
    return pa.RecordBatch.from_arrays(
        [pa.array(convs), pa.array(depths), pa.array(leaving), pa.array(convs[head]), pa.array(depths[head]), pa.array(leaving[head]), pa.array(place), pa.array(~here), blank(to_conv), blank(to_depth), blank(to_leaving)],
        names=["conv_id", "depth", "leaving", "head_conv", "head_depth", "head_leaving", "place", "tail", "next_conv", "next_depth", "next_leaving"],
    )


def ranked(chains: DataFrame) -> DataFrame:
    """``to_end`` of each element of linked lists (id, next, length; next null at an end): the lengths from it to its end.

    Pointer jumping: each round adds what the next element has and skips it, so that rounds are logarithmic in
    the longest list. Elements that have reached the end leave the join.
    """
    now = staged(chains.select("id", F.col("next"), F.col("length").alias("to_end")), "jumps")
    while not now.where("next is not null").isEmpty():
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("_after"), F.col("to_end").alias("_more"))
        jumped = now.where("next is not null").join(ahead, "next").select("id", F.col("_after").alias("next"), (F.col("to_end") + F.col("_more")).alias("to_end"))
        old, now = now, staged(now.where("next is null").unionByName(jumped), "jumps")
        discard(old)
    return now.select("id", "to_end")


def toured(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, leaving and position of both arcs of each node (conv_id, depth, parent_conv_id, first_child)."""
    placed = in_parts(nodes.select("parent_conv_id", "depth", "conv_id", "first_child"), "parent_conv_id", "depth", "conv_id")
    linked = followed(placed, ["parent_conv_id", "depth"], ["conv_id"], "conv_id", "sibling")
    sorted_ = linked.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    arcs = staged(sorted_.select("conv_id", "depth", "parent_conv_id", "first_child", "sibling").mapInArrow(lambda batches: map(_contracted, batches), _ARCS), "arcs")
    discard(placed)
    element = lambda name: F.struct(*(F.col(f"{name}_{c}").alias(c) for c in ("conv", "depth", "leaving")))
    chains = arcs.where("tail").select(element("head").alias("id"), F.when(F.col("next_conv").isNotNull(), element("next")).alias("next"), (F.col("place") + 1).alias("length"))
    ranks = ranked(chains)
    total = arcs.count()
    met = arcs.select("conv_id", "depth", "leaving", element("head").alias("id"), "place").join(ranks, "id")
    return met.select("conv_id", "depth", "leaving", (F.lit(total) - F.col("to_end") + F.col("place")).alias("position")).withColumn("_total", F.lit(total))


def subtree_sums(arcs: DataFrame, values: DataFrame, *names: str) -> DataFrame:
    """conv_id, depth and each of ``names`` summed over the subtree, from ``values`` per node."""
    given = values.select("conv_id", "depth", F.lit(False).alias("leaving"), *names)
    valued = arcs.join(given, ["conv_id", "depth", "leaving"], "left").select("conv_id", "depth", "leaving", "position", F.expr(f"position div (_total div {BLOCKS} + 1)").alias("block"), *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
    rows = staged(valued, "valued")
    totals = rows.groupBy("block").agg(*(F.sum(n).alias(f"_{n}") for n in names))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # At most BLOCKS rows, whatever the tour's length.
    offsets = F.broadcast(totals.select("block", *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in names)))
    so_far = Window.partitionBy("block").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.select("*", *(F.sum(n).over(so_far).alias(f"{n}_here") for n in names)).join(offsets, "block")
    at = {n: F.col(f"{n}_here") + F.col(f"_{n}") for n in names}
    # Entering carries the node's own value, which its subtree includes.
    return summed.groupBy("conv_id", "depth").agg(*((F.max(F.when(F.col("leaving"), at[n])) - F.max(F.when(~F.col("leaving"), at[n] - F.col(n)))).alias(f"subtree_{n}") for n in names))


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of ``trie`` with n_leaves and saved_tokens of their subtrees."""
    nodes = staged(trie(turns, conversations), "trie")
    facts = nodes.select("conv_id", "depth", (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = subtree_sums(toured(nodes), facts, "leaves", "saved")
    joined = nodes.join(sums, ["conv_id", "depth"])
    return joined.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("subtree_leaves").alias("n_leaves"), F.col("subtree_saved").alias("saved_tokens"), "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = staged(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")), "turns")
    base, h = F.expr("conv_id - conv_id % 20"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return prefix_trie(*rebuilt(turns, 3, base, h))


def oracle() -> str:
    """SQL that compares whole sequences and sums over every node's ancestors."""
    return f"""WITH own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) - 1 AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
seqs AS (SELECT i.conv_id, coalesce((SELECT list([role, text] ORDER BY k) FROM own o WHERE o.conv_id = i.base AND o.k < i.h), []) || coalesce((SELECT list([role, text] ORDER BY k) FROM own o WHERE o.conv_id = i.conv_id AND o.k >= i.h), []) AS s FROM ids i),
steps AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS p, s[1:d - 1] AS above, CASE WHEN d > 0 THEN len(regexp_extract_all(s[d][2], '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS (SELECT d, p, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM steps GROUP BY d, p),
kids AS (SELECT d - 1 AS d, above AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_ AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, u.conv_id AS parent_conv_id FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p LEFT JOIN nodes u ON u.d = n.d - 1 AND u.p = n.above AND n.d > 0),
-- A node lies on the path of its smallest member, so that its ancestors are that conversation's nodes.
path AS (SELECT s.conv_id, s.d, n.conv_id AS top FROM steps s JOIN nodes n ON n.d = s.d AND n.p = s.p),
sums AS (SELECT a.top AS conv_id, a.d, count(*) FILTER (f.n_children = 0) AS n_leaves, CAST(sum((f.n_convs - 1) * f.words) AS BIGINT) AS saved_tokens FROM full_ f JOIN path a ON a.conv_id = f.conv_id AND a.d <= f.d GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, CAST(f.parent_conv_id AS DOUBLE) AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) AS ends_sha256 FROM full_ f JOIN sums s ON s.conv_id = f.conv_id AND s.d = f.d"""
