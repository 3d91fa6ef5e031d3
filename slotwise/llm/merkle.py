"""A Merkle manifest of a table: a hash tree per group of rows, a tree over the groups, and a proof per row.

A row's leaf is the SHA-256 of its fields, each written with its length. The leaves of a group are
numbered in order (in ranges, so that a group of any size is no single task). Each level joins the nodes
at slot zero of a run with their siblings at slots 1, 2, ...: an equijoin on the index that the sibling's
index less its slot gives, so that every node is shuffled once a level and no group is collected. Slot
zero's row then emits the parent. Levels are staged; the paths are handed down again from the root, a
row for each run, so that what the leaves of a run share is sent once for all of them.

Defined results: a null field is written ``-``; a null key comes first; rows of one key are ordered by their leaf,
and equal rows are leaves each; a null group is a group of its own, before all others. No rows give no leaves. A text
of any length is hashed whole. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sql_text import crc32_sql
from .staging import discard, staged
from .sweeps import SUM, in_parts, running

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8


def _written(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def record_hash(*values: Column) -> Column:
    """Lowercase hex SHA-256 of values, each with its length in bytes, or ``-`` for null."""
    return F.sha2(F.concat(*map(_written, values)), 256)


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """tree, idx, n, hashes and h of the parents of ``nodes`` (tree, idx, n, h)."""
    slot = F.col("idx") % arity
    out = nodes.where(slot == 0).select("tree", "idx", "n", F.col("h").alias("h0"))
    for k in range(1, arity):
        out = out.join(nodes.where(slot == k).select("tree", (F.col("idx") - k).alias("idx"), F.col("h").alias(f"h{k}")), ["tree", "idx"], "left")
    hashes = F.array_compact(F.array(*(f"h{k}" for k in range(arity))))
    parents = out.select("tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), hashes.alias("hashes"))
    return parents.withColumn("h", F.sha2(F.array_join("hashes", ""), 256))


def _levels(leaves: DataFrame, most: int, arity: int) -> list[DataFrame]:
    """The nodes of all levels, leaves first; a tree's last node is the one with n = 1."""
    levels = [leaves]
    while most > 1:
        levels.append(staged(_runs(levels[-1].where("n > 1"), arity), "runs"))
        most = -(-most // arity)
    return levels


def _step(hashes: Column, slot: Column) -> Column:
    """What stands left and right of the node at ``slot`` of a run."""
    left, right = F.slice(hashes, F.lit(1), slot), F.slice(hashes, slot + 2, F.greatest(F.size(hashes) - slot - 1, F.lit(0)))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _runs_with_paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame | None:
    """tree, idx and hashes of the runs of leaves, with path and the other columns of ``tops`` for the run's parent."""
    given = [c for c in tops.columns if c not in ("tree", "path")]
    runs = None
    for level in range(len(levels) - 1, 0, -1):
        paths = levels[level].where("n = 1").select("tree", "idx").join(tops, "tree").select("tree", "idx", "path", *given)
        if runs is not None:
            each = runs.select("tree", "idx", "path", *given, "hashes", F.posexplode("hashes").alias("slot", "_own"))
            below = each.select("tree", (F.col("idx") * arity + F.col("slot")).alias("idx"), F.concat(F.array(_step(F.col("hashes"), F.col("slot"))), "path").alias("path"), *given)
            paths = paths.unionByName(below)
        runs = levels[level].select("tree", "idx", "hashes").join(paths, ["tree", "idx"])
    return runs


def _leaf_paths(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """``leaves`` (tree, idx, n and more) with path and the other columns of ``tops``."""
    given = [c for c in tops.columns if c not in ("tree", "path")]
    lone = leaves.where("n = 1").join(tops, "tree").select(*leaves.columns, "path", *given)
    runs = _runs_with_paths(levels, tops, arity)
    if runs is None:
        return lone
    many = leaves.where("n > 1").withColumn("_run", F.expr(f"idx div {arity}")).join(runs.withColumnRenamed("idx", "_run"), ["tree", "_run"])
    path = F.concat(F.array(_step(F.col("hashes"), (F.col("idx") % arity).cast("int"))), "path")
    return many.select(*leaves.columns, path.alias("path"), *given).unionByName(lone)


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with tree) with idx, their place in the tree from 0, and n, the tree's size."""
    placed = in_parts(rows, "tree", *order)
    sizes = placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    out = running(placed, ["tree"], order, idx=(SUM, F.lit(1).cast("bigint"))).withColumn("idx", F.col("idx") - 1)
    numbered = staged(out.drop("part").join(sizes, "tree"), "leaves")
    discard(placed)
    return numbered


def manifest(rows: DataFrame, key: str, group: str, leaf: Column, arity: int = ARITY, **more: Column) -> DataFrame:
    """``key``, leaf, ``more``, subroot, root and path of each row.

    ``path`` has, from the leaf up, the hashes left and right of the node in its run: ``folded`` gives the root again.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # null first, then as bytes
    leaves = _numbered(rows.select(tree.alias("tree"), F.col(key), leaf.alias("h"), *(c.alias(n) for n, c in more.items())), [key, "h"])
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels = _levels(leaves.select("tree", "idx", "n", "h"), most, arity)

    subroots = None
    for level in levels:
        one = level.where("n = 1").select(F.lit("").alias("tree"), F.col("tree").alias("name"), "h")
        subroots = one if subroots is None else subroots.unionByName(one)
    groups = _numbered(subroots, ["name"])
    above = _levels(groups.select("tree", "idx", "n", "h"), groups.count(), arity)
    step = "array<struct<left:string,right:string>>"
    root = above[-1].where("n = 1").select("tree", F.array().cast(step).alias("path"), F.col("h").alias("root"))
    tops = _leaf_paths(groups, above, root, arity).select(F.col("name").alias("tree"), "path", F.col("h").alias("subroot"), "root")
    proven = _leaf_paths(leaves, levels, staged(tops, "groups"), arity)
    return proven.select(key, F.col("h").alias("leaf"), *more, "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = record_hash(*map(F.col, FIELDS))
    tampered = F.when(chosen, record_hash(*map(F.col, FIELDS[:-1]), lower))
    rows = manifest(docs, "doc_id", "lang", leaf, tampered=tampered)
    root = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    proven = rows.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(depth: int = 7) -> str:
    """SQL for up to 8 ** depth rows a language: runs are grouped, not joined, and proofs are gathered bottom up."""

    def field(value: str) -> str:
        return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"

    def grown(name: str, source: str) -> str:
        """{name}{k}: every leaf's node at level k with what a changed leaf (f) folds to and its siblings so far."""
        parts = [f"{name}0 AS (SELECT id, tree, idx, n, h, f, '' AS proof FROM {source})"]
        for k in range(depth):
            left, right = "array_to_string(r.hs[1:l.idx % 8], '')", "array_to_string(r.hs[l.idx % 8 + 2:], '')"
            parts.append(f"""{name}n{k} AS (SELECT DISTINCT tree, idx, h FROM {name}{k} WHERE n > 1),
{name}r{k} AS (SELECT tree, idx // 8 AS run, sha256(string_agg(h, '' ORDER BY idx)) AS h, list(h ORDER BY idx) AS hs FROM {name}n{k} GROUP BY 1, 2),
{name}{k + 1} AS (SELECT id, tree, idx, n, h, f, proof FROM {name}{k} WHERE n = 1
  UNION ALL SELECT l.id, l.tree, l.idx // 8, (l.n + 7) // 8, r.h, sha256({left} || l.f || {right}), l.proof || {left} || {right}
  FROM {name}{k} l JOIN {name}r{k} r ON r.tree = l.tree AND r.run = l.idx // 8 WHERE l.n > 1)""")
        return ",\n".join(parts)

    values = [field(c) for c in FIELDS]
    lowered = field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    chosen = f"{crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0"
    return f"""WITH docs AS (SELECT row_number() OVER () AS id, * FROM documents),
hashed AS (SELECT id, doc_id, coalesce('=' || lang, '') AS tree, sha256({" || ".join(values)}) AS h, CASE WHEN {chosen} THEN sha256({" || ".join(values[:-1])} || {lowered}) END AS t FROM docs),
leaves AS (SELECT id, doc_id, tree, h, coalesce(t, h) AS f, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{grown("a", "leaves")},
subroots AS (SELECT DISTINCT tree AS name, h FROM a{depth}),
groups AS (SELECT name AS id, '' AS tree, row_number() OVER (ORDER BY name) - 1 AS idx, count(*) OVER () AS n, h, h AS f FROM subroots),
{grown("b", "groups")},
-- A changed leaf meets its group's siblings above the subroot.
tops AS (SELECT g.id AS tree, b.h AS root, b.proof, g.h AS subroot FROM b{depth} b JOIN groups g ON g.id = b.id),
c0 AS (SELECT a.id, a.tree AS name, '' AS tree, g.idx, g.n, a.f FROM a{depth} a JOIN groups g ON g.id = a.tree),
{",".join(f"""c{k + 1} AS (SELECT * FROM c{k} WHERE n = 1 UNION ALL SELECT l.id, l.name, l.tree, l.idx // 8, (l.n + 7) // 8, sha256(array_to_string(r.hs[1:l.idx % 8], '') || l.f || array_to_string(r.hs[l.idx % 8 + 2:], ''))
  FROM c{k} l JOIN br{k} r ON r.run = l.idx // 8 WHERE l.n > 1)""" for k in range(depth))}
SELECT l.doc_id, l.h AS leaf, t.subroot, t.root, sha256(a.proof || t.proof) AS proof_sha256, c.f AS folded_root, c.f = t.root AS verified
FROM leaves l JOIN a{depth} a ON a.id = l.id JOIN tops t ON t.tree = l.tree JOIN c{depth} c ON c.id = l.id"""
