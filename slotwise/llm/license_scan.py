"""License notices in texts, found by MinHash over overlapping windows and verified exactly.

Texts and templates are lowered and cut into words of ASCII letters and digits, and into shingles of
five words (a shorter template is one shingle of all its words). Templates fall into classes by the
next power of four of their number of shingles, S. In each class a text is read in windows of 2 S
shingles, S apart, so that any S shingles in a row lie in one window whole. A class has as many one-row
bands as make a window that holds ``CONTAINMENT`` of the class's shortest template agree with it in one
band at least, but for a probability of ``MISS``. Retrieved pairs are verified by exact containment of
the template's shingles in the window.

A band can only agree through a shingle that text and template both hold. Texts and windows that hold
no shingle of any template are therefore passed over before bands are computed; this changes no result.

Only DataFrame functions are used. The templates are a parameter, some dozens of texts, so their keys
can be literals and broadcast. A license may have several; a text that holds a long license whole also
holds the shorter ones that are a part of it, and gives a row for each.

Defined results: null or empty texts hold no notice, and an empty table gives no rows; a null doc_id is
scanned like any other. Rows are scanned one by one, and those that repeat a doc_id (or have none) give
one row per (doc_id, license) with the best window of any of them and all their windows. Texts are read
whole, however long. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .staging import staged

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-4

Templates = Mapping[str, Sequence[str]]


def words_of(text: Column) -> Column:
    """Words in order; a text that starts or ends with another character has an empty one there."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", -1)


def shingles_of(words: Column, size: int) -> Column:
    """A hash for each run of ``size`` hashed words."""
    last = F.size(words) - size
    hashed = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
    return F.when(last >= 0, hashed).otherwise(F.array().cast("array<bigint>"))


def bands_for(shortest: int, span: int) -> int:
    """Bands that miss a window holding ``CONTAINMENT`` of a template of so many shingles with probability ``MISS``."""
    held = CONTAINMENT * shortest if shortest > 1 else 1
    window = 2 * span if span > 1 else 1
    agree = held / (window + shortest - held)
    return 1 if agree >= 1 else math.ceil(math.log(MISS) / math.log(1 - agree))


def min_hashes(shingles: Column, bands: int) -> Column:
    """One minimum per band, each with its band mixed in."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda band: F.xxhash64(F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, band))), band),
    )


def template_table(templates: Templates) -> list[dict]:
    """license, template (a number), size (words of a shingle), span (S) and distinct shingles (as words) of each template."""
    out = []
    for license_, texts in templates.items():
        for text in texts:
            w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
            size = min(SHINGLE, len(w))
            shingles = sorted({tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
            span = 1
            while span < len(shingles):
                span *= 4
            out.append({"license": license_, "template": len(out), "size": size, "span": span, "shingles": shingles})
    return out


def hashed_templates(spark: SparkSession, table: list[dict]) -> dict[int, list[int]]:
    """template -> the hashes of its shingles, made like those of the texts."""
    rows = [(t["template"], " ".join(x)) for t in table for x in t["shingles"]]
    words = F.transform(F.split("w", " "), lambda x: F.xxhash64(x))
    by_size = F.element_at(F.array(*(shingles_of(words, k) for k in range(1, SHINGLE + 1))), F.size(words))
    out: dict[int, list[int]] = {}
    for r in spark.createDataFrame(rows, "template int, w string").select("template", by_size[0].alias("h")).collect():
        out.setdefault(r["template"], []).append(r["h"])
    return out


def scanned(docs: DataFrame, templates: Templates | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, word (where the best window starts) and windows of each notice."""
    spark = docs.sparkSession
    table = template_table(templates or TEMPLATES)
    hashes = hashed_templates(spark, table)
    sizes = sorted({t["size"] for t in table})
    # Arrays are exploded as an array of one, so that they are computed once for a text and not once for
    # every use.
    numbered = docs.select("doc_id", F.explode(F.array(F.transform(words_of(F.col("text")), lambda x: F.xxhash64(x)))).alias("w"))
    hashed = numbered.select("doc_id", F.explode(F.array(F.struct(*(shingles_of(F.col("w"), k).alias(f"h{k}") for k in sizes)))).alias("h")).select("doc_id", "h.*")
    known = {k: F.array(*(F.lit(x) for x in sorted({x for t in table if t["size"] == k for x in hashes[t["template"]]}))) for k in sizes}
    holds = None
    for k in sizes:
        one = F.arrays_overlap(F.col(f"h{k}"), known[k])
        holds = one if holds is None else holds | one
    # Rows are told apart by a number that is written with them, as a doc_id may be null or repeated.
    survivors = staged(hashed.where(holds).withColumn("row", F.monotonically_increasing_id()), "license-holders")

    found = []
    for size, span in sorted({(t["size"], t["span"]) for t in table}):
        own = [t for t in table if (t["size"], t["span"]) == (size, span)]
        mine = spark.createDataFrame([(t["license"], t["template"], hashes[t["template"]]) for t in own], "license string, template int, held array<bigint>")
        n = bands_for(min(len(t["shingles"]) for t in own), span)
        bands = mine.select("license", "template", "held", F.explode(min_hashes(F.col("held"), n)).alias("key"))
        h = F.col(f"h{size}")
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(span))
        here = survivors.where(F.size(h) > 0).select("doc_id", "row", F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), F.slice(h, i + 1, 2 * span if span > 1 else 1).alias("shingles")))).alias("window"))
        near = here.select("doc_id", "row", "window.at", "window.shingles").where(F.arrays_overlap("shingles", known[size]))
        keyed = near.select("doc_id", "row", "at", "shingles", F.explode(min_hashes(F.col("shingles"), n)).alias("key"))
        pairs = keyed.join(F.broadcast(bands), "key").groupBy("row", "template", "at").agg(F.first("doc_id").alias("doc_id"), F.first("license").alias("license"), F.first("shingles").alias("shingles"), F.first("held").alias("held"))
        share = F.size(F.array_intersect("held", "shingles")) / F.size("held")
        found.append(pairs.select("doc_id", "row", "license", "at", share.alias("containment")))
    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    best = F.max_by(F.col("at"), F.struct(F.col("containment"), -F.col("at")))
    # A window counts once for a license, whichever of its templates it holds.
    windows = F.count_distinct("row", "at")
    return every.where(F.col("containment") >= containment).groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), best.cast("bigint").alias("word"), windows.alias("windows")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def oracle(templates: Templates | None = None, containment: float = CONTAINMENT) -> str:
    """The shingles of every window counted against every template, in DuckDB SQL."""
    table = template_table(templates or TEMPLATES)
    rows = ", ".join(f"('{t['license']}', {t['template']}, {t['size']}, {t['span']}, {len(t['shingles'])}, '{' '.join(x)}')" for t in table for x in t["shingles"])
    shingles = " UNION ALL ".join(
        f"SELECT doc_id, rid, {k} AS size, unnest(range(0, len(w) - {k - 1})) AS i, unnest(list_transform(range(1, len(w) - {k - 2}), lambda j: array_to_string(w[j:j + {k - 1}], ' '))) AS shingle FROM d"
        for k in sorted({t["size"] for t in table})
    )
    return f"""WITH t(license, template, size, span, n, shingle) AS (VALUES {rows}),
d AS (SELECT doc_id, row_number() OVER () AS rid, string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+') AS w FROM documents),
met AS (SELECT doc_id, rid, license, template, span, n, shingle, i FROM ({shingles}) JOIN t USING (size, shingle)),
win AS (SELECT *, unnest(CASE WHEN span = 1 THEN [i] WHEN i < span THEN [0] ELSE [i // span * span, i // span * span - span] END) AS pos FROM met),
found AS (SELECT doc_id, rid, license, template, pos, count(DISTINCT shingle) / any_value(n) AS containment FROM win GROUP BY doc_id, rid, license, template, pos)
SELECT doc_id, license, max(containment) AS containment, CAST(arg_max(pos, (containment, -pos)) AS BIGINT) AS word, count(DISTINCT (rid, pos)) AS windows
FROM found WHERE containment >= {containment} GROUP BY doc_id, license"""
