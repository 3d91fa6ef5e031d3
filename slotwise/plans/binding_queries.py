"""Registered queries of bindings: the classes of prior closes, and strict subsets with identities of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.operators import dims
from slotwise.plans.queries import query
from slotwise.sources.tables import read

# Customers are the symbols. The price rows of one segment are missing, those of another come twice; of the others,
# two nations give none that can be read, and balances of zero or less are no prices.
FACTS = """f AS (SELECT c_custkey AS symbol, c_mktsegment AS segment, c_acctbal AS close,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'absent' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'duplicate' WHEN c_nationkey = 0 THEN 'malformed' WHEN c_nationkey = 1 THEN 'nonfinite' WHEN c_acctbal <= 0 THEN 'nonpositive' ELSE '' END AS reason FROM customer),
facts AS (SELECT symbol, segment, CASE reason WHEN 'absent' THEN 'missing' WHEN '' THEN 'valid' ELSE 'invalid' END AS status, reason, CASE WHEN reason = '' THEN CAST(round(close * 100) AS BIGINT) END AS cents FROM f)"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").withColumn("symbol", F.col("c_custkey"))
    close = F.when(F.col("c_nationkey") == 1, F.lit(float("inf"))).when(F.col("c_nationkey") > 1, F.col("c_acctbal").cast("double"))
    copies = F.explode(F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    rows = customers.where("c_mktsegment <> 'FURNITURE'").select("symbol", close.alias("close"), copies.alias("copy"))
    return dims.prior_closes(customers, rows).withColumn("cents", F.round(F.col("close") * 100).cast("bigint"))


@query(f"""WITH {FACTS} SELECT status, reason, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM facts GROUP BY 1, 2""")
def prior_close_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior closes of every class: valid, absent, duplicate, malformed, nonfinite and nonpositive."""
    return _facts(spark, sf_dir).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


def _identity(text: str) -> str:
    return f"""(SELECT case_id, sha256(string_agg(h, '' ORDER BY prefix)) AS id FROM (SELECT case_id, h[1:3] AS prefix, sha256(string_agg(h, '' ORDER BY h)) AS h
  FROM (SELECT case_id, sha256({text}) AS h FROM members) GROUP BY 1, 2) GROUP BY 1)"""


# One selection is all of the binding, one empty, one names a symbol twice and one a symbol that the binding has not.
@query(f"""WITH {FACTS}, cases AS (SELECT DISTINCT segment AS case_id FROM facts UNION ALL SELECT unnest(['all', 'none'])),
selected AS (SELECT segment AS case_id, symbol FROM facts UNION ALL SELECT 'all', symbol FROM facts UNION ALL SELECT 'AUTOMOBILE', -1 UNION ALL SELECT 'MACHINERY', min(symbol) FROM facts WHERE segment = 'MACHINERY'),
counts AS (SELECT case_id, count(*) AS rows_, count(DISTINCT symbol) AS n, bool_or(symbol < 0) AS outside FROM selected GROUP BY 1),
judged AS (SELECT case_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'empty' WHEN rows_ > n THEN 'repeated' WHEN outside THEN 'outside' WHEN n >= (SELECT count(*) FROM facts) THEN 'not_strict' ELSE '' END AS reason FROM cases LEFT JOIN counts USING (case_id)),
members AS (SELECT case_id, symbol, status, facts.reason, cents FROM selected JOIN judged USING (case_id) JOIN facts USING (symbol) WHERE judged.reason = '')
SELECT case_id, n, reason, u.id AS universe_identity, p.id AS prior_identity FROM judged LEFT JOIN {_identity("CAST(symbol AS VARCHAR)")} u USING (case_id)
LEFT JOIN {_identity("concat_ws(chr(31), CAST(symbol AS VARCHAR), status, reason, coalesce(CAST(cents AS VARCHAR), chr(0)))")} p USING (case_id)""")
def subset_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of a binding by market segment, judged as strict subsets, with the identities of those accepted."""
    facts = _facts(spark, sf_dir)
    segments = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("case_id"), F.col("c_custkey").alias("symbol"))
    cases = segments.select("case_id").distinct().union(spark.createDataFrame([("all",), ("none",)], "case_id string"))
    selected = segments.union(facts.select(F.lit("all"), "symbol")).union(spark.createDataFrame([("AUTOMOBILE", -1)], "case_id string, symbol bigint"))
    selected = selected.union(segments.where("case_id = 'MACHINERY'").groupBy("case_id").agg(F.min("symbol")))
    return dims.subset_bindings(facts, cases, selected, ["status", "reason", "cents"])
