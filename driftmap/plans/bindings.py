"""The driver's tables as the engine's logical inputs.

C1: an order is a commit, its line items' parts are the files. C2: a customer is a commit, the
distinct names of the parts bought are the files. Events are commits with reverts, documents
are commit texts, foreign keys are the graph's edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.session import table

AS_OF = "1999-01-01 00:00:00"
#: Days are added to this date to make a document's commit time.
DOC_EPOCH = "2020-01-01"


def _ts(c: str):
    return F.col(c).cast("timestamp")


def commits1(spark: SparkSession, d: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    intent = F.when(first == "1", "fix").when(first == "2", "feat").otherwise("other")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), _ts("o_orderdate").alias("committed_at"), intent.alias("intent"))


def touches1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("file_ord"), F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"))


def work1(spark: SparkSession, d: str) -> DataFrame:
    """touches1 with author, time and intent of the commit."""
    return touches1(spark, d).join(commits1(spark, d), "commit_id")


def touches2(spark: SparkSession, d: str) -> DataFrame:
    o, li, p = (table(spark, d, t) for t in ("orders", "lineitem", "part"))
    named = li.select("l_orderkey", "l_partkey").join(p.select("p_partkey", "p_name"), li["l_partkey"] == p["p_partkey"])
    return named.join(o.select("o_orderkey", "o_custkey"), named["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("commit_id"), F.col("p_name").alias("path")).distinct()


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", _ts("ts").alias("ts"), "user_id", "event_type", "props")


def lexical_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths like type/Brand/partName.php, one for each distinct kind of part."""
    camel = F.regexp_replace("p_name", " ", "_")
    p = table(spark, d, "part").select(F.concat(F.regexp_replace("p_type", " ", "/"), F.lit("/"), F.regexp_replace("p_brand", "#", ""), F.lit("/"), camel, F.lit(".php")).alias("path"))
    return p.distinct()


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the foreign keys; what a line item ties to its order is inferred, the others are exact.

    Every line item ties its order to its supplier and to its part.
    """
    r, n, c, s, o, p = (table(spark, d, t) for t in ("region", "nation", "customer", "supplier", "orders", "part"))
    key = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))

    def node(df, kind, k, name):
        return df.select(key(kind, k).alias("key"), F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.concat(F.lit(f"{kind}."), F.col(name).cast("string")).alias("fqcn"), F.lit(None).cast("string").alias("file_path"))

    def edge(df, a, ac, b, bc, kind, confidence="exact"):
        return df.select(key(a, ac).alias("src"), key(b, bc).alias("dst"), F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"))

    li = table(spark, d, "lineitem")
    nodes = node(r, "region", "r_regionkey", "r_name").unionAll(node(n, "nation", "n_nationkey", "n_name")).unionAll(node(c, "customer", "c_custkey", "c_name")).unionAll(node(s, "supplier", "s_suppkey", "s_name"))
    edges = (
        edge(n, "nation", "n_nationkey", "region", "n_regionkey", "in_region")
        .unionAll(edge(c, "customer", "c_custkey", "nation", "c_nationkey", "lives_in"))
        .unionAll(edge(s, "supplier", "s_suppkey", "nation", "s_nationkey", "based_in"))
        .unionAll(edge(o, "order", "o_orderkey", "customer", "o_custkey", "placed_by"))
        .unionAll(edge(li.select("l_orderkey", "l_suppkey").distinct(), "order", "l_orderkey", "supplier", "l_suppkey", "shipped_by", "inferred"))
    )
    nodes = nodes.unionAll(node(p, "part", "p_partkey", "p_name")).unionAll(node(o, "order", "o_orderkey", "o_orderkey"))
    edges = edges.unionAll(edge(li.select("l_orderkey", "l_partkey").distinct(), "order", "l_orderkey", "part", "l_partkey", "contains", "inferred"))
    return nodes, edges


#: The same in DuckDB's SQL, by name; a query takes what it needs.
SQL = {
    "commits1": """SELECT o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS committed_at,
        CASE WHEN o_orderpriority LIKE '1%' THEN 'fix' WHEN o_orderpriority LIKE '2%' THEN 'feat' ELSE 'other' END AS intent FROM orders""",
    "touches1": """SELECT l_orderkey AS commit_id, l_partkey AS path, l_linenumber AS file_ord,
        CAST(trunc(l_quantity) AS BIGINT) AS additions, CAST(l_linenumber AS BIGINT) AS deletions FROM lineitem""",
    "work1": "SELECT t.*, author, committed_at, intent FROM touches1 t JOIN commits1 USING (commit_id)",
    "touches2": """SELECT DISTINCT o_custkey AS commit_id, p_name AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey""",
    "lexical_paths": """SELECT DISTINCT replace(p_type, ' ', '/') || '/' || replace(p_brand, '#', '') || '/' || replace(p_name, ' ', '_') || '.php' AS path FROM part""",
    "nodes": """SELECT 'region:' || r_regionkey AS key, 'region' AS kind, r_name AS name, 'region.' || r_name AS fqcn FROM region
        UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'nation.' || n_name FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'customer.' || c_name FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'supplier.' || s_name FROM supplier
        UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'part.' || p_name FROM part
        UNION ALL SELECT 'order:' || o_orderkey, 'order', CAST(o_orderkey AS VARCHAR), 'order.' || o_orderkey FROM orders""",
    "edges": """SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'in_region' AS kind, 'exact' AS confidence FROM nation
        UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'lives_in', 'exact' FROM customer
        UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'based_in', 'exact' FROM supplier
        UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', 'exact' FROM orders
        UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'shipped_by', 'inferred' FROM lineitem
        UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', 'inferred' FROM lineitem""",
}

def sql(names: str, body: str) -> str:
    """``body`` with the named bindings before it, as WITH clauses; a body may add its own."""
    heads = ", ".join(f"{n} AS ({SQL[n]})" for n in names.split())
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {heads}, {body[4:]}" if heads else body
    return f"WITH {heads} {body}" if heads else body
