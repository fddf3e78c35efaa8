"""Command line over saved tables: python -m driftmap.cli COMMAND --data FOLDER [...].

``anchors --prompt TEXT``, ``validate-plan --plan FILE`` and ``graph-query --node KEY`` answer for
one prompt, plan or node, from the tables files, classes, matrix, volatility, reverts, profiles,
nodes and edges (NAME.parquet) of the folder; a table that is missing is empty. Without these
options they and all other commands run a query over the driver's tables.
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.operators import graph, plan, render, resolve
from driftmap.plans import context, mining
from driftmap.session import clean, local_session

COMMANDS = {
    "cochange": "cochange_all",
    "volatility": "volatility_percentile",
    "revert-risk": "revert_path_stats",
    "complexity": "complexity_profile",
    "corpus": "corpus_stats",
    "graph": "graph_stats",
    "graph-query": "neighbors_pruned",
    "anchors": "resolve_prompts",
    "validate-plan": "plan_verdict",
    "brief": "brief_block",
    "benchmark": "bench_aggregate",
}
#: The saved tables and what an absent one would have.
SAVED = {
    "files": "path string",
    "classes": "symbol string, file_path string",
    "matrix": "anchor string, neighbor string, joint long, coupling double, rank int",
    "volatility": "path string, risk_score double",
    "reverts": "path string, reverts long, density double, last_reverted_at timestamp",
    "profiles": "path string, risk string",
    "nodes": "key string, kind string, name string, fqcn string, file_path string, roles array<string>",
    "edges": "src string, dst string, kind string, confidence string",
}


def saved_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    path = Path(folder) / f"{name}.parquet"
    return spark.read.parquet(str(path)) if path.exists() else spark.createDataFrame([], SAVED[name])


def one_prompt(spark: SparkSession, folder: str, prompt: str, as_of: str) -> DataFrame:
    """The ranked anchors of a prompt."""
    t = {n: saved_table(spark, folder, n) for n in ("files", "classes", "matrix", "nodes", "edges")}
    prompts = spark.createDataFrame([(0, prompt)], "prompt long, text string")
    found = resolve.resolve(prompts, resolve.Repository(**t), as_of)
    return found.drop("prompt").orderBy("rank")


def one_plan(spark: SparkSession, folder: str, text: str, as_of: str, profile: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Issues, verdict and suggested paths of a plan."""
    t = {n: saved_table(spark, folder, n) for n in SAVED}
    plans = spark.createDataFrame([(0, text)], "plan long, raw_text string")
    tests = resolve.test_candidates(F.col("path"), profile)
    return plan.validate(plans, t["files"], t["matrix"], t["volatility"], t["reverts"], t["profiles"], t["nodes"], t["edges"], [], tests, as_of, is_test=resolve.is_test(F.col("path")))


def one_node(spark: SparkSession, folder: str, node: str, hops: int, nodes: int, edges: int) -> DataFrame:
    """The neighbourhood of the best hit for ``node``, as text."""
    hit = graph.search(saved_table(spark, folder, "nodes"), spark.createDataFrame([(node,)], "query string"), 1)
    sub = graph.neighbourhood(saved_table(spark, folder, "edges"), hit.select(F.col("key").alias("center")), hops)
    return render.subgraph_block(graph.pruned(sub, nodes, edges))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftmap")
    p.add_argument("command", choices=[*COMMANDS, "query"])
    p.add_argument("name", nargs="?", help="a query's name, for the command query")
    p.add_argument("--data", required=True, help="folder of Parquet tables")
    p.add_argument("--prompt", help="a prompt to resolve")
    p.add_argument("--plan", help="a file with a plan, or - for standard input")
    p.add_argument("--node", help="a node's key or a part of its name")
    p.add_argument("--profile", choices=["null", "laravel", "ts"], default="null", help="where tests lie")
    p.add_argument("--as-of", default="2024-01-01 00:00:00", help="the time that counts as now")
    p.add_argument("--hops", type=int, choices=[1, 2], default=2)
    p.add_argument("--max-nodes", type=int, default=200)
    p.add_argument("--max-edges", type=int, default=500)
    p.add_argument("--limit", type=int, default=20, help="rows to print")
    p.add_argument("--json", action="store_true")
    return p


def _show(rows: DataFrame, limit: int, as_json: bool) -> None:
    rows = rows.limit(limit)
    if as_json:
        for r in rows.toJSON().toLocalIterator():
            print(r)
    else:
        rows.show(limit, truncate=120)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = local_session()
    try:
        if a.command == "anchors" and a.prompt is not None:
            _show(one_prompt(spark, a.data, a.prompt, a.as_of), a.limit, a.json)
        elif a.command == "validate-plan" and a.plan is not None:
            text = sys.stdin.read() if a.plan == "-" else Path(a.plan).read_text()
            issues, verdict, suggested = one_plan(spark, a.data, text, a.as_of, a.profile)
            _show(verdict.drop("plan"), 1, a.json)
            _show(issues.select("rank", "severity", "confidence", "checker", "message", "evidence").orderBy("rank"), a.limit, a.json)
            _show(suggested.select("path", "level").orderBy(F.desc("level"), "path"), a.limit, a.json)
        elif a.command == "graph-query" and a.node is not None:
            for r in one_node(spark, a.data, a.node, a.hops, a.max_nodes, a.max_edges).collect():
                print(r.block)
        else:
            found = mining.QUERIES | context.QUERIES
            name = a.name if a.command == "query" else COMMANDS[a.command]
            if name not in found:
                print(f"no such query; there are: {', '.join(sorted(found))}", file=sys.stderr)
                return 2
            _show(found[name](spark, a.data), a.limit, a.json)
    finally:
        clean(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
