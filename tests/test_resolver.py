"""Prompt resolution, graph expansion, blocks of history and the command line, on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from driftmap import cli
from driftmap.operators import anchors, render, resolve


def test_null_profile_tests(spark):
    df = spark.createDataFrame([("src/a.go",), ("Makefile",), (".env",), ("a.b/c",)], "p string")
    got = {r.p: r.t for r in df.select("p", resolve.test_candidates(F.col("p"), "null").alias("t")).collect()}
    assert got == {"src/a.go": ["src/a.test.go", "src/a.spec.go"], "Makefile": ["Makefile.test", "Makefile.spec"], ".env": [".env.test", ".env.spec"], "a.b/c": ["a.b/c.test", "a.b/c.spec"]}


NODES = [
    ("file:app/A.php", "file", "A.php", None, "app/A.php"), ("class:App\\A", "class", "A", "App\\A", "app/A.php"), ("class:App\\Jobs\\SendJob", "class", "SendJob", "App\\Jobs\\SendJob", "app/S.php"),
    ("file:lonely.php", "file", "lonely.php", None, "lonely.php"), ("event:E", "event", "E", None, None), ("file:tests/fixtures/x.php", "file", "x.php", None, "tests/fixtures/x.php"), ("file:app/B.php", "file", "B.php", None, None),
]
EDGES = [
    ("file:app/A.php", "class:App\\A", "defines"), ("class:App\\A", "event:E", "emits_event"), ("class:App\\Jobs\\SendJob", "event:E", "listens_to_event"), ("class:App\\A", "class:App\\Jobs\\SendJob", "dispatches_job"),
    ("class:App\\A", "file:app/B.php", "imports"), ("lonely", "event:E", "emits_event"), ("file:lonely.php", "file:app/B.php", "extends"), ("file:lonely.php", "file:tests/fixtures/x.php", "extends"),
]


@pytest.fixture(scope="module")
def code(spark):
    nodes = spark.createDataFrame(NODES, "key string, kind string, name string, fqcn string, file_path string")
    return nodes, spark.createDataFrame([(*e, "exact") for e in EDGES], "src string, dst string, kind string, confidence string")


def test_expand_graph_by_default_edges(spark, code):
    """A file stands for its class, whatever its confidence; strong symbols are searched for, weak ones are not."""
    a = [("p", "path", "app/A.php", "low", 1), ("p", "symbol", "SendJob", "low", 2), ("p", "symbol", "nothing", "high", 3), ("p", "path", "lonely.php", "medium", 4)]
    df = spark.createDataFrame(a, "prompt string, kind string, value string, confidence string, ord long")
    got = {(r.kind, r.value): (r.parent, r.edge_kind, r.confidence) for r in anchors.expand_graph(df, *code).collect()}
    assert got == {
        ("symbol", "class:App\\Jobs\\SendJob"): ("app/A.php", "dispatches_job", "low"),
        ("symbol", "event:E"): ("app/A.php", "emits_event", "low"),
        ("symbol", "class:App\\A"): ("SendJob", "dispatches_job", "low"),
        ("path", "app/B.php"): ("lonely.php", "extends", "low"),
    }


def test_history_blocks(spark):
    v = spark.createDataFrame([("a/x.php", 0.7, 0.9, 0.1, 0.0, 0.2), ("a/y.php", 0.39, 0.5, 0.5, 0.5, 1.0), ("tests/TestCase.php", 0.9, 1.0, 1.0, 1.0, 1.0)], "path string, risk_score double, churn double, bug_density double, ownership double, recency double")
    m = spark.createDataFrame([("a/y.php", "b/z.php", 0.6, 1), ("a/y.php", "b/w.php", 0.4, 2)], "anchor string, neighbor string, coupling double, rank int")
    r = spark.createDataFrame([("a/x.php", 2, 2.5), ("b/z.php", 1, 0.2)], "path string, reverts long, median_days double")
    t = spark.createDataFrame([(1, "a/x.php"), (1, "a/y.php"), (1, "tests/TestCase.php"), (2, "unknown"), (3, "b/z.php")], "prompt long, path string")
    head = "## Historical Signals\n"
    x, y, z = "- `a/x.php` — risk 0.70, high churn; reverted 2x (median 3d).", "- `a/y.php` — risk 0.39, recent activity and high churn; co-changes with z.php.", "- `b/z.php` — reverted 1x (median <1d)."
    assert {b.prompt: b.block for b in render.signals_block(t, v, m, r).collect()} == {1: f"{head}{x}\n{y}", 3: f"{head}{z}"}
    assert {b.prompt: b.block for b in render.signals_block(t, v, m, r, fallback=True, top=2).collect()}[2] == f"{head}{x}\n{y}"
    assert {b.prompt: b.block for b in render.signals_block(t, v, m, r, chars=len(head) + len(x)).collect()}[1] == f"{head}{x}"
    assert {b.prompt: b.block for b in render.volatility_block(t, v, fallback=True).collect()} == {p: "## Volatility\n- `a/x.php` — risk 0.70. High churn." for p in (1, 2, 3)}


def test_resolve_and_compare(spark, code):
    files = spark.createDataFrame([(f,) for f in ("app/orders/OrderList.php", "app/billing/InvoicePage.php", "app/orders/Helper.php", "app/A.php")], "path string")
    matrix = spark.createDataFrame([("app/A.php", "app/orders/Helper.php", 9, 0.9, 1)], "anchor string, neighbor string, joint long, coupling double, rank int")
    nodes = code[0].withColumn("roles", F.array().cast("array<string>"))
    repo = resolve.Repository(files=files, matrix=matrix, nodes=nodes, edges=code[1], include=["README.rst"])
    prompts = spark.createDataFrame([("one", "change app/A.php today"), ("two", "compare the order list screen now vs the invoice page screen then")], "prompt string, text string")
    got = resolve.resolve(prompts, repo, "2024-01-01").collect()
    one = {(r.kind, r.value): (r.source, r.confidence) for r in got if r.prompt == "one"}
    assert one["path", "app/A.php"] == ("explicit", "high") and one["path", "app/orders/Helper.php"] == ("cochange_expand", "medium")
    assert one["symbol", "event:E"] == ("graph_expand", "medium") and one["path", "README.rst"] == ("project_config", "high")
    assert [r.value for r in sorted((r for r in got if r.prompt == "one" and r.target_rank and r.kind == "path"), key=lambda r: r.target_rank)] == ["app/A.php", "app/orders/Helper.php"]
    two = {r.value for r in got if r.prompt == "two"}
    assert {"app/orders/OrderList.php", "app/billing/InvoicePage.php"} <= two
    assert len({(r.prompt, r.kind, r.value) for r in got}) == len(got)


def test_command_line(spark, code, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    data = str(tmp_path)
    code[0].write.parquet(f"{data}/nodes.parquet")
    code[1].write.parquet(f"{data}/edges.parquet")
    spark.createDataFrame([("app/A.php",), ("app/A.test.php",)], "path string").write.parquet(f"{data}/files.parquet")
    (tmp_path / "plan.json").write_text(json.dumps({"summary": "s", "steps": [{"files": ["app/A.php"]}]}))
    assert cli.main(["anchors", "--data", data, "--prompt", "look at app/A.php", "--json"]) == 0
    assert '"value":"app/A.php"' in capsys.readouterr().out
    assert cli.main(["validate-plan", "--data", data, "--plan", str(tmp_path / "plan.json"), "--json"]) == 0
    out = capsys.readouterr().out
    assert '"verdict":"revise"' in out and "app/A.test.php" in out and "app/S.php" in out
    assert cli.main(["graph-query", "--data", data, "--node", "SendJob"]) == 0
    assert "class:App\\Jobs\\SendJob" in capsys.readouterr().out
    assert cli.main(["query", "nothing", "--data", data]) == 2
