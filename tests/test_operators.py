"""Operators on tiny tables: thresholds on both sides, ties, empty input."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from driftmap.functions import text
from driftmap.operators import anchors, benchmark, cochange, complexity, corpus, extract, graph, plan, render, retrieval, reverts, volatility
from driftmap.sources import cache, files, git
from driftmap.streaming import pairs

DAY0 = dt.datetime(2024, 1, 1)


def at(days):
    return DAY0 + dt.timedelta(days=days)


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


# --- functions


@pytest.mark.parametrize("word, stem", [("cats", "cat"), ("bus", "bus"), ("policies", "policy"), ("running", "runn"), ("nations", "nation"), ("operations", "oper"), ("es", "es"), ("quickly", "quick"), ("baker", "bak")])
def test_stem(spark, word, stem):
    assert one(spark, text.stem, word) == stem


def test_globs_differ_in_the_slash(spark):
    match = lambda p, s: spark.createDataFrame([(s,)], "x string").where(F.col("x").rlike(p)).count() == 1
    assert match(text.glob_swallow("app/**/x.php"), "app/x.php") and not match(text.glob_plain("app/**/x.php"), "app/x.php")
    assert match(text.glob_plain("app/**/x.php"), "app/a/b/x.php") and match(text.glob_swallow("*.md"), "a.md") and not match(text.glob_swallow("*.md"), "a/b.md")
    assert not match(text.glob_swallow("a?c"), "a/c") and not match(text.glob_swallow("*.md"), "a.md\n")


def test_tokenizers(spark):
    assert one(spark, text.prompt_tokens, "Fix the CartTotals rounding!") == ["carttotal", "round"]
    assert one(spark, text.corpus_tokens, "fix: HTTPServer in app/CartTotal.php") == ["fix:", "http", "server", "app", "cart", "total"]
    assert one(spark, lambda c: text.path_tokens(c)[0], "src/http/cartTotals.test.ts") == ["src", "http", "cart", "total", "test"]
    assert one(spark, lambda c: text.path_tokens(c)[1], "src/http/cartTotals.php") == ["cart", "total"]
    assert one(spark, text.prompt_tokens, None) == []


@pytest.mark.parametrize("raw, path", [("`./app//X.php`", "app/X.php"), ("C:\\app\\X.php", "app/X.php"), ("'/a/b/'", "a/b"), ("./././a", "a")])
def test_normal_path(spark, raw, path):
    assert one(spark, text.normal_path, raw) == path


def test_subjects(spark):
    s = one(spark, text.subjects, "differences between the old cart totals and the new cart totals page")
    assert [x["text"] for x in s] == ["the old cart totals", "the new cart totals page"] and s[0]["label"] == "old cart totals"
    assert len(one(spark, text.subjects, "cart vs order")) == 1
    assert len(one(spark, text.subjects, "member login page flow vs admin login page flow")) == 2
    assert one(spark, text.subjects, "plain words only")[0]["text"] == "plain words only"


def test_mentions(spark):
    m = {(x["kind"], x["value"]) for x in one(spark, text.mentions, "see app/Cart.php, App\\Models\\Cart and CartTotal::sum twice: app/Cart.php")}
    assert m == {("path", "app/Cart.php"), ("fqcn", "App\\Models\\Cart"), ("method", "CartTotal::sum"), ("class", "CartTotal")}


# --- corpus

COMMIT = "sha string, parent_shas array<string>, author string, author_email string, committed_at timestamp, subject string, body string, files array<string>, additions long, deletions long, per_file array<struct<path:string,additions:long,deletions:long>>, ord long"


def commit(sha, subject="feat: x", author="ana", email="a@b.c", parents=("p",), files_=("a.php",), add=1, dele=1, day=0, body="", ord_=0, per=None):
    return (sha, list(parents), author, email, at(day), subject, body, list(files_), add, dele, per, ord_)


def test_filter_cascade(spark):
    rows = [
        (commit("m" * 7, parents=("p", "q"), author="dependabot"), "merge_commit"),
        (commit("b" * 7, author="x[bot]"), "bot_author"),
        (commit("c" * 7, email="renovate[bot]@x"), "bot_author"),
        (commit("n" * 7, subject=" WIP. "), "noise_subject"),
        (commit("n1" * 4, subject="wip: more"), None),
        (commit("f" * 7, files_=[f"f{i}" for i in range(51)]), "mega_files"),
        (commit("g" * 7, files_=[f"f{i}" for i in range(50)]), None),
        (commit("l" * 7, add=1500, dele=501), "mega_lines"),
        (commit("k" * 7, add=1500, dele=500), None),
        (commit("d" * 7, files_=["README.md", "docs/x.png"]), "docs_only"),
        (commit("e" * 7, files_=["composer.lock", "sub/package.json"]), "dependency_churn"),
        (commit("h" * 7, files_=[]), None),
    ]
    df = spark.createDataFrame([r for r, _ in rows], COMMIT)
    got = {r.sha: r.reason for r in corpus.with_reason(df).collect()}
    assert got == {r[0]: why for r, why in rows}
    assert corpus.build_corpus(df).count() == 4
    stats = {(r.kind, r.name): r.n for r in corpus.corpus_stats(df).collect()}
    assert stats["total", "all"] == 12 and stats["kept", "all"] == 4 and stats["excluded", "bot_author"] == 2


@pytest.mark.parametrize(
    "subject, intent",
    [("feature(a): b", "feat"), ("weird: fix it", "fix"), ("Revert \"x\"", "revert"), ("Merged in hotfix/1 (pull)", "fix"), ("Merged in dev/1 build", "build"), ("refactor and fix", "fix"), ("  ", "other"), ("feat!: x", "feat"), ("prefix only", "other")],
)
def test_intent(spark, subject, intent):
    assert one(spark, corpus.intent, subject) == intent


def test_body_digest_ignores_trailers(spark):
    a = one(spark, corpus.normal_body, "one  \r\ntwo\n\nCo-Authored-By: X <x@y>\n\n")
    assert a == "one\ntwo"
    assert one(spark, corpus.body_digest, "one\ntwo") == one(spark, corpus.body_digest, "one  \r\ntwo\nSigned-off-by: x\n")


def test_window_and_ticket(spark):
    df = spark.createDataFrame([commit("a" * 7, day=0, subject="AB-1 x"), commit("b" * 7, day=5, subject="x", body="see CD-22")], COMMIT)
    assert [r.sha for r in corpus.window(df, at(0), at(0)).collect()] == ["a" * 7]
    assert {r.ticket_id for r in corpus.build_corpus(df).collect()} == {"AB-1", "CD-22"}


# --- co-change


def baskets(spark, *sets):
    return spark.createDataFrame([(i, p) for i, s in enumerate(sets) for p in s], "commit_id long, path string")


def test_co_change_thresholds(spark):
    t = baskets(spark, "ab", "ab", "ab", "a", "a", "a", "a", "a", "a", "a", "b", "b", "b", "b", "b", "b", "b", "cd", "cd")
    got = cochange.couplings(t, 3, 0.3).collect()
    assert [(r.a, r.b, r.joint, r.coupling) for r in got] == [("a", "b", 3, 0.3)]
    assert cochange.couplings(t, 3, 0.31).count() == 0 and cochange.couplings(t, 4, 0.1).count() == 0
    assert cochange.co_change(t.where("false")).count() == 0


def test_co_change_top_k_and_sets(spark):
    t = baskets(spark, *[[*"abcdefghijklm", "a", "vendor/x"]] * 3)
    m = cochange.co_change(t, top_k=10)
    rows = m.where("anchor = 'a'").orderBy("rank").collect()
    assert [r.neighbor for r in rows] == list("bcdefghijk") and {r.joint for r in rows} == {3}
    assert m.where("anchor = 'vendor/x' OR neighbor = 'vendor/x'").count() == 0
    big = baskets(spark, *[[f"p{i:02d}" for i in range(51)]] * 3)
    assert cochange.co_change(big).count() == 0 and cochange.co_change(big, max_files=51).count() > 0


# --- volatility


@pytest.mark.parametrize("n, expected", [(1, 0), (19, 18), (20, 19), (21, 19)])
def test_floor_percentile(spark, n, expected):
    assert volatility.floor_percentile(spark.range(n), "id", 0.95, "p").first().p == expected


def test_floor_percentile_empty(spark):
    assert volatility.floor_percentile(spark.range(0), "id", 0.95, "p").first().p == 0


def test_volatility_score(spark):
    rows = [("x", f"u{i % 2}", at(i), "fix", 1, 1) for i in range(6)] + [("y", "u", at(0), "feat", 5, 0)]
    t = spark.createDataFrame(rows, "path string, author string, committed_at timestamp, intent string, additions long, deletions long")
    v = {r.path: r for r in volatility.volatility(t, str(at(10))).collect()}
    assert v["x"].churn == 1 and v["x"].bug_density == pytest.approx(6 / 11) and v["x"].ownership == pytest.approx(0.75) and v["x"].dampener == 1
    assert v["y"].dampener == pytest.approx(0.2) and v["y"].ownership == 0
    assert v["x"].raw_risk == pytest.approx(0.35 + 0.3 * 6 / 11 + 0.15 * 0.75 + 0.2) and v["x"].risk_score == 1


def test_delta_attribution(spark):
    rows = [(1, "a", at(0), "fix", ["p", "q"], 5, 4, None), (2, "a", at(0), "fix", ["p", "q"], 5, 4, [("p", 3, 1)])]
    c = spark.createDataFrame(rows, "commit_id long, author string, committed_at timestamp, intent string, files array<string>, additions long, deletions long, per_file array<struct<path:string,additions:long,deletions:long>>")
    got = {(r.commit_id, r.path): (r.additions, r.deletions) for r in volatility.deltas(c).collect()}
    assert got == {(1, "p"): (3, 2), (1, "q"): (3, 2), (2, "p"): (3, 1), (2, "q"): (0, 0)}


# --- reverts


def history(spark, rows):
    df = spark.createDataFrame([commit(s, subject=sub, body=b, day=d, ord_=o, files_=f) for o, (s, sub, b, d, f) in enumerate(rows)], COMMIT)
    return corpus.build_corpus(df, corpus.FilterConfig(exclude_docs_only=False))


def test_revert_cascade_and_chain(spark):
    c = history(
        spark,
        [
            ("aaaaaaa1", "feat: cart", "one", 0, ["x.php", "vendor/y"]),
            ("bbbbbbb2", 'Revert "feat: cart"', "This reverts commit aaaaaaa1.", 2, ["x.php"]),
            ("ccccccc3", 'Revert "Revert "feat: cart""', "again", 5, ["x.php"]),
            ("ddddddd4", 'Revert "never was"', "nobody", 6, ["z.php"]),
            ("eeeeeee5", "revert: something", "one", 7, ["z.php"]),
        ],
    )
    links = {r.revert_sha: (r.reverted_sha, r.resolution, r.days_to_revert) for r in reverts.revert_links(c).collect()}
    assert links == {"bbbbbbb2": ("aaaaaaa1", "sha", 2.0), "ccccccc3": ("bbbbbbb2", "subject", 3.0), "ddddddd4": (None, "unresolved", None), "eeeeeee5": ("aaaaaaa1", "digest", 7.0)}
    lk = reverts.revert_links(c).select(F.col("revert_sha").alias("id"), F.col("reverted_sha").alias("target"), F.col("reverted_at").alias("ts"), F.col("days_to_revert").alias("days"))
    ch = reverts.chains(lk)
    assert [(r.id, r.role) for r in ch.orderBy("step").collect()] == [("aaaaaaa1", "original"), ("bbbbbbb2", "revert"), ("ccccccc3", "reapply")]
    assert reverts.chain_summary(ch).first()[1:] == (3, True)
    t = c.select(F.col("sha").alias("commit_id"), F.explode("files").alias("path"))
    s = {r.path: r for r in reverts.path_stats(t, lk, ch).collect()}
    assert set(s) == {"x.php"} and s["x.php"].reverts == 3 and s["x.php"].commits == 3 and s["x.php"].median_days == 3 and s["x.php"].chains == 1


def test_latest_before_is_strict(spark):
    e = spark.createDataFrame([("k", 1, at(5)), ("k", 2, at(0)), ("z", 3, at(9))], "key string, id long, ts timestamp")
    c = spark.createDataFrame([("k", 10, at(5), 0), ("k", 11, at(4), 2), ("k", 12, at(4), 1)], "key string, id long, ts timestamp, ord long")
    assert {r.id: r.found for r in reverts.latest_before(e, c, ["key"]).collect()} == {1: 12, 2: None, 3: None}


# --- retrieval


def test_bm25_prefers_the_rarer_word(spark):
    d = spark.createDataFrame([("a", ["cart", "total"]), ("b", ["cart", "cart", "page"]), ("c", ["page"])], "doc string, tokens array<string>")
    p = spark.createDataFrame([("q", ["total", "cart"])], "prompt string, tokens array<string>")
    got = {r.doc: r.bm25 for r in retrieval.bm25(d, p).collect()}
    assert set(got) == {"a", "b"} and got["a"] > got["b"]


def test_lexical_weights_and_cap(spark):
    paths = spark.createDataFrame([("cart/total.php",), ("total/cart.php",), ("cart/x.php",), ("database/migrations/cart.php",)], "path string")
    q = spark.createDataFrame([("q", "cart")], "prompt string, token string")
    got = retrieval.lexical(q, paths).orderBy("rank").collect()
    assert [(r.path, r.score, r.confidence) for r in got] == [("total/cart.php", 2, "medium"), ("cart/total.php", 1, "low"), ("cart/x.php", 1, "low")]


def test_synonyms_are_not_transitive(spark):
    g = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2)], "token string, grp int")
    p = spark.createDataFrame([("q", ["a"])], "prompt string, tokens array<string>")
    assert {r.token for r in retrieval.with_synonyms(p, g).collect()} == {"a", "b"}


# --- graph

E = "src string, dst string, kind string, confidence string"


def test_neighbourhood(spark):
    e = spark.createDataFrame([("a", "b", "k", "exact"), ("b", "c", "k", "exact"), ("c", "d", "k", "exact"), ("c", "e", "k", "inferred"), ("a", "a", "loop", "exact"), ("c", "f", "k", "exact"), ("f", "b", "k", "exact")], E)
    c = spark.createDataFrame([("a",)], "center string")
    assert {(r.src, r.dst) for r in graph.neighbourhood(e, c, 1).collect()} == {("a", "b"), ("a", "a")}
    assert {(r.src, r.dst) for r in graph.neighbourhood(e, c, 2).collect()} == {("a", "b"), ("a", "a"), ("b", "c"), ("f", "b")}
    assert graph.neighbourhood(e, c, 2, confidence=["inferred"]).count() == 0


def test_prune_keeps_centre_and_larger_keys(spark):
    sub = spark.createDataFrame([("a", "a", x, "k", "exact") for x in "bcd"], f"center string, {E}")
    got = graph.pruned(sub, 3, 10).collect()
    assert {r.dst for r in got} == {"c", "d"} and all(r.truncated for r in got)


def test_search_tiers(spark):
    n = spark.createDataFrame([("class:A\\Cart", "A\\Cart", "Cart"), ("class:A\\CartLine", "A\\CartLine", "CartLine"), ("x", "y", "MyCart")], "key string, fqcn string, name string")
    got = graph.search(n, spark.createDataFrame([("cart",)], "query string")).orderBy("rank").collect()
    assert [(r.key, r.tier) for r in got] == [("class:A\\Cart", 2), ("class:A\\CartLine", 4), ("x", 5)]


def test_edges_dedup_and_roles(spark):
    e = spark.createDataFrame([("a", "b", "k", "inferred"), ("a", "b", "k", "exact")], E)
    assert graph.dedup_edges(e).first().confidence == "exact"
    n = spark.createDataFrame([("k", "app/Http/X.php")], "key string, file_path string")
    assert {r.role for r in graph.tag_roles(n, [("app/**", ["a", "b"]), ("lib/**", ["c"])]).collect()} == {"a", "b"}


# --- anchors

A = "prompt string, kind string, value string, source string, confidence string, evidence array<string>, support long, ord long"


def test_expansion_is_greedy(spark):
    a = spark.createDataFrame([("q", "path", "p1", "explicit", "high", ["e"], 0, 0), ("q", "path", "p2", "lexical", "medium", ["e"], 0, 1), ("q", "path", "p3", "lexical", "low", ["e"], 0, 2)], A)
    m = spark.createDataFrame([("p1", "n1", 0.9, 1), ("p1", "p2", 0.8, 2), ("p1", "n2", 0.7, 3), ("p2", "n1", 0.9, 1), ("p2", "n3", 0.6, 2), ("p2", "n4", 0.4, 3), ("p3", "n9", 0.9, 1)], "anchor string, neighbor string, coupling double, rank int")
    got = anchors.expand_co_change(a, m, per_anchor=2).orderBy("place", "value").collect()
    assert [(r.parent, r.value, r.confidence) for r in got] == [("p1", "n1", "medium"), ("p1", "n2", "medium"), ("p2", "n3", "low")]


def test_rank_and_caps(spark):
    rows = [("q", "path", f"p{i:02d}", "lexical", "medium", ["x"], 0, i) for i in range(12)]
    rows += [("q", "path", "p00", "explicit", "medium", ["y"], 0, 20), ("q", "path", "low", "explicit", "low", ["z"], 0, 21), ("q", "symbol", "S", "explicit", "high", ["z"], 0, 22), ("q", "path", "README.md", "explicit", "high", ["z"], 0, 23)]
    r = {x.value: x for x in anchors.rank(spark.createDataFrame(rows, A)).collect()}
    assert r["S"].rank == 1 and r["p00"].rank == 2 and r["p00"].source == "explicit" and r["p00"].evidence == ["x", "y"]
    assert sum(x.target_rank is not None and x.kind == "path" for x in r.values()) == 10 and r["low"].target_rank is None and "README.md" not in r


def test_graph_expansion(spark):
    a = spark.createDataFrame([("q", "symbol", "A", "explicit", "high", ["e"], 0, 0), ("q", "symbol", "B", "explicit", "medium", ["e"], 0, 1)], A)
    e = spark.createDataFrame([("A", f"n{i}", "calls", "exact") for i in range(7)] + [("n0", "B", "calls", "exact"), ("B", "m", "calls", "exact"), ("B", "A", "calls", "exact")], E)
    got = anchors.expand_graph(a, e, ["calls"]).collect()
    assert sum(r.parent == "A" for r in got) == 5 and {r.value for r in got if r.parent == "B"} == {"m"}


def test_boosts(spark):
    d = spark.createDataFrame([(["admin"], ["login"]), (["auth"], ["login"]), ([], ["login"])], "roles array<string>, words array<string>")
    hints = {"auth": ["login"], "admin": ["console"]}
    assert [r[0] for r in d.select(anchors.role_boost(F.col("words"), F.col("roles"), hints)).collect()] == [0.85, 1.4, 1.0]
    assert spark.range(1).select(anchors.clamp(F.lit(2.0)), anchors.clamp(F.lit(0.1))).first()[:] == (1.5, 0.7)


# --- complexity and plans


def test_profile(spark):
    f = spark.createDataFrame([("a", 300, 31, 6, 10), ("b", 299, 1, 1, 1), ("c", 600, 1, 1, 1)], "path string, lines int, cyclomatic int, nesting int, longest_method int")
    v = spark.createDataFrame([("b", 15, 0.4, 0.7), ("c", 15, 0.4, 0.1)], "path string, commits long, bug_fix_density double, risk_score double")
    r = spark.createDataFrame([("zz", 1)], "path string, reverts long")
    got = {x.path: (x.risk, x.signals) for x in complexity.profile(f, v, r).collect()}
    assert got["a"][0] == "high" and got["b"] == ("medium", ["high_churn", "bug_prone", "high_risk"]) and got["c"][0] == "high"
    assert complexity.hint(complexity.profile(f, v, r)).count() == 3


def test_plan_parse(spark):
    j = '{"summary": "do App\\\\Cart", "steps": [{"description": "edit app/B.php", "files": ["./app/A.php", null]}, {}], "riskFlags": ["x"]}'
    rows = {r.plan: r for r in plan.parse(spark.createDataFrame([(1, j), (2, "change app/C.php"), (3, ""), (4, "{bad")], "plan long, raw_text string")).collect()}
    assert rows[1].files == ["app/A.php", "app/B.php"] and rows[1].is_json and rows[1].risk_flags == ["x"] and rows[1].listed == ["app/A.php"]
    j = '{"summary": "Use App\\\\Models\\\\Cart and CartService, then Check OrderJob", "riskFlags": ["app/Z.php"]}'
    assert plan.parse(spark.createDataFrame([(1, j)], "plan long, raw_text string")).first().symbols == ["Cart", "Models", "CartService", "OrderJob"][:2] + ["CartService", "OrderJob"]
    assert rows[2].files == ["app/C.php"] and rows[3].files == [] and not rows[4].is_json


def issue(plan_, checker, severity, confidence, disc, kind="k"):
    return (plan_, checker, kind, severity, confidence, disc, disc if checker == "rule" else None, f"m {disc}", [disc])


I = "plan long, checker string, kind string, severity string, confidence double, discriminator string, rule string, message string, paths array<string>"  # noqa: E741


def test_verdicts(spark):
    rows = [issue(1, "cochange", "critical", 0.5, "a"), issue(2, "cochange", "warning", 0.4, "a"), issue(2, "missing-test", "warning", 0.8, "b"), issue(3, "cochange", "warning", 0.8, "a"), issue(3, "cochange", "warning", 0.8, "b")]
    # any warning counts, whatever its confidence, but a rule's below .9
    rows += [issue(4, "revert", "warning", 0.6, x) for x in "abc"] + [issue(5, "rule", "warning", 0.7, x, "rule_risk") for x in "abcd"]
    rows += [issue(7, "rule", "warning", 0.9, x, "rule_risk") for x in "abc"] + [issue(8, "revert", "warning", 0.6, "a"), issue(8, "missing-test", "warning", 0.8, "b")]
    plans = spark.createDataFrame([(i,) for i in range(1, 9)], "plan long")
    got = {r.plan: r.verdict for r in plan.verdicts(plans, plan.dedup_sort(spark.createDataFrame(rows, I))).collect()}
    assert got == {1: "revise", 2: "revise", 3: "pass", 4: "revise", 5: "pass", 6: "pass", 7: "revise", 8: "pass"}
    lenient = plan.verdicts(plans, spark.createDataFrame(rows, I), lambda: F.when(F.col("criticals") > 0, "stop").otherwise("go"))
    assert {r.plan: r.verdict for r in lenient.collect()} == {i: "stop" if i == 1 else "go" for i in range(1, 9)}


def test_dampen_suppress_dedup(spark):
    names = ["app/a.php", "app/b.php", "app/Cart.php", "app/sub/123.php", "app/12.php"]
    i = spark.createDataFrame([issue(1, "cochange", "critical", 1.0, n) for n in names] + [issue(1, "rule", "warning", 0.5, r) for r in ("rule-x", "rule-x", "rule-y", "r1")] + [issue(1, "revert", "warning", 0.6, "k", "revert_risk"), issue(2, "revert", "warning", 0.6, "k", "revert_risk")], I)
    # a path, a class, a rule and a kind are named; app/12 is no name for app/12.php, nor r1 for a rule
    flags = spark.createDataFrame([(1, "app/a.php is one, Cart too"), (1, "see RULE-X and revert_risk, app/12 and r1")], "plan long, flag string")
    quiet = spark.createDataFrame([(1, "path", "app/b.php"), (1, "rule", "rule-y"), (2, "kind", "revert_risk")], "plan long, what string, value string")
    got = {(r.plan, r.discriminator): r.severity for r in plan.dedup_sort(plan.suppress(plan.dampen(i, flags), quiet)).collect()}
    assert got == {(1, "app/a.php"): "info", (1, "app/Cart.php"): "info", (1, "app/sub/123.php"): "critical", (1, "app/12.php"): "critical", (1, "rule-x"): "info", (1, "r1"): "warning", (1, "k"): "info"}


def test_rerun_selection_caps(spark):
    rows = [issue(1, c, "warning", 0.5, f"{c}{i}") for c in ("cochange", "missing-test", "revert") for i in range(5)]
    got = plan.rerun_selection(plan.dedup_sort(spark.createDataFrame(rows, I))).collect()
    assert len(got) == 8 and max(sum(r.checker == c for r in got) for c in ("cochange", "missing-test", "revert")) == 3


def test_validate_end_to_end(spark):
    planned = '{"summary": "s", "steps": [{"description": "d", "files": ["app/Cart.php"]}]}'
    plans = spark.createDataFrame([(1, planned), (2, "")], "plan long, raw_text string")
    repo = spark.createDataFrame([("tests/CartTest.php",)], "path string")
    matrix = spark.createDataFrame([("app/Cart.php", "app/Total.php", 0.9, 6, 1)], "anchor string, neighbor string, coupling double, joint long, rank int")
    risk = spark.createDataFrame([("app/Cart.php", 0.8), ("app/Total.php", 0.9)], "path string, risk_score double")
    rv = spark.createDataFrame([("app/Cart.php", 2, 0.2, at(0))], "path string, reverts long, density double, last_reverted_at timestamp")
    prof = spark.createDataFrame([("app/Cart.php", "high")], "path string, risk string")
    nodes = spark.createDataFrame([("class:Cart", "app/Cart.php"), ("job:Send", "app/Send.php")], "key string, file_path string")
    edges = spark.createDataFrame([("class:Cart", "job:Send", "dispatches_job")], "src string, dst string, kind string")
    rules = [{"id": "r", "globs": ["app/**"], "tags": ["security"]}]
    tests = F.array(F.regexp_replace("path", r"^app/(\w+)\.php$", "tests/$1Test.php"))
    issues, verdict, suggested = plan.validate(plans, repo, matrix, risk, rv, prof, nodes, edges, rules, tests, str(at(100)))
    rows = issues.collect()
    assert {r.checker for r in rows if r.plan == 1} == set(plan.CHECKERS) and [r.kind for r in rows if r.plan == 2] == ["validation_limited"]
    found = {r.checker: (r.kind, r.severity, r.confidence, r.discriminator, r.paths) for r in rows if r.plan == 1}
    assert found == {
        "missing-test": ("missing_test", "warning", 0.8, "app/Cart.php", ["tests/CartTest.php"]),
        "cochange": ("co_change_gap", "critical", 0.85, "app/Total.php", ["app/Cart.php"]),
        "revert": ("revert_risk", "critical", 0.85, "app/Cart.php", ["app/Cart.php"]),
        "rule": ("rule_risk", "warning", 0.7, "r:app/Cart.php", ["app/Cart.php"]),
        "structural-gap": ("structural_gap", "warning", 0.6, "app/Send.php", ["app/Send.php"]),
        "complexity": ("structural_gap", "warning", 0.7, "app/Cart.php", ["app/Cart.php"]),
    }
    assert {r.plan: r.verdict for r in verdict.collect()} == {1: "revise", 2: "pass"}
    assert {r.path: r.level for r in suggested.collect()} == {"app/Total.php": 0, "app/Send.php": 1, "tests/CartTest.php": 1, "app/Cart.php": 2}
    assert plan.by_path(issues).where("path = 'app/Cart.php'").first().ranks == sorted(r.rank for r in rows if r.plan == 1 and "app/Cart.php" in r.paths)
    back = render.rerun_prompt(plan.rerun_selection(issues), suggested, plans).collect()
    assert len(back) == 1 and "app/Total.php" in back[0].feedback


# --- benchmark


def test_evaluate(spark):
    s = spark.createDataFrame([("s",), ("t",)], "sample string")
    p = spark.createDataFrame([("s", "a", 1), ("s", "b", 2)], "sample string, path string, rank int")
    t = spark.createDataFrame([("s", "a"), ("s", "c"), ("s", "d"), ("s", "e"), ("t", "a")], "sample string, path string")
    got = {r.sample: (r.p5, r.r5) for r in benchmark.evaluate(s, p, t, (5,)).collect()}
    assert got == {"s": (0.5, 0.25), "t": (0.0, 0.0)}


def test_holdout_leaves_out_the_day(spark):
    c = spark.createDataFrame([(1, at(0)), (2, at(0)), (3, at(1))], "commit_id long, committed_at timestamp")
    t = baskets(spark, "", "ab", "ab", "ab")
    seeds = spark.createDataFrame([("s", at(0).date(), "a"), ("u", at(1).date(), "a")], "sample string, day date, seed string")
    got = {r.sample: (r.path, r.joint) for r in benchmark.held_out_neighbours(c, t, seeds).collect()}
    assert got == {"s": ("b", 1), "u": ("b", 2)}


# --- sources


def test_git_readers(spark, tmp_path):
    rec = lambda *f: "\x1f".join(f)
    meta = "\0".join([rec("a" * 40, "", "Ana", "a@x", "2024-01-02T03:04:05+02:00", "sub", "sub\r\n\r\nbody\n\n"), rec("b" * 40, "p q", "Bo", "b@x", "2024-01-01T00:00:00Z", "two", "x\x1fy"), rec("short", "", "", "", "2024-01-01T00:00:00Z", "", ""), rec("c" * 40, "", "", "", "bad", "", ""), "few"])
    (tmp_path / "m").write_text(meta + "\0")
    (tmp_path / "n").write_text("CM" + "a" * 40 + "\n\n3\t1\tsrc/a\tb.php\n-\t-\timg.png\nnoise\nCM" + "d" * 40 + "\n1\t1\tx\n")
    c = {r.sha[0]: r for r in git.read_commits(spark, str(tmp_path / "m"), str(tmp_path / "n")).collect()}
    assert set(c) == {"a", "b"} and c["a"].parent_shas == [] and c["b"].parent_shas == ["p", "q"] and c["b"].body == "x\x1fy"
    assert c["a"].body == "sub\n\nbody" and c["a"].committed_at == dt.datetime(2024, 1, 2, 1, 4, 5)
    assert c["a"].files == ["src/a\tb.php", "img.png"] and (c["a"].additions, c["a"].deletions) == (3, 1) and c["b"].files == [] and c["b"].additions == 0
    assert c["a"].ord < c["b"].ord


def test_git_args():
    assert "--since=2024-01-01" in git.log_args("meta", "2024-01-01") and "--first-parent" in git.log_args("numstat")


def test_rules_and_config(tmp_path):
    (tmp_path / "a.mdc").write_text("---\nid: r1\ntitle: T\nstate: approved\nconfidence: high\nseverity: warning\ntags: [security, x]\nappliesTo:\n  - validator\nscope:\n  globs:\n    - app/**\n    - 'b/*.php'\n---\nGuidance\n")
    (tmp_path / "b.mdc").write_text("---\nid: r2\n---\n")
    (tmp_path / "c.mdc").write_text("---\nid: r3\ntitle: T\nstate: experimental\nconfidence: low\nseverity: info\n---\n")
    with pytest.warns(UserWarning):
        rules = files.load_rules([str(tmp_path), str(tmp_path)])
    assert [r["id"] for r in rules] == ["r1"] and rules[0]["globs"] == ["app/**", "b/*.php"] and rules[0]["tags"] == ["security", "x"] and rules[0]["applies_to"] == ["validator"] and rules[0]["guidance"] == "Guidance"
    (tmp_path / "driftmap.config.json").write_text('{"unknown": 1}')
    with pytest.warns(UserWarning):
        assert files.load_config(str(tmp_path)) == {}
    (tmp_path / "driftmap.config.json").write_text('{"pathStopwords": ["x"], "profileOverride": "ts"}')
    assert files.detect_profile(str(tmp_path), files.load_config(str(tmp_path))) == "ts"


def test_files_and_workspaces(spark, tmp_path):
    for p in ("app/A.php", "node_modules/x.ts", "packages/one/src/b.ts", ".hidden/c.ts"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"// {p}\n")
    (tmp_path / "package.json").write_text('{"workspaces": ["packages/*"]}')
    assert files.list_files(str(tmp_path)) == ["app/A.php", "packages/one/src/b.ts"]
    assert files.workspaces(str(tmp_path)) == ["packages/one"]
    got = {r.path: r.source for r in files.read_sources(spark, str(tmp_path)).collect()}
    assert got["app/A.php"] == "// app/A.php\n" and "node_modules/x.ts" not in got


def test_cache(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert cache.cached(spark, str(tmp_path), "abc123456", "2024-01-01T10:00:00", build).count() == 3
    assert len(built) == 1 and cache.cache_key("abc123456", "2024-01-01") == cache.cache_key("abc123456", "2024-01-01T23:00")
    for i in range(7):
        os.makedirs(tmp_path / f"key=k{i}")
    assert len(cache.prune(str(tmp_path), "k0")) >= 2 and (tmp_path / "key=k0").exists()
    with pytest.warns(UserWarning):
        s = files.load_signals(spark, {"a": str(tmp_path / "none"), "b": str(tmp_path / f"key={cache.cache_key('abc123456', '2024-01-01')}")})
    assert s["a"] is None


# --- scanners

PHP = r"""<?php
namespace App\Http\Controllers;
use App\Models\Order as O;
use App\Jobs\Ship;
// class Hidden {}
class OrderController extends Base implements Shows, \Other\Thing
{
    use Logs;
    public function store(StoreOrderRequest $request, O $order)
    {
        if ($request->ok() && true) { foreach ($a as $b) { Ship::dispatch($order); } }
        $this->save(); self::load(); $order->total(); event(new OrderPlaced($order)); Event::dispatch(new Seen());
        throw new NotFound("x { y");
    }
}
Route::get('/parcels/{key}', [OrderController::class, 'store']);
Route::post('orders', 'OrderController@store');
"""


def test_scan_php():
    nodes, edges = extract.scan_php("app/Http/Controllers/OrderController.php", PHP)
    c = "App\\Http\\Controllers"
    keys = {n[0] for n in nodes}
    assert {f"class:{c}\\OrderController", f"method:{c}\\OrderController::store", "route:GET /parcels/{key}", "route:POST /orders"} <= keys and not any("Hidden" in k for k in keys)
    e = {x[:3] for x in edges}
    m = f"method:{c}\\OrderController::store"
    assert (f"class:{c}\\OrderController", f"class:{c}\\Base", "extends") in e
    assert (f"class:{c}\\OrderController", "interface:Other\\Thing", "implements") in e
    assert (f"class:{c}\\OrderController", f"trait:{c}\\Logs", "uses_trait") in e
    assert (m, "job:App\\Jobs\\Ship", "controller_dispatches_job") in e and (m, f"event:{c}\\OrderPlaced", "emits_event") in e and (m, f"event:{c}\\Seen", "emits_event") in e
    assert (m, "method:App\\Models\\Order::total", "calls") in e and (m, f"method:{c}\\OrderController::save", "calls") in e and (m, f"class:{c}\\NotFound", "throws") in e
    assert ("route:GET /parcels/{key}", f"method:{c}\\OrderController::store", "route_to_controller") in e and ("route:POST /orders", f"method:{c}\\OrderController::store", "route_to_controller") in e


def test_scan_ts_and_resolution(spark):
    rows = [
        ("src/pages/orders/[id].vue", "<script setup>\nimport { useCart } from '../../lib/cart'\nimport Row from '../../ui/Row.vue'\nfunction go() { useCart() }\n</script>\n<template><Row/><Gone/></template>"),
        ("src/lib/cart.ts", "export function useCart() { return total() }\nexport const total = () => 1\n// import x from './never'\n"),
        ("src/ui/Row.vue", "<script>export default {}</script><template><div/></template>"),
        ("src/bad.ts", None),
    ]
    df = spark.createDataFrame(rows, "path string, source string")
    e = {(r.src, r.dst, r.kind) for r in extract.edges(df).collect()}
    assert ("file:src/pages/orders/[id].vue", "file:src/lib/cart.ts", "imports") in e and ("route:GET /orders/:id", "component:[id]", "route_to_component") in e
    assert ("component:[id]", "component:Row", "vue_renders") in e and not any("Gone" in x[1] for x in e)
    assert ("function:go", "composable:useCart", "calls") in e and ("composable:useCart", "function:total", "calls") in e
    assert ("component:[id]", "composable:useCart", "component_uses_composable") in e and ("component:[id]", "component:Row", "component_uses_component") in e
    assert {r.kind for r in extract.nodes(df).collect()} >= {"file", "component", "route", "composable", "function"}


def test_metrics(spark):
    lines, cyclomatic, nesting, methods, longest = extract.metrics("a.php", PHP)
    assert lines == PHP.count("\n") + 1 and cyclomatic == 4 and nesting == 2 and methods == 1 and longest == 5
    got = extract.code_metrics(spark.createDataFrame([("x.ts", "function f(a) {\n if (a) { return 1 }\n return a ? 1 : 2\n}\n"), ("e.ts", None)], "path string, source string")).collect()
    assert (got[0].cyclomatic, got[0].nesting, got[0].methods, got[0].longest_method) == (3, 1, 1, 4) and got[1].lines == 1
    assert extract.page_route("src/pages/a/[...rest].vue") == "/a/:rest*" and extract.page_route("src/pages/index.vue") == "/" and extract.page_route("lib/x.ts") is None


# --- text blocks and streams


def test_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([("q", 1, "aaaa"), ("q", 2, "b" * 50), ("q", 3, "c")], "prompt string, place int, line string")
    assert render.to_block(render.budget(df, ["prompt"], "place", "line", 20), ["prompt"], "place", "line").first().block == "aaaa"


def test_signals_gate(spark):
    t = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "tests/Fixtures/c")], "prompt string, path string")
    v = spark.createDataFrame([(p, r, 1.0, 0.0, 0.0, 0.0) for p, r in (("a", 0.2), ("b", 0.6), ("tests/Fixtures/c", 0.9))], "path string, risk_score double, churn double, bug_density double, ownership double, recency double")
    m = spark.createDataFrame([("a", "z", 0.49, 1)], "anchor string, neighbor string, coupling double, rank int")
    r = spark.createDataFrame([("zz", 1)], "path string, reverts long")
    assert render.signals_block(t, v, m, r).first().block == "## Historical Signals\n- `b` — risk 0.60, high churn."
    assert render.brief(t.withColumn("target_rank", F.lit(1)), spark.createDataFrame([("b", 3, "low")], "path string, lines int, risk string"), v, m, r).count() == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(at(0) + dt.timedelta(minutes=i), i % 3, f"x{i % 4}") for i in range(200)] + [(at(30), 9, "end")]
    df = spark.createDataFrame(rows, "ts timestamp, owner long, item string")
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = pairs.basket_pairs(pairs.closed_baskets(s)).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = pairs.basket_pairs(pairs.closed_baskets(df))
    key = lambda d: sorted((r.start, r.owner, r.a, r.b) for r in d.collect())
    assert key(spark.table("closed")) == key(batch) and batch.count() > 0


def test_structural_gap_without_a_file(spark):
    planned = spark.createDataFrame([(1, "app/A.php")], "plan long, path string")
    nodes = spark.createDataFrame([("class:A", "app/A.php"), ("event:E", None), ("class:B", "app/B.php"), ("class:F", "tests/fixtures/F.php"), ("class:S", "app/S.php"), ("job:J", "app/J.php")], "key string, file_path string")
    rows = [("class:A", "event:E", "emits_event"), ("class:A", "class:B", "extends"), ("class:A", "class:F", "dispatches_job"), ("class:A", "class:B", "binds_service"), ("class:A", "class:Gone", "implements"), ("class:S", "job:J", "dispatches_job")]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string")
    symbols = spark.createDataFrame([(1, "class:S")], "plan long, symbol string")
    got = {r.discriminator: (r.severity, r.confidence, r.paths, r.symbols) for r in plan.check_structural(planned, nodes, edges, symbols).collect()}
    assert got == {
        "node:event:E": ("warning", 0.6, [], ["event:E"]),
        "app/B.php": ("info", 0.4, ["app/B.php"], []),
        "node:class:Gone": ("info", 0.4, [], ["class:Gone"]),
        "app/J.php": ("warning", 0.6, ["app/J.php"], []),
    }


def test_missing_tests_and_evidence(spark):
    planned = spark.createDataFrame([(1, "app/A.php"), (1, "app/B.php"), (1, "tests/BTest.php"), (1, "app/C.php"), (1, "composer.lock")], "plan long, path string")
    repo = spark.createDataFrame([("tests/ATest.php",), ("spec/ATest.php",)], "path string")
    risk = spark.createDataFrame([("app/C.php", 0.7)], "path string, risk_score double")
    base = F.regexp_extract("path", r"(\w+)\.php$", 1)
    tests = F.array(F.concat(F.lit("tests/"), base, F.lit("Test.php")), F.concat(F.lit("spec/"), base, F.lit("Test.php")))
    got = {r.discriminator: (r.severity, r.confidence, r.paths, r.suggested) for r in plan.check_missing_test(planned, repo, risk, tests, F.col("path").startswith("tests/")).collect()}
    both = ["tests/ATest.php", "spec/ATest.php"]
    assert got == {"app/A.php": ("warning", 0.8, both, both), "app/C.php": ("warning", 0.8, ["tests/CTest.php", "spec/CTest.php"], [])}
    seven = spark.range(1).select(plan.capped(F.array(*[F.lit(str(i)) for i in range(7)])).alias("x")).first().x
    assert seven == ["0", "1", "2", "3", "4", "...and 2 more"]
    text = "word " * 20 + "needle" + " more" * 20
    assert spark.range(1).select(plan.snippet(F.lit(text), F.lit("needle")).alias("x")).first().x == "word word word word word word needle more more more more more more"


def test_chains_have_no_limit(spark):
    links = spark.createDataFrame([(f"c{i + 1:03d}", f"c{i:03d}", i) for i in range(80)], "id string, target string, ts long")
    assert reverts.chains(links).agg(F.max("step")).first()[0] == 80
