"""Pieces of prompt resolution."""

from pyspark.sql import functions as F

from driftmap.operators import resolve


def test_test_candidates(spark):
    one = lambda p, profile: spark.createDataFrame([(p,)], "p string").select(resolve.test_candidates(F.col("p"), profile)).first()[0]
    assert one("app/Http/X.php", "laravel") == ["tests/Unit/Http/XTest.php", "tests/Feature/Http/XTest.php"]
    ts = one("src/a/b.ts", "ts")
    assert len(ts) == 9 and {"src/a/b.test.ts", "src/a/__tests__/b.spec.ts", "tests/a/b.test.ts", "src/a/b.test.tsx"} <= set(ts)
    assert "src/X.test.ts" in one("src/X.vue", "ts") and one("a.md", "ts") == [] and len(one("a.c", "null")) == 2


def test_clean_body(spark):
    raw = "Title\n\n\n\nwhy\n* commits:\n* one\nabcdef1 two\n\nafter\nMerged in x\n"
    assert spark.createDataFrame([(raw,)], "b string").select(resolve.clean_body(F.col("b"))).first()[0] == "Title\n\nwhy\nafter"


def test_boosts(spark):
    d = spark.createDataFrame([(["api"], ["route"], ["calls"], ["route_to_controller"]), (["api"], ["store"], [], []), (["x"], None, None, None), (["pay"], [], ["calls"], [])], "w array<string>, r array<string>, o array<string>, i array<string>")
    rules = [{"edgeKind": "calls", "whenPromptContains": ["Pay"], "multiplier": 9}]
    got = [round(r[0], 4) for r in d.select(resolve.boosts(*(F.col(c) for c in "wroi"), rules)).collect()]
    assert got == [round(1.4 * 1.5, 4), round(0.85 * 0.85, 4), 1.0, 1.5]


def test_each_text_is_resolved_once(spark, monkeypatch):
    """Prompts of one text share its resolution, and a subject that several texts have is resolved once."""
    seen = []
    real = resolve.resolve_subjects
    monkeypatch.setattr(resolve, "resolve_subjects", lambda subjects, *a, **k: seen.append(subjects.count()) or real(subjects, *a, **k))
    texts = ["the old cart totals vs the new order page", "the old cart totals"]
    p = spark.createDataFrame([(i, texts[i % 2]) for i in range(40)] + [(40, None)], "prompt long, text string")
    files = spark.createDataFrame([("app/CartTotals.php",), ("app/OrderPage.php",)], "path string")
    got = {}
    for r in resolve.resolve(p, resolve.Repository(files), "2024-01-01 00:00:00").collect():
        got.setdefault(r.prompt, set()).add((r.kind, r.value, r.rank, r.target_rank))
    assert seen[0] <= 3 and set(got) == set(range(40))
    assert all(got[i] == got[i % 2] for i in got) and {v for _, v, _, _ in got[0]} == {"app/CartTotals.php", "app/OrderPage.php"} and {v for _, v, _, _ in got[1]} == {"app/CartTotals.php"}
