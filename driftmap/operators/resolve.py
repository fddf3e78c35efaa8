"""Prompt resolution: from prompts to ranked targets in one call, and its pieces."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.functions import text
from driftmap.operators import anchors, retrieval
from driftmap.session import saved

#: Words of a prompt that go with a role of a file.
ROLE_HINTS = {
    "admin-tool": "admin console dashboard".split(),
    "api-endpoint": "api endpoint handler".split(),
    "application-api": "app application mobile-app".split(),
    "auth-flow": "auth login session token".split(),
    "component": "component ui widget".split(),
    "composable": "composable hook".split(),
    "customer-admin": ["customer"],
    "member-endpoint": "api endpoint member route".split(),
    "route": "api endpoint page route".split(),
    "store": "state store".split(),
}
ENDPOINT_WORDS = "api controller endpoint endpoints handler http page pages request route routes".split()
ROUTE_EDGES = tuple("route_to_component route_to_controller route_to_handler".split())
_TS = "ts tsx vue js jsx mjs cjs".split()


def test_candidates(path: Column, profile: str = "null") -> Column:
    """Where the test of a source file may be: two places for PHP, up to nine for TypeScript and its kin, else beside it."""
    if profile == "laravel":
        base = F.regexp_replace(F.regexp_replace(path, "^(?:src|app)/", ""), r"\.php\z", "Test.php")
        return F.transform(F.array(F.lit("tests/Unit/"), F.lit("tests/Feature/")), lambda d: F.concat(d, base))
    if profile == "ts":
        ext = F.regexp_extract(path, r"(\.(?:" + "|".join(_TS) + r"))\z", 1)
        end = F.when(ext == ".vue", ".ts").otherwise(ext)
        stem = F.regexp_replace(path, r"\.[a-z]+\z", "")
        folder, name = F.regexp_extract(stem, "^(.*/)", 1), F.regexp_replace(stem, "^.*/", "")
        mirrored = F.regexp_replace(stem, "^(?:app|src|lib)/", "")
        near = [F.concat(x, F.lit(k), end) for x in (stem, F.concat(folder, F.lit("__tests__/"), name)) for k in (".test", ".spec")]
        far = [F.concat(F.lit(d), mirrored, F.lit(k), end) for d in ("tests/", "__tests__/") for k in (".test", ".spec")]
        other = F.when(ext == ".ts", F.concat(stem, F.lit(".test.tsx")))
        return F.when(ext != "", F.array_distinct(F.array_compact(F.array(*near, *far, other)))).otherwise(F.array().cast("array<string>"))
    ext = F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)\z", 1)
    base = F.substr(path, F.lit(1), F.length(path) - F.length(ext))
    return F.transform(F.array(F.lit(".test"), F.lit(".spec")), lambda k: F.concat(base, k, ext))


def clean_body(body: Column, boilerplate: tuple[str, ...] = ("Approved-by:", "Merged in", "Pull request")) -> Column:
    """A commit body for use as a prompt: without "* commits:" lists (up to a blank or another line), boilerplate lines and runs of blank lines."""
    lines = F.split(F.coalesce(body, F.lit("")), "\n")
    drop = lambda t: F.array_contains(F.array(*[t.startswith(p) for p in boilerplate]), True)
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, line: Column) -> Column:
        t = F.trim(line)
        opens = t.rlike(r"(?i)^\*\s+commits?:")
        goes = acc["inside"] & ((t == "") | t.startswith("*") | t.rlike(r"^[a-f0-9]{7,40}\s"))
        inside = opens | (acc["inside"] & goes & (t != ""))
        kept = F.when(opens | goes | drop(t), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(line)))
        return F.struct(inside.alias("inside"), kept.alias("kept"))

    return F.aggregate(lines, start, step, lambda acc: F.regexp_replace(F.regexp_replace(F.array_join(acc["kept"], "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+\z", ""))


def explicit(prompts: DataFrame, files: DataFrame) -> DataFrame:
    """Anchors of what prompts name: a path that exists is sure, one that doesn't is weak, a symbol lies between. prompts: prompt, text; files: path."""
    m = prompts.select("prompt", F.posexplode(text.mentions(F.col("text"))).alias("ord", "m")).select("prompt", "ord", "m.kind", "m.value")
    known = files.select(F.col("path").alias("value"), F.lit(True).alias("known")).distinct()
    m = m.join(known, "value", "left")
    conf = F.when((F.col("kind") == "path") & F.col("known"), "high").when(F.col("kind") == "path", "low").otherwise("medium")
    return m.select("prompt", F.when(F.col("kind") == "path", "path").otherwise("symbol").alias("kind"), "value", F.lit("explicit").alias("source"), conf.alias("confidence"), F.array(F.concat(F.lit("named: "), "value")).alias("evidence"), F.lit(0).cast("long").alias("support"), F.col("ord").cast("long").alias("ord"))


def boosts(words: Column, roles: Column, out_kinds: Column, in_kinds: Column, edge_rules: list[dict] = ()) -> Column:
    """Role hints and edge rules, each and together within [.7, 1.5]; then, for prompts about endpoints, whether a route leads here.

    ``roles``, ``out_kinds``, ``in_kinds``: what the graph knows of the file, null if it is not in it.
    """
    b = anchors.role_boost(words, roles, ROLE_HINTS)
    for r in edge_rules:
        hit = F.array_contains(out_kinds, r["edgeKind"]) & F.arrays_overlap(words, F.array(*[F.lit(w.lower()) for w in r["whenPromptContains"]]))
        b = b * F.when(F.coalesce(hit, F.lit(False)), anchors.clamp(F.lit(float(r["multiplier"])))).otherwise(1.0)
    about = F.arrays_overlap(words, F.array(*map(F.lit, ENDPOINT_WORDS)))
    route = F.when(F.arrays_overlap(in_kinds, F.array(*map(F.lit, ROUTE_EDGES))), 1.5).otherwise(0.85)
    return F.when(out_kinds.isNull(), 1.0).otherwise(anchors.clamp(b) * F.when(about, route).otherwise(1.0))


def graph_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """value (path), roles, out_kinds, in_kinds of file nodes; nodes: key, and roles if they are tagged."""
    roles = F.col("roles") if "roles" in nodes.columns else F.lit(None).cast("array<string>").alias("roles")
    f = nodes.where(F.col("key").startswith("file:")).select("key", roles)
    out = edges.groupBy(F.col("src").alias("key")).agg(F.collect_set("kind").alias("out_kinds"))
    in_ = edges.groupBy(F.col("dst").alias("key")).agg(F.collect_set("kind").alias("in_kinds"))
    none = F.array().cast("array<string>")
    g = f.join(out, "key", "left").join(in_, "key", "left")
    return g.select(F.substring("key", 6, 1 << 20).alias("value"), F.coalesce("roles", none).alias("roles"), F.coalesce("out_kinds", none).alias("out_kinds"), F.coalesce("in_kinds", none).alias("in_kinds"))


def ranker_words(prompt: Column) -> Column:
    """The words of a prompt that boosts look for: lower case, hyphens kept."""
    return F.array_distinct(F.filter(F.split(F.lower(prompt), "[^a-z0-9-]+"), lambda w: w != ""))


@dataclass
class Repository:
    """What prompts are resolved against; what is None is left out. Nothing but ``files`` is required.

    files: path; classes: symbol, file_path; docs: as ``retrieval.corpus_scores`` takes them, with
    touches (doc, path, file_ord); matrix: anchor, neighbor, coupling, rank; nodes: key, name,
    fqcn, file_path, roles; edges: src, dst, kind; groups: token, grp.
    """

    files: DataFrame
    classes: DataFrame | None = None
    docs: DataFrame | None = None
    touches: DataFrame | None = None
    matrix: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    groups: DataFrame | None = None
    stopwords: list[str] = field(default_factory=lambda: "app lib spec src test tests".split())
    exclude: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    confidence_boosts: list[tuple[str, str, str]] = field(default_factory=list)
    edge_weights: list[dict] = field(default_factory=list)


_ANCHOR = ["prompt", "kind", "value", "source", "confidence", "evidence", "support", "ord"]


def _retrieved(subjects: DataFrame, repo: Repository, as_of: str) -> DataFrame:
    """Anchors of explicit mentions, then of the corpus, then of words in paths; ``ord`` counts in that order. subjects: prompt, text."""
    named = explicit(subjects, repo.files)
    if repo.classes is not None:
        known = repo.classes.select(F.col("symbol").alias("value"), F.lit(True).alias("sure")).distinct()
        named = named.join(known, "value", "left")
        symbol = F.col("kind") == "symbol"
        named = named.withColumn("confidence", F.when(symbol, F.when(F.col("sure"), "high").otherwise("low")).otherwise(F.col("confidence"))).withColumn("value", F.when(symbol & F.col("sure"), F.concat(F.lit("class:"), "value")).otherwise(F.col("value")))
    found = named.select(*_ANCHOR)
    if repo.docs is not None:
        p = subjects.select("prompt", F.col("text").alias("title"), text.corpus_tokens(F.col("text")).alias("tokens"))
        c = retrieval.corpus_paths(retrieval.corpus_scores(repo.docs, saved(p, "titles"), as_of), repo.touches)
        c = c.select("prompt", F.lit("path").alias("kind"), "path", F.lit("corpus_match").alias("source"), "confidence", F.array(F.format_string("corpus %.4f", "weighted")).alias("evidence"), F.col("support").cast("long").alias("support"), (F.col("rank") + 10_000).cast("long").alias("ord"))
        found = found.unionByName(c.withColumnRenamed("path", "value"))
    q = subjects.select("prompt", text.prompt_tokens(F.col("text")).alias("tokens"))
    q = retrieval.with_synonyms(q, repo.groups) if repo.groups is not None else q.select("prompt", F.explode("tokens").alias("token")).distinct()
    x = retrieval.lexical(q, repo.files, repo.stopwords)
    x = x.select("prompt", F.lit("path").alias("kind"), F.col("path").alias("value"), F.lit("lexical").alias("source"), "confidence", F.array(F.format_string("words %.1f", "score")).alias("evidence"), F.lit(0).cast("long").alias("support"), (F.col("rank") + 20_000).cast("long").alias("ord"))
    return found.unionByName(x)


def resolve_subjects(subjects: DataFrame, repo: Repository, as_of: str, **ranking) -> DataFrame:
    """The ranked anchors of each subject (prompt, text): retrieval, expansion, boosts, ranking, configuration. Each stage is a table, so plans stay small."""
    subjects = saved(subjects, "subjects")
    base = saved(_retrieved(subjects, repo, as_of), "retrieved")
    every = base
    if repo.matrix is not None:
        g = anchors.expand_co_change(base, repo.matrix)
        g = g.select("prompt", F.lit("path").alias("kind"), "value", F.lit("cochange_expand").alias("source"), "confidence", F.array(F.concat(F.lit("changes with "), "parent")).alias("evidence"), F.lit(0).cast("long").alias("support"), (F.col("place") + 30_000).cast("long").alias("ord"))
        every = saved(every.unionByName(g), "grown")
    if repo.nodes is not None:
        g = anchors.expand_graph(base, repo.nodes, repo.edges)
        have = every.select("prompt", "kind", "value").distinct()
        g = g.join(have, ["prompt", "kind", "value"], "left_anti")
        g = g.select("prompt", "kind", "value", F.lit("graph_expand").alias("source"), "confidence", F.array(F.concat(F.lit("one "), "edge_kind", F.lit(" from "), "parent")).alias("evidence"), F.lit(0).cast("long").alias("support"), F.lit(40_000).cast("long").alias("ord"))
        every = every.unionByName(g)
        context = graph_context(repo.nodes, repo.edges).select("value", "roles", "out_kinds", "in_kinds", F.lit("path").alias("kind"))
        every = every.join(context, ["kind", "value"], "left").join(subjects.select("prompt", ranker_words(F.col("text")).alias("words")), "prompt")
        every = every.withColumn("boost", boosts(F.col("words"), F.col("roles"), F.col("out_kinds"), F.col("in_kinds"), repo.edge_weights)).select(*_ANCHOR, "boost")
    ranked = saved(anchors.rank(saved(every, "anchors"), **ranking), "ranked")
    return saved(anchors.apply_config(ranked, repo.exclude, repo.confidence_boosts, repo.include), "configured")


def resolve(prompts: DataFrame, repo: Repository, as_of: str, per_subject: int = 8, **ranking) -> DataFrame:
    """prompt, kind, value, source, confidence, evidence, rank, target_rank of every prompt (prompt, text).

    A prompt that compares two subjects is resolved for each; the first gives its best
    ``per_subject`` anchors, the second its best that the first did not give, and what both gave
    is ranked once more, without boosts. All others are ranked as they are. What comes of a prompt
    follows from its text alone, so each text and each subject is resolved once, however many
    prompts have it.
    """
    prompts = saved(prompts.select("prompt", "text").distinct(), "prompts")
    split = prompts.select("text").distinct().select(F.col("text").alias("prompt"), F.posexplode(text.subjects(F.col("text"))).alias("place", "s"))
    split = saved(split.select("prompt", "place", F.col("s.text").alias("subject")), "split")
    each = resolve_subjects(split.select(F.col("subject").alias("prompt"), F.col("subject").alias("text")).distinct(), repo, as_of, **ranking)
    each = split.join(each.withColumnRenamed("prompt", "subject"), "subject").drop("subject")
    two = split.where("place = 1").select("prompt")
    show = ["prompt", "kind", "value", "source", "confidence", "evidence", "rank", "target_rank"]
    alone = each.join(two, "prompt", "left_anti").select(*show)
    pair = each.join(two, "prompt", "left_semi")
    w = Window.partitionBy("prompt", "place").orderBy("rank", "value")
    first = pair.where("place = 0").withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_subject)
    second = pair.where("place = 1").join(first.select("prompt", "kind", "value"), ["prompt", "kind", "value"], "left_anti").withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_subject)
    merged = first.unionByName(second).withColumn("ord", (F.col("place") * 1000 + F.col("n")).cast("long"))
    again = anchors.rank(saved(merged.select("prompt", "kind", "value", "source", "confidence", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"), F.coalesce("support", F.lit(0).cast("long")).alias("support"), "ord"), "merged"), **ranking)
    found = alone.unionByName(again.select(*show)).withColumnRenamed("prompt", "text")
    return prompts.join(found, "text").select(*show)


def is_test(path: Column) -> Column:
    """Whether a path is a test by the general rule: in a folder test or tests, or named .test or .spec."""
    return path.rlike(r"(?:^|/)tests?/|(?i:\.(?:spec|test)\.[a-z0-9]+\z)")
