"""Anchors: expansion to neighbours, ranking, caps and project configuration. Many prompts at once.

An anchor row has: prompt, kind (path, symbol), value, source, confidence, evidence,
retrieval_score, support and ord, its place of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.functions.text import NOISE_PATH, any_of, glob_swallow
from driftmap.operators.graph import search

CONFIDENCE = ("low", "medium", "high")
#: From weakest to strongest.
SOURCES = ("graph_expand", "cochange_expand", "lexical", "corpus_match", "explicit", "project_config")


def _level(names: tuple[str, ...], x: Column) -> Column:
    c = None
    for i, n in enumerate(names):
        c = (F if c is None else c).when(x == n, i)
    return c


def confidence_level(x: Column) -> Column:
    return _level(CONFIDENCE, x)


def source_level(x: Column) -> Column:
    return _level(SOURCES, x)


def _weaker(x: Column) -> Column:
    return F.when(x == "high", "medium").otherwise("low")


def parents(anchors: DataFrame, most: int = 5) -> DataFrame:
    """prompt, value, confidence, place: the paths that may expand, best first."""
    ok = anchors.where((F.col("kind") == "path") & (confidence_level(F.col("confidence")) >= 1))
    w = Window.partitionBy("prompt").orderBy(F.desc(confidence_level(F.col("confidence"))), F.desc(source_level(F.col("source"))), "ord")
    return ok.select("prompt", "value", "confidence", F.row_number().over(w).alias("place")).where(F.col("place") <= most)


def expand_co_change(anchors: DataFrame, matrix: DataFrame, min_coupling: float = 0.5, per_anchor: int = 3, most: int = 5) -> DataFrame:
    """prompt, value, parent, coupling, confidence, place: neighbours that each parent adds.

    A parent only claims what no earlier parent and no anchor has, and a claimed neighbour
    does not use up its quota. A prompt has at most ``most`` parents and a parent the few
    neighbours of the matrix, so a prompt's candidates are a short array, which one pass cuts to
    what is claimed. matrix: anchor, neighbor, coupling, rank.
    """
    p = parents(anchors, most)
    m = matrix.where((F.col("coupling") >= min_coupling) & ~F.col("neighbor").rlike(NOISE_PATH)).select(F.col("anchor").alias("value"), "neighbor", "coupling", F.col("rank").alias("nrank"))
    cand = p.join(m, "value").select("prompt", "place", F.col("value").alias("parent"), _weaker(F.col("confidence")).alias("confidence"), F.col("neighbor").alias("value"), "coupling", "nrank")
    have = anchors.where("kind = 'path'").groupBy("prompt").agg(F.collect_set("value").alias("have"))
    row = F.struct("place", (-F.col("coupling")).alias("order"), "nrank", "value", "parent", "confidence", "coupling")
    groups = cand.groupBy("prompt").agg(F.array_sort(F.collect_list(row)).alias("c"))
    groups = groups.join(have, "prompt", "left").select("prompt", F.filter("c", lambda x: ~F.coalesce(F.array_contains("have", x["value"]), F.lit(False))).alias("c"))
    none = F.filter("c", lambda x: F.lit(False))

    def claim(got: Column, x: Column) -> Column:
        full = F.size(F.filter(got, lambda y: y["place"] == x["place"])) >= per_anchor
        return F.when(full | F.exists(got, lambda y: y["value"] == x["value"]), got).otherwise(F.array_append(got, x))

    claimed = groups.select("prompt", F.explode(F.aggregate("c", none, claim)).alias("x"))
    return claimed.select("prompt", "x.value", "x.parent", "x.coupling", "x.confidence", "x.place")


#: Edges along which anchors grow.
EXPAND_EDGES = tuple("controller_dispatches_job controller_uses_request dispatches_job emits_event extends implements listens_to_event observes_model route_to_controller".split())
#: Symbols that are looked for even if no node has just that key.
STRONG_SYMBOL = r"\\|::|" + any_of("Command Controller Event Job Listener Observer Policy Repository Request Resource Service Transformer".split()) + r"\z"


def graph_nodes(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """prompt, kind, value, confidence, ord, at: the node from which an anchor expands; anchors without one are left out.

    A path's file counts whatever its confidence; if it defines a class, that class stands for it.
    A symbol is the node of that key; a strong one may also be the best hit of a search, and
    either then counts whatever its confidence. nodes: key, name, fqcn, and defines, the keys that
    a file's node is tied to by a ``defines`` edge (null for others).
    """
    a = anchors.select("prompt", "kind", "value", "confidence", "ord")
    # of more than three neighbours the three largest keys are looked at, and of these the smallest class
    own = F.get(F.array_sort(F.filter(F.slice(F.sort_array("defines", asc=False), 1, 3), lambda k: k.startswith("class:"))), F.lit(0))
    files = nodes.where(F.col("key").startswith("file:")).select(F.expr("substring(key, 6)").alias("value"), F.coalesce(own, "key").alias("at"))
    paths = a.where("kind = 'path'").join(files, "value")
    symbols = a.where("kind = 'symbol'")
    exact = symbols.join(nodes.select(F.col("key").alias("value"), F.col("key").alias("at")), "value")
    rest = symbols.join(nodes.select(F.col("key").alias("value")), "value", "left_anti").where(F.col("value").rlike(STRONG_SYMBOL))
    hits = search(nodes, rest.select(F.col("value").alias("query")), 1).select(F.col("query").alias("value"), F.col("key").alias("at"))
    return paths.unionByName(exact).unionByName(rest.join(hits, "value"))


def expand_graph(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = EXPAND_EDGES, per_anchor: int = 5) -> DataFrame:
    """prompt, kind, value, parent, edge_kind, confidence: files and symbols one edge away, either direction.

    Every anchor may claim, in order, what no anchor has and none before it claimed, so the pass
    is sequential within a prompt; it sees at most ``per_anchor`` neighbours of each anchor
    (those with most edges to it, of equals the larger keys). nodes: key, name, fqcn, file_path.
    """
    tied = edges.where("kind = 'defines'")
    tied = tied.select(F.col("src").alias("key"), F.col("dst").alias("other")).unionAll(tied.select(F.col("dst").alias("key"), F.col("src").alias("other")))
    tied = tied.where(F.col("key").startswith("file:")).groupBy("key").agg(F.collect_set("other").alias("defines"))
    a = graph_nodes(anchors, nodes.join(tied, "key", "left"))
    e = edges.where(F.col("kind").isin(*kinds)).select("src", "dst", "kind").distinct()
    ends = e.select(F.col("src").alias("at"), F.col("dst").alias("to"), "kind").unionAll(e.where("src != dst").select(F.col("dst").alias("at"), F.col("src").alias("to"), "kind"))
    near = ends.join(a.select("at").distinct(), "at", "left_semi")
    degree = near.groupBy("at", "to").agg(F.count("*").alias("n"))
    degree = degree.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("n"), F.desc("to")))).where(F.col("r") <= per_anchor)
    near = near.join(degree.select("at", "to"), ["at", "to"]).join(nodes.select(F.col("key").alias("to"), "file_path"), "to")
    isfile = F.col("to").startswith("file:")
    near = near.select("at", "to", "kind", F.when(isfile, "path").otherwise("symbol").alias("child"), F.when(isfile, F.coalesce("file_path", F.expr("substring(to, 6)"))).otherwise(F.col("to")).alias("found"))
    near = near.where((F.col("child") != "path") | ~F.col("found").rlike(NOISE_PATH))
    cand = a.select("prompt", "ord", "value", "at", _weaker(F.col("confidence")).alias("confidence")).join(near, "at")
    have = anchors.select("prompt", F.col("kind").alias("child"), F.col("value").alias("found")).distinct()
    cand = cand.join(have, ["prompt", "child", "found"], "left_anti")

    def claim(pdf):
        taken: set[tuple] = set()
        count: dict[tuple, int] = {}
        keep = []
        pdf = pdf.sort_values(["ord", "value", "kind", "to"], kind="stable")
        for i, (o, v, child, found) in enumerate(zip(pdf["ord"], pdf["value"], pdf["child"], pdf["found"])):
            if (child, found) not in taken and count.get((o, v), 0) < per_anchor:
                taken.add((child, found))
                count[o, v] = count.get((o, v), 0) + 1
                keep.append(i)
        out = pdf.iloc[keep].rename(columns={"value": "parent", "kind": "edge_kind"})
        return out.rename(columns={"child": "kind", "found": "value"})[["prompt", "kind", "value", "parent", "edge_kind", "confidence"]]

    t = dict(cand.dtypes)["prompt"]
    return cand.groupBy("prompt").applyInPandas(claim, f"prompt {t}, kind string, value string, parent string, edge_kind string, confidence string")


def dedup(anchors: DataFrame) -> DataFrame:
    """One anchor for each (prompt, kind, value): confidence, then source, then arrival decide; evidence is united."""
    w = Window.partitionBy("prompt", "kind", "value").orderBy(F.desc(confidence_level(F.col("confidence"))), F.desc(source_level(F.col("source"))), "ord")
    all_ = Window.partitionBy("prompt", "kind", "value")
    a = anchors.where((F.col("kind") != "path") | ~F.col("value").rlike(NOISE_PATH))
    a = a.withColumn("evidence", F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence").over(all_)))))
    return a.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def role_boost(prompt_words: Column, roles: Column, hints: dict[str, list[str]], hit: float = 1.4, miss: float = 0.85) -> Column:
    """Hit if a word of the prompt goes with one of the file's roles, miss if it has roles but none fits, else 1."""
    wanted = F.array_distinct(F.flatten(F.array(*[F.when(F.array_contains(roles, r), F.array(*map(F.lit, w))).otherwise(F.array().cast("array<string>")) for r, w in sorted(hints.items())])))
    return F.when(F.coalesce(F.size(roles), F.lit(0)) <= 0, 1.0).when(F.arrays_overlap(wanted, prompt_words), hit).otherwise(miss)


def clamp(x: Column, low: float = 0.7, high: float = 1.5) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rank(anchors: DataFrame, max_paths: int = 10, max_symbols: int = 5, max_total: int = 40, min_confidence: str = "medium") -> DataFrame:
    """The deduplicated anchors with rank (all) and target_rank (null: not a target).

    Targets are eligible anchors only, so the caps of paths and symbols apply after the floor.
    ``boost``: a column of the anchors if there is one, else 1.
    """
    a = dedup(anchors)
    if "boost" not in a.columns:
        a = a.withColumn("boost", F.lit(1.0))
    order = [F.desc(confidence_level(F.col("confidence"))), F.desc(source_level(F.col("source"))), F.desc("boost"), F.desc(F.coalesce("support", F.lit(0))), "value", "kind"]
    a = a.withColumn("rank", F.row_number().over(Window.partitionBy("prompt").orderBy(*order)))
    ok = confidence_level(F.col("confidence")) >= CONFIDENCE.index(min_confidence)
    a = a.withColumn("_ok", ok).withColumn("_t", F.row_number().over(Window.partitionBy("prompt", "kind", "_ok").orderBy("rank")))
    cap = F.when(F.col("kind") == "path", max_paths).otherwise(max_symbols)
    a = a.withColumn("target_rank", F.when(F.col("_ok") & (F.col("_t") <= cap), F.col("_t")))
    return a.where(F.col("rank") <= max_total).drop("_ok", "_t")


def rank_stats(anchors: DataFrame) -> DataFrame:
    """prompt, source, confidence, n before any cap."""
    return dedup(anchors).groupBy("prompt", "source", "confidence").agg(F.count("*").alias("n"))


def apply_config(ranked: DataFrame, exclude: list[str] = (), boosts: list[tuple[str, str, str]] = (), include: list[str] = ()) -> DataFrame:
    """Excludes by glob, changes confidences (source, from, to; the first rule that fits), puts included paths first.

    Ranks and targets stay as they were: excluded targets are not filled up.
    """
    out = ranked
    for g in exclude:
        out = out.where((F.col("kind") != "path") | ~F.col("value").rlike(glob_swallow(g)))
    c = None
    for source, old, new in boosts:
        c = (F if c is None else c).when((F.col("source") == source) & (F.col("confidence") == old), new)
    if c is not None:
        out = out.withColumn("confidence", c.otherwise(F.col("confidence")))
    if include:
        spark = ranked.sparkSession
        extra = spark.createDataFrame([(p, i) for i, p in enumerate(include)], "value string, place long")
        prompts = ranked.select("prompt").distinct()
        missing = prompts.crossJoin(F.broadcast(extra)).join(out.where("kind = 'path'").select("prompt", "value"), ["prompt", "value"], "left_anti")
        new = missing.select("prompt", F.lit("path").alias("kind"), "value", F.lit("project_config").alias("source"), F.lit("high").alias("confidence"), (F.col("place") - len(include)).cast("int").alias("rank"))
        out = out.unionByName(new, allowMissingColumns=True)
    return out
