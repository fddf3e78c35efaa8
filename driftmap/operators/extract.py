"""Code scanners: source text to graph nodes and edges, and code metrics.

No parser of either language is at hand, so these work on tokens: comments and strings are
blanked, braces give the nesting. Routes, imports, definitions, inheritance, dispatches and
simple calls come out; what needs types beyond ``$this``, ``self`` and a local ``new`` does
not. A file that can't be read gives what was found so far and a row of kind ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDGE_SCHEMA = "path string, src string, dst string, kind string, confidence string, line int"
NODE_SCHEMA = "path string, key string, kind string, name string, fqcn string, line int"


def blank(source: str, php: bool = False) -> str:
    """The source with comments and the insides of strings as spaces, same length and lines."""
    out, i, n = list(source), 0, len(source)

    def wipe(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        two = source[i : i + 2]
        if two == "//" or (php and source[i] == "#" and two != "#["):
            e = source.find("\n", i)
            e = n if e < 0 else e
            wipe(i, e)
            i = e
        elif two == "/*":
            e = source.find("*/", i + 2)
            e = n if e < 0 else e + 2
            wipe(i, e)
            i = e
        elif source[i] in "'\"" or (not php and source[i] == "`"):
            q, e = source[i], i + 1
            while e < n and source[e] != q:
                e += 2 if source[e] == "\\" else 1
            wipe(i + 1, e)
            i = e + 1
        else:
            i += 1
    return "".join(out)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _body(text: str, at: int) -> tuple[int, int]:
    """The braces that open after ``at``, or an empty span if a ; comes first."""
    a = text.find("{", at)
    semi = text.find(";", at)
    if a < 0 or (0 <= semi < a):
        return at, at
    depth = 0
    for k in range(a, len(text)):
        depth += (text[k] == "{") - (text[k] == "}")
        if depth == 0:
            return a, k + 1
    return a, len(text)


_PHP_TYPE = re.compile(r"\b(class|interface|trait)\s+([A-Za-z_]\w*)((?:\s+extends\s+[\w\\, ]+?)?)((?:\s+implements\s+[\w\\, \n]+?)?)\s*\{")
_PHP_FN = re.compile(r"\bfunction\s+([A-Za-z_]\w*)\s*\(([^)]*)\)")
_PHP_CALL = re.compile(r"\b(self|static|parent|[A-Z]\w*)::([a-z_]\w*)\s*\(")
_PHP_THIS = re.compile(r"\$this->([a-z_]\w*)\s*\(")
_PHP_VAR = re.compile(r"\$(\w+)->([a-z_]\w*)\s*\(")
_ROUTE = re.compile(r"Route::(get|post|put|patch|delete|any)\(\s*(['\"])(.*?)\2\s*,\s*(?:\[\s*([\w\\]+)::class\s*,\s*(['\"])(\w+)\5|(['\"])([\w\\]+)@(\w+)\7)")
_MAP_ENTRY = re.compile(r"([\w\\]+)::class\s*=>\s*(?:\[([^\]]*)\]|([\w\\]+)::class)")


def scan_php(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """Nodes (key, kind, name, fqcn, line) and edges (src, dst, kind, confidence, line) of one file."""
    text = blank(source, True)
    nodes: list[tuple] = [(f"file:{path}", "file", path.rsplit("/", 1)[-1], None, 1)]
    edges: list[tuple] = []
    m = re.search(r"\bnamespace\s+([\w\\]+)\s*;", text)
    ns = m[1] if m else ""
    uses = {}
    first = _PHP_TYPE.search(text)  # inside a type, use names a trait
    for m in re.finditer(r"^\s*use\s+([\w\\]+)(?:\s+as\s+(\w+))?\s*;", text[: first.start()] if first else text, re.M):
        uses[m[2] or m[1].rsplit("\\", 1)[-1]] = m[1].lstrip("\\")

    def full(name: str) -> str:
        name = name.strip()
        if name.startswith("\\"):
            return name[1:]
        head, _, rest = name.partition("\\")
        if head in uses:
            return uses[head] + ("\\" + rest if rest else "")
        return f"{ns}\\{name}" if ns else name

    for m in _PHP_TYPE.finditer(text):
        kind, name = m[1], m[2]
        own, line = f"{ns}\\{name}" if ns else name, _line(text, m.start())
        key = f"{kind}:{own}"
        nodes.append((key, kind, name, own, line))
        edges.append((f"file:{path}", key, "defines", "exact", line))
        parents = [p for p in m[3].replace("extends", "", 1).split(",") if p.strip()]
        for p in parents:
            edges.append((key, f"{'interface' if kind == 'interface' else 'class'}:{full(p)}", "extends", "exact", line))
        for p in m[4].replace("implements", "", 1).split(","):
            if p.strip():
                edges.append((key, f"interface:{full(p)}", "implements", "exact", line))
        a, b = _body(text, m.end() - 1)
        for u in re.finditer(r"^\s*use\s+([\w\\, ]+)\s*[;{]", text[a:b], re.M):
            for t in u[1].split(","):
                edges.append((key, f"trait:{full(t)}", "uses_trait", "exact", _line(text, a + u.start())))
        for f in _PHP_FN.finditer(text, a, b):
            mkey, fline = f"method:{own}::{f[1]}", _line(text, f.start())
            nodes.append((mkey, "method", f[1], f"{own}::{f[1]}", fline))
            edges.append((key, mkey, "contains_method", "exact", fline))
            fa, fb = _body(text, f.end())
            local = {v: full(t) for t, v in re.findall(r"([A-Z][\w\\]*)\s+\$(\w+)", f[2])}
            local |= {v: full(t) for v, t in re.findall(r"\$(\w+)\s*=\s*new\s+([A-Z\\][\w\\]*)", text[fa:fb])}
            for t in re.findall(r"([A-Z]\w*Request)\s+\$", f[2]):
                if name.endswith("Controller"):
                    edges.append((mkey, f"class:{full(t)}", "controller_uses_request", "exact", fline))
            for c in _PHP_CALL.finditer(text, fa, fb):
                target = own if c[1] in ("self", "static") else full(parents[0]) if c[1] == "parent" and parents else full(c[1])
                if c[2] in ("dispatch", "dispatchSync") and c[1] not in ("self", "static", "parent") and c[1] != "Event":
                    edges.append((mkey, f"job:{target}", "controller_dispatches_job" if name.endswith("Controller") else "dispatches_job", "exact", _line(text, c.start())))
                elif c[1] == "Event" and c[2] == "dispatch":
                    e = re.compile(r"\(\s*new\s+([\w\\]+)").match(text, c.end() - 1)
                    if e:
                        edges.append((mkey, f"event:{full(e[1])}", "emits_event", "exact", _line(text, c.start())))
                elif c[2] == "observe":
                    o = re.compile(r"\(\s*([\w\\]+)::class").match(text, c.end() - 1)
                    if o:
                        edges.append((f"observer:{full(o[1])}", f"class:{target}", "observes_model", "exact", _line(text, c.start())))
                else:
                    edges.append((mkey, f"method:{target}::{c[2]}", "calls", "exact", _line(text, c.start())))
            for c in _PHP_THIS.finditer(text, fa, fb):
                if c[1] not in ("app",):
                    edges.append((mkey, f"method:{own}::{c[1]}", "calls", "exact", _line(text, c.start())))
            for c in _PHP_VAR.finditer(text, fa, fb):
                if c[1] in local:
                    edges.append((mkey, f"method:{local[c[1]]}::{c[2]}", "calls", "inferred", _line(text, c.start())))
            for c in re.finditer(r"\bthrow\s+new\s+([\w\\]+)", text[fa:fb]):
                edges.append((mkey, f"class:{full(c[1])}", "throws", "exact", _line(text, fa + c.start())))
            for c in re.finditer(r"\bevent\(\s*new\s+([\w\\]+)", text[fa:fb]):
                edges.append((mkey, f"event:{full(c[1])}", "emits_event", "exact", _line(text, fa + c.start())))
            for c in re.finditer(r"->(?:bind|singleton|scoped)\(\s*([\w\\]+)::class\s*,\s*([\w\\]+)::class", text[fa:fb]):
                line_ = _line(text, fa + c.start())
                edges.append((mkey, f"interface:{full(c[1])}", "binds_service", "exact", line_))
                edges.append((f"interface:{full(c[1])}", f"class:{full(c[2])}", "binds_concrete", "exact", line_))
        listens = re.search(r"\$listen\s*=\s*\[", text[a:b])
        if listens:
            for c in _MAP_ENTRY.finditer(text, a + listens.end(), b):
                for t in re.findall(r"([\w\\]+)::class", c[2] or f"{c[3]}::class"):
                    edges.append((f"listener:{full(t)}", f"event:{full(c[1])}", "listens_to_event", "exact", _line(text, c.start())))
        policies = re.search(r"\$policies\s*=\s*\[", text[a:b])
        if policies:
            for c in _MAP_ENTRY.finditer(text, a + policies.end(), b):
                if c[3]:
                    edges.append((f"class:{full(c[1])}", f"policy:{full(c[3])}", "authorizes_policy", "exact", _line(text, c.start())))
        if any(p.strip().endswith("Command") for p in parents):
            nodes.append((f"command:{own}", "command", name, own, line))
        if any(p.strip().endswith("Transformer") or p.strip() == "TransformerAbstract" for p in parents) and name.endswith("Transformer"):
            edges.append((key, f"class:{full(name[: -len('Transformer')])}", "transformer_transforms_model", "inferred", line))
    for m in _ROUTE.finditer(source):
        key = f"route:{m[1].upper()} {'/' + m[3].strip('/')}"
        nodes.append((key, "route", m[3], None, _line(source, m.start())))
        cls, fn = (m[4], m[6]) if m[4] else (m[8], m[9])
        edges.append((key, f"method:{full(cls)}::{fn}", "route_to_controller", "exact", _line(source, m.start())))
    return nodes, edges


_IMPORT = re.compile(r"^\s*import\s+(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\{([^}]*)\}|\*\s+as\s+(\w+))?\s*(?:from\s*)?(['\"])([^'\"]+)\4", re.M)
_TS_DEF = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*([A-Za-z_$][\w$]*)|class\s+([A-Za-z_$][\w$]*)|const\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>|const\s+(use[A-Z]\w*)\s*=\s*defineStore)", re.M)
_BLOCK = re.compile(r"<(script|template)\b[^>]*>(.*?)</\1>", re.S | re.I)
MAX_CALLS = 200


def blocks(source: str, tag: str) -> str:
    """All blocks of a single-file component with this tag, one newline between."""
    return "\n".join(m[2] for m in _BLOCK.finditer(source) if m[1].lower() == tag)


def page_route(path: str) -> str | None:
    """The route of a file under pages/: [id] is :id, [...x] is :x*, index goes."""
    m = re.search(r"(?:^|/)pages/(.*)\.(?:vue|tsx?|jsx?)\Z", path)
    if not m:
        return None
    r = re.sub(r"\[\.\.\.(\w+)\]", r":\1*", m[1])
    r = re.sub(r"\[(\w+)\]", r":\1", r)
    r = re.sub(r"(?:^|/)index\Z", "", r)
    return "/" + r


def scan_ts(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """As scan_php; imports keep their specifier (``import:<spec>``) until ``resolve_imports``."""
    vue = path.endswith(".vue")
    code = blocks(source, "script") if vue else source
    text = blank(code)
    name = path.rsplit("/", 1)[-1].split(".")[0]
    nodes: list[tuple] = [(f"file:{path}", "file", path.rsplit("/", 1)[-1], None, 1)]
    edges: list[tuple] = []
    if vue:
        nodes.append((f"component:{name}", "component", name, None, 1))
        edges.append((f"file:{path}", f"component:{name}", "defines", "exact", 1))
        for tag in dict.fromkeys(re.findall(r"<([A-Z]\w*)\b", blocks(source, "template"))):
            edges.append((f"component:{name}", f"tag:{tag}", "vue_renders", "inferred", 1))
    if route := page_route(path):
        nodes.append((f"route:GET {route}", "route", route, None, 1))
        edges.append((f"route:GET {route}", f"component:{name}" if vue else f"file:{path}", "route_to_component", "exact", 1))
    imported: dict[str, str] = {}
    spaces: dict[str, str] = {}
    for m in _IMPORT.finditer(code):
        if text[m.start() : m.end()].strip().startswith("import"):
            line, spec = _line(code, m.start()), m[5]
            edges.append((f"file:{path}", f"import:{spec}", "imports", "exact", line))
            if m[1]:
                imported[m[1]] = spec
            for part in (m[2] or "").split(","):
                if part.strip():
                    imported[part.split(" as ")[-1].replace("type ", "").strip()] = spec
            if m[3]:
                spaces[m[3]] = spec
    defs = []
    for m in _TS_DEF.finditer(text):
        fn, cls, arrow, store = m.groups()
        d = fn or cls or arrow or store
        kind = "store" if store else "class" if cls else "composable" if re.match(r"use[A-Z]", d) else "function"
        line = _line(text, m.start())
        nodes.append((f"{kind}:{d}", kind, d, None, line))
        edges.append((f"file:{path}", f"{kind}:{d}", "defines", "exact", line))
        defs.append((m.start(), f"{kind}:{d}", d))
    own = {d for *_, d in defs}
    calls = 0
    for m in re.finditer(r"(?<![\w$.])(?:(\w+)\.)?([A-Za-z_$][\w$]*)\s*\(", text):
        space, called = m[1], m[2]
        owner = [k for a, k, _ in defs if a < m.start()]
        if not owner or calls >= MAX_CALLS or re.search(r"(?:function\*?|class|new)\s+\Z", text[max(0, m.start() - 12) : m.start()]):
            continue
        if space in spaces:
            target = f"call:{spaces[space]}#{called}"
        elif space is None and called in imported:
            target = f"call:{imported[called]}#{called}"
        elif space is None and called in own:
            target = f"call:.#{called}"
        else:
            continue
        calls += 1
        edges.append((owner[-1], target, "calls", "inferred", _line(text, m.start())))
    return nodes, edges


def _scanner(rows: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, source in zip(b["path"], b["source"]):
                if not isinstance(source, str):
                    continue
                try:
                    nodes, edges = (scan_php if path.endswith(".php") else scan_ts)(path, source)
                except (re.error, RecursionError, IndexError) as e:
                    nodes, edges = [(f"file:{path}", "error", str(e)[:200], None, 0)], []
                out += [(path, *r) for r in (nodes if rows == "nodes" else edges)]
            names = [c.split()[0] for c in (NODE_SCHEMA if rows == "nodes" else EDGE_SCHEMA).split(", ")]
            yield pd.DataFrame(out, columns=names)

    return run


def nodes(files: DataFrame) -> DataFrame:
    """files: path, source."""
    return files.select("path", "source").mapInPandas(_scanner("nodes"), NODE_SCHEMA)


def edges(files: DataFrame) -> DataFrame:
    """Edges of all files, imports and calls resolved against the files and definitions at hand."""
    raw = files.select("path", "source").mapInPandas(_scanner("edges"), EDGE_SCHEMA)
    return resolve_imports(raw, files.select("path"))


_ENDS = "ts tsx vue js jsx".split()
_SUFFIXES = ("", *(f".{e}" for e in [*_ENDS, "mjs"]), *(f"/index.{e}" for e in _ENDS))


def resolve_imports(raw: DataFrame, paths: DataFrame) -> DataFrame:
    """Relative specifiers become files (the first existing suffix), calls become the definition they name, tags the component; what is not found goes."""
    want = raw.where(F.col("dst").rlike(r"^(?:import|call):"))
    spec = F.regexp_extract("dst", r"^(?:import|call):([^#]*)", 1)
    folder = F.regexp_extract("path", "^(.*)/", 1)
    joined = F.when(spec == ".", F.col("path")).when(spec.startswith("."), F.concat(folder, F.lit("/"), spec))
    flat = F.aggregate(
        F.split(joined, "/"),
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    want = want.withColumn("base", F.array_join(flat, "/")).where(joined.isNotNull())
    tried = want.select("*", F.posexplode(F.array(*[F.concat("base", F.lit(s)) for s in _SUFFIXES])).alias("try", "target"))
    hit = tried.join(paths.select(F.col("path").alias("target")).distinct(), "target")
    w = Window.partitionBy("path", "src", "dst", "kind", "line").orderBy("try")
    hit = hit.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    imports = hit.where("kind = 'imports'").select("path", "src", F.concat(F.lit("file:"), "target").alias("dst"), "kind", "confidence", "line")
    defs = raw.where("kind = 'defines'").select(F.col("path").alias("target"), F.col("dst").alias("def"), F.regexp_replace("dst", "^[a-z]+:", "").alias("called"))
    calls = hit.where("kind = 'calls'").withColumn("called", F.regexp_extract("dst", "#(.*)$", 1)).join(defs, ["target", "called"]).select("path", "src", F.col("def").alias("dst"), "kind", "confidence", "line")
    components = raw.where("kind = 'defines' AND dst LIKE 'component:%'").select(F.col("dst").alias("to")).distinct()
    tags = raw.where("kind = 'vue_renders'").withColumn("to", F.regexp_replace("dst", "^tag:", "component:")).join(components, "to").select("path", "src", F.col("to").alias("dst"), "kind", "confidence", "line")
    # a component that imports a component's or a composable's file uses it
    owner = raw.where("kind = 'defines' AND dst LIKE 'component:%'").select("path", F.col("dst").alias("component"))
    used = defs.where("def LIKE 'component:%' OR def LIKE 'composable:%'").select(F.concat(F.lit("file:"), "target").alias("dst"), "def")
    kind = F.when(F.col("def").startswith("component:"), "component_uses_component").otherwise("component_uses_composable")
    uses = imports.join(owner, "path").join(used, "dst").select("path", F.col("component").alias("src"), F.col("def").alias("dst"), kind.alias("kind"), F.lit("inferred").alias("confidence"), "line")
    rest = raw.where(~F.col("dst").rlike(r"^(?:import|call|tag):"))
    return rest.unionByName(imports).unionByName(calls).unionByName(tags).unionByName(uses)


# --- metrics

_BRANCH = {
    "php": re.compile(r"\b(?:if|elseif|for|foreach|while|case|catch|and|or)\b|\?(?!->|\?|:)[^;:?]*:(?!:)|&&|\|\||\?\?"),
    "ts": re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?\?|\?(?![.?:])[^;:]*:"),
}
_OPENS = re.compile(r"\b(?:if|elseif|else|for|foreach|while|switch|match|try|catch|do)\b[^{};]*\{")


def metrics(path: str, source: str) -> tuple[int, int, int, int, int]:
    """lines, cyclomatic complexity, deepest nesting of control blocks, methods, lines of the longest."""
    lines = source.count("\n") + 1
    php = path.endswith(".php")
    text = blank(blocks(source, "script") if path.endswith(".vue") else source, php)
    cyclomatic = 1 + len(_BRANCH["php" if php else "ts"].findall(text))
    control = {m.end() - 1 for m in _OPENS.finditer(text)}
    depth = deepest = 0
    stack = []
    for i, c in enumerate(text):
        if c == "{":
            stack.append(i in control)
            depth += stack[-1]
            deepest = max(deepest, depth)
        elif c == "}" and stack:
            depth -= stack.pop()
    fns = [m.end() for m in (_PHP_FN if php else re.compile(r"\bfunction\b[^(]*\([^)]*\)|=>\s*(?=\{)|^\s+(?:async\s+)?(?!if|for|while|switch|catch)\w+\([^)]*\)\s*(?=\{)", re.M)).finditer(text)]
    spans = [_body(text, e) for e in fns]
    longest = max((text.count("\n", a, b) + 1 for a, b in spans if b > a), default=0)
    return lines, cyclomatic, deepest, len(fns), longest


def code_metrics(files: DataFrame) -> DataFrame:
    """path, lines, cyclomatic, nesting, methods, longest_method."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(p, *metrics(p, s or "")) for p, s in zip(b["path"], b["source"])], columns=["path", "lines", "cyclomatic", "nesting", "methods", "longest_method"])

    return files.select("path", "source").mapInPandas(run, "path string, lines int, cyclomatic int, nesting int, methods int, longest_method int")
