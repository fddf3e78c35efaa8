"""Source files, workspaces, rule files, project configuration and saved signals."""

from __future__ import annotations

import glob
import json
import os
import re
import warnings
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = tuple(".js .php .ts .tsx .vue".split())
IGNORED = frozenset(".git node_modules vendor storage dist build coverage .nuxt .output".split())


def list_files(root: str, extensions: tuple[str, ...] = SOURCES, roots: tuple[str, ...] = ()) -> list[str]:
    """Paths below ``root`` with one of the extensions, sorted; dot folders and build folders are not entered."""
    out = []
    for start in roots or ("",):
        for folder, dirs, names in os.walk(os.path.join(root, start)):
            dirs[:] = sorted(d for d in dirs if d not in IGNORED and not d.startswith("."))
            out += [os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/") for n in names if n.endswith(extensions) and not n.startswith(".")]
    return sorted(set(out))


def read_sources(spark: SparkSession, root: str, extensions: tuple[str, ...] = SOURCES) -> DataFrame:
    """path, source of the files below ``root``, read by the executors; ``root`` may be any Hadoop folder."""
    pattern = "*.{" + ",".join(e.lstrip(".") for e in extensions) + "}"
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    rel = F.regexp_replace(full, "^" + re.escape(os.path.abspath(root)) + "/?", "")
    keep = ~rel.rlike("(?:^|/)(?:" + "|".join(re.escape(d) for d in sorted(IGNORED)) + ")/")
    return df.select(rel.alias("path"), F.col("value").alias("source")).where(keep)


def workspaces(root: str) -> list[str]:
    """Package folders of a workspace: npm or yarn ``workspaces``, or pnpm's list; a single level of ``*``. Without any, the root."""
    globs: list[str] = []
    package = Path(root) / "package.json"
    if package.exists():
        try:
            w = json.loads(package.read_text()).get("workspaces", [])
            globs += w.get("packages", []) if isinstance(w, dict) else w
        except (ValueError, AttributeError):
            pass
    pnpm = Path(root) / "pnpm-workspace.yaml"
    if pnpm.exists():
        globs += re.findall(r"^\s*-\s*['\"]?([^'\"\n]+?)['\"]?\s*$", pnpm.read_text(), re.M)
    found = {os.path.relpath(p, root) for g in globs for p in glob.glob(os.path.join(root, g)) if os.path.isdir(p)}
    return sorted(found) or ["."]


def _scalar(x: str):
    x = x.strip()
    if x.startswith("[") and x.endswith("]"):
        return [_scalar(y) for y in x[1:-1].split(",") if y.strip()]
    if x[:1] in "'\"" and x[-1:] == x[:1] and len(x) > 1:
        return x[1:-1]
    return {"true": True, "false": False, "null": None, "": None}.get(x, int(x) if re.fullmatch(r"-?\d+", x) else x)


def front_matter(text: str) -> tuple[dict, str]:
    """The header between two --- lines as a dict (scalars, lists, one level of maps), and the body."""
    m = re.match(r"\A-{3}[ \t\r]*\n(.*?)\n-{3}[ \t\r]*(?:\n|\Z)(.*)\Z", text, re.S)
    if not m:
        return {}, text
    out: dict = {}
    key = sub = None
    for line in m[1].splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        item = re.match(r"\s*-\s+(.*)", line)
        pair = re.match(r"\s*([\w-]+):\s*(.*)", line)
        if item and key is not None:
            holder, k = (out[key], sub) if sub is not None and isinstance(out[key], dict) else (out, key)
            if not isinstance(holder.get(k), list):
                holder[k] = []
            holder[k].append(_scalar(item[1]))
        elif pair and indent == 0:
            key, sub = pair[1], None
            out[key] = _scalar(pair[2])
        elif pair and key is not None:
            if not isinstance(out[key], dict):
                out[key] = {}
            sub = pair[1]
            out[key][sub] = _scalar(pair[2])
    return out, m[2]


REQUIRED = ("id", "title", "state", "confidence", "severity")


def load_rules(folders: list[str]) -> list[dict]:
    """Rules of all .mdc files below the folders, each file once; one that lacks a field is skipped with a warning.

    An experimental rule must name the date of its review.
    """
    out, seen = [], set()
    for folder in folders:
        for p in sorted(Path(folder).rglob("*.mdc")):
            if p.resolve() in seen:
                continue
            seen.add(p.resolve())
            head, body = front_matter(p.read_text())
            bad = [f for f in REQUIRED if head.get(f) in (None, "")] or (["review_due_at"] if head.get("state") == "experimental" and not (head.get("review_due_at") or head.get("reviewDueAt")) else [])
            if bad:
                warnings.warn(f"{p}: no {', '.join(bad)}", stacklevel=2)
                continue
            scope = head.get("scope") or {}
            out.append(head | {"globs": head.get("globs") or scope.get("globs") or [], "repos": scope.get("repos") or [], "applies_to": head.get("applies_to") or head.get("appliesTo") or [], "tags": head.get("tags") or [], "guidance": body.strip()})
    return out


CONFIG_KEYS = frozenset("profileOverride synonyms pathStopwords pathRoles edgeWeights alwaysInclude alwaysExclude confidenceBoosts volatility".split())


def load_config(repo: str, places: tuple[str, ...] = ("driftmap.config.json", ".driftmap/config.json")) -> dict:
    """The first configuration file that is valid; unknown keys make it invalid, which is a warning."""
    for place in places:
        p = Path(repo) / place
        if p.exists():
            try:
                c = json.loads(p.read_text())
                if not isinstance(c, dict) or set(c) - CONFIG_KEYS:
                    raise ValueError("unknown keys")
                return c
            except ValueError as e:
                warnings.warn(f"{p} is ignored: {e}", stacklevel=2)
    return {}


def detect_profile(repo: str, config: dict | None = None) -> str:
    """laravel, ts or null: the configuration's override first, then the manifests."""
    if (config or {}).get("profileOverride"):
        return config["profileOverride"]
    composer, package = Path(repo) / "composer.json", Path(repo) / "package.json"
    if (Path(repo) / "artisan").exists() or (composer.exists() and "laravel/framework" in composer.read_text()):
        return "laravel"
    return "ts" if package.exists() else "null"


def load_signals(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame | None]:
    """Saved signals by name (Parquet folder or JSON lines); one that can't be read is None and does not hinder the others."""
    out: dict[str, DataFrame | None] = {}
    for name, path in paths.items():
        try:
            out[name] = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
        except Exception as e:  # an absent or broken file of any kind  # noqa: BLE001
            warnings.warn(f"{name}: {e.__class__.__name__}", stacklevel=2)
            out[name] = None
    return out
