"""The corpus cache: Parquet by key, pruning, and a pointer to the current key."""

from __future__ import annotations

import hashlib
import json
import shutil
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Part of every key: raise it when the filter's rules change.
FILTER_VERSION = "1"
DAY = 86_400


def cache_key(head: str | None, since: str | None) -> str:
    """Head, a hash of the window's start (as a date, so that a relative start hits for a day) and the filter's version."""
    start = hashlib.sha256((since or "")[:10].encode()).hexdigest()[:8]
    return f"{(head or 'nohead')[:8]}-{start}-v{FILTER_VERSION}"


def cached(spark: SparkSession, folder: str, head: str | None, since: str | None, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The corpus of a key, built and written if it is missing; without a head it holds for a day."""
    key = cache_key(head, since)
    at = Path(folder) / f"key={key}"
    fresh = (at / "_SUCCESS").exists() and (head is not None or time.time() - (at / "_SUCCESS").stat().st_mtime < DAY)
    if rebuild or not fresh:
        build().write.mode("overwrite").parquet(str(at))
        (Path(folder) / "current.json").write_text(json.dumps({"key": key, "head": head, "written": int(time.time())}))
        prune(folder, key)
    return spark.read.parquet(str(at))


def prune(folder: str, current: str, days: float = 30, keep: int = 5) -> list[str]:
    """Removes entries older than ``days``, and all but the newest ``keep``; never the current one."""
    entries = sorted(Path(folder).glob("key=*"), key=lambda p: -p.stat().st_mtime)
    gone = [p for i, p in enumerate(entries) if p.name != f"key={current}" and (i >= keep or time.time() - p.stat().st_mtime > days * DAY)]
    for p in gone:
        shutil.rmtree(p)
    return [p.name for p in gone]


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.write.mode("overwrite").parquet(f"{folder}/edges")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
