"""Git history as DataFrames: two text captures, parsed in Spark.

``capture`` runs the two log commands once and writes their output; everything after that is
Spark. Metadata records end in NUL and have seven fields split by 0x1F; numstat blocks begin
with ``CM<sha>`` on a line of its own.
"""

from __future__ import annotations

import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("%H", "%P", "%aN", "%aE", "%cI", "%s", "%B")


def log_args(kind: str, since: str | None = None, until: str | None = None) -> list[str]:
    """Arguments of one of the two passes ('meta' or 'numstat'); times are pushed down to git."""
    args = "log --first-parent --no-color".split()
    args += [f"--since={since}"] if since else []
    args += [f"--until={until}"] if until else []
    if kind == "meta":
        return [*args, "-z", "--format=" + "%x1f".join(FIELDS)]
    return [*args, "--numstat", "--no-renames", "--format=CM%H"]


def capture(repo: str, out: str, since: str | None = None, until: str | None = None, run=subprocess.run) -> tuple[str, str]:
    """Writes both outputs below ``out`` and returns their paths. ``run`` is a seam for tests."""
    Path(out).mkdir(parents=True, exist_ok=True)
    paths = []
    for kind in ("meta", "numstat"):
        path = Path(out) / f"{kind}.txt"
        with path.open("wb") as f:
            run(["git", "-C", repo, *log_args(kind, since, until)], stdout=f, check=True, timeout=300)
        paths.append(str(path))
    return paths[0], paths[1]


def parse_metadata(records: DataFrame) -> DataFrame:
    """sha, parent_shas, author, author_email, committed_at, subject, body of raw records (column value).

    Records with fewer than seven fields, a short hash or a bad date are dropped; a body keeps
    what separators it holds, without carriage returns and newlines at its end.
    """
    f = F.split("value", "\u001f")
    r = records.select(f.alias("f")).where(F.size("f") >= 7)
    sha = F.trim(F.regexp_replace(F.get("f", F.lit(0)), "^\\s+", ""))
    body = F.array_join(F.slice("f", 7, F.size("f")), "\u001f")
    r = r.select(
        sha.alias("sha"),
        F.filter(F.split(F.trim(F.get("f", F.lit(1))), " "), lambda p: p != "").alias("parent_shas"),
        F.get("f", F.lit(2)).alias("author"),
        F.get("f", F.lit(3)).alias("author_email"),
        F.try_to_timestamp(F.trim(F.get("f", F.lit(4)))).alias("committed_at"),
        F.get("f", F.lit(5)).alias("subject"),
        F.regexp_replace(F.regexp_replace(body, "\r\n", "\n"), r"\n+\z", "").alias("body"),
    )
    return r.where((F.length("sha") >= 7) & F.col("committed_at").isNotNull())


def parse_numstat(blocks: DataFrame) -> DataFrame:
    """sha, files, per_file, additions, deletions of blocks (column value: one commit's lines, the first its hash).

    A dash counts 0; a path may hold tabs; lines of another form are ignored.
    """
    line = F.split("value", "\n")
    b = blocks.select(F.regexp_extract("value", r"^(?:CM)?([0-9a-f]{7,64})", 1).alias("sha"), line.alias("l")).where("sha != ''")
    stat = F.filter("l", lambda x: x.rlike(r"^(?:[0-9]+|-)\t(?:[0-9]+|-)\t."))
    number = lambda x: F.coalesce(x.try_cast("long"), F.lit(0).cast("long"))
    per = F.transform(
        stat,
        lambda x: F.struct(
            F.regexp_extract(x, r"^[^\t]+\t[^\t]+\t(.*)$", 1).alias("path"),
            number(F.regexp_extract(x, r"^([^\t]+)", 1)).alias("additions"),
            number(F.regexp_extract(x, r"^[^\t]+\t([^\t]+)", 1)).alias("deletions"),
        ),
    )
    total = lambda f: F.aggregate("per_file", F.lit(0).cast("long"), lambda acc, d: acc + d[f])
    return b.select("sha", per.alias("per_file")).select("sha", F.transform("per_file", lambda d: d["path"]).alias("files"), "per_file", total("additions").alias("additions"), total("deletions").alias("deletions"))


def read_commits(spark: SparkSession, meta: str, numstat: str) -> DataFrame:
    """Commits with ord, their place in the log (0: newest). Missing numstat means no files and no lines."""
    m = parse_metadata(spark.read.text(meta, lineSep="\0"))
    n = parse_numstat(spark.read.text(numstat, lineSep="\nCM"))
    c = m.withColumn("_place", F.monotonically_increasing_id()).join(n, "sha", "left")
    none = F.array().cast("array<string>")
    return c.select(
        *[x for x in m.columns],
        F.coalesce("files", none).alias("files"),
        "per_file",
        F.coalesce("additions", F.lit(0).cast("long")).alias("additions"),
        F.coalesce("deletions", F.lit(0).cast("long")).alias("deletions"),
        F.col("_place").alias("ord"),
    )
