"""Commit corpus: the filter cascade, intent, ticket, body digest and counts.

A commit row has: sha, parent_shas, author, author_email, committed_at, subject, body, files,
additions, deletions, per_file (may be null) and ord, its place in the log, newest first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.functions.text import DEPENDENCY_PATH, DOCS_PATH, any_of


@dataclass(frozen=True)
class FilterConfig:
    mega_files: int = 50
    mega_lines: int = 2000
    exclude_docs_only: bool = True
    exclude_dependency_churn: bool = True
    bot_names: tuple[str, ...] = tuple("atlassian-bitbucket-pipelines dependabot github-actions renovate renovate-bot snyk-bot".split())
    bot_email_suffixes: tuple[str, ...] = tuple("-bot [bot] noreply@github.com renovate@whitesourcesoftware.com".split())


NOISE_SUBJECT = r"(?i)^\s*" + any_of(["chore", "fix", "merge", "revert", "typo", "update", "wip"]) + r"\s*[.!:]?\s*\z"
#: Intent of a conventional type, and of the branch type of a merge.
TYPES = {
    "fix": ("bugfix", "fix", "hotfix", "patch"),
    "feat": ("feat", "feature"),
    "docs": ("doc", "docs"),
    "test": ("test", "tests"),
    "perf": ("perf", "performance"),
    **{k: (k,) for k in ("build", "chore", "ci", "refactor", "revert", "style")},
}
MERGE_TYPES = {
    **{k: v for k, v in TYPES.items() if k not in ("perf", "revert", "style", "chore")},
    "perf": ("perf",),
    "chore": ("backmerge", "chore", "hotmerge", "release"),
}
CONVENTIONAL = r"(?i)^([a-z]+)(?:\(([^)]+)\))?!?:"
MERGED = r"(?i)^merged in ([a-z]+)(?:[/\s]|\z)"
#: Words that tell the intent of other subjects, in the order in which they are tried.
KEYWORDS = {
    "fix": r"fix(?:e[sd])?|bugs?|hotfix|regression|patch|resolve[ds]?|close[ds]?\s+#?\d+",
    "refactor": r"cleanup|extract|inline|rename|tidy|refactor(?:ing|ed|s)?|simplif[iy]",
    "test": r"tests?|specs?|coverage|jest|pest|phpunit|vitest",
    "perf": r"faster|optimi[sz]e[ds]?|performance|perf|speed(?:\s*up)?",
    "docs": r"docs?|changelog|comments?|readme",
    "style": r"style|format(?:ting)?|indent|linter?|whitespace|cs[ -]?fixer",
    "build": r"build|docker(?:-compose|file)?|esbuild|rollup|vite|webpack",
    "ci": r"ci|buildkite|deploy|github\s*actions|pipeline|release",
    "feat": r"add|feature|implement(?:s|ed)?|introduce[ds]?|support\s+for",
}
TICKET = r"\b([A-Z][A-Z0-9]+-[0-9]+)\b"
TRAILER = r"(?i)^(?:co-authored-by|reviewed-by|signed-off-by):"


def is_bot(author: Column, email: Column, cfg: FilterConfig = FilterConfig()) -> Column:
    name, mail = F.lower(F.trim(author)), F.lower(F.trim(email))
    return (
        name.isin(*cfg.bot_names)
        | name.endswith("[bot]")
        | name.endswith("-bot")
        | mail.contains("[bot]")
        | F.array_contains(F.array(*[mail.endswith(s) for s in cfg.bot_email_suffixes]), True)
    )


def exclusion_reason(cfg: FilterConfig = FilterConfig()) -> Column:
    """The first reason that drops a commit, or null: the order of the cases decides which one is counted."""
    every = lambda p: (F.size("files") > 0) & F.forall("files", lambda f: f.rlike(p))
    c = F.when(F.size("parent_shas") > 1, "merge_commit").when(is_bot(F.col("author"), F.col("author_email"), cfg), "bot_author")
    c = c.when(F.col("subject").rlike(NOISE_SUBJECT), "noise_subject").when(F.size("files") > cfg.mega_files, "mega_files")
    c = c.when(F.col("additions") + F.col("deletions") > cfg.mega_lines, "mega_lines")
    if cfg.exclude_docs_only:
        c = c.when(every(DOCS_PATH), "docs_only")
    if cfg.exclude_dependency_churn:
        c = c.when(every(DEPENDENCY_PATH), "dependency_churn")
    return c


def _type_map(types: dict[str, tuple[str, ...]], word: Column) -> Column:
    c = None
    for intent, names in types.items():
        c = (F if c is None else c).when(word.isin(*names), intent)
    return c


def intent(subject: Column) -> Column:
    """One of twelve intents: conventional type, revert prefix, merged branch type, keywords, else other."""
    s = F.trim(subject)
    c = F.coalesce(
        _type_map(TYPES, F.lower(F.regexp_extract(s, CONVENTIONAL, 1))),
        F.when(s.rlike(r"(?i)^revert\b"), "revert"),
        _type_map(MERGE_TYPES, F.lower(F.regexp_extract(s, MERGED, 1))),
    )
    k = None
    for name, words in KEYWORDS.items():
        k = (F if k is None else k).when(s.rlike(rf"(?i)\b(?:{words})\b"), name)
    return F.coalesce(c, k, F.lit("other"))


def scope(subject: Column) -> Column:
    """The scope of a conventional subject whose type is known, else null."""
    s = F.trim(subject)
    known = _type_map(TYPES, F.lower(F.regexp_extract(s, CONVENTIONAL, 1))).isNotNull()
    return F.when(known, F.nullif(F.trim(F.regexp_extract(s, CONVENTIONAL, 2)), F.lit("")))


def ticket(subject: Column, body: Column) -> Column:
    """The first ticket number of the subject, else of the body."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), TICKET, 1), F.lit("")) for x in (subject, body)])


def normal_body(body: Column) -> Column:
    """A body without carriage returns, trailers, spaces at line ends and newlines at its end."""
    lines = F.split(F.regexp_replace(F.coalesce(body, F.lit("")), "\r\n", "\n"), "\n")
    lines = F.filter(lines, lambda x: ~x.rlike(TRAILER))
    return F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\s+\z", "")), "\n"), r"\n+\z", "")


def body_digest(body: Column) -> Column:
    return F.sha2(normal_body(body), 256)


def with_reason(commits: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    return commits.withColumn("reason", exclusion_reason(cfg))


def build_corpus(commits: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """The kept commits with parent_sha, body_digest, ticket_id, scope and intent; the body stays for revert resolution."""
    kept = with_reason(commits, cfg).where("reason is null")
    return kept.select(
        "sha",
        F.get("parent_shas", F.lit(0)).alias("parent_sha"),
        "author",
        "author_email",
        "committed_at",
        "subject",
        "body",
        body_digest(F.col("body")).alias("body_digest"),
        "files",
        "additions",
        "deletions",
        "per_file",
        ticket(F.col("subject"), F.col("body")).alias("ticket_id"),
        scope(F.col("subject")).alias("scope"),
        intent(F.col("subject")).alias("intent"),
        "ord",
    )


def corpus_stats(commits: DataFrame, cfg: FilterConfig = FilterConfig()) -> DataFrame:
    """kind (total, kept, excluded, intent), name, n: one pass over the commits."""
    c = commits.select(exclusion_reason(cfg).alias("reason"), intent(F.col("subject")).alias("intent"))
    tags = F.array(
        F.struct(F.lit("total").alias("kind"), F.lit("all").alias("name")),
        F.when(F.col("reason").isNull(), F.struct(F.lit("kept").alias("kind"), F.lit("all").alias("name"))),
        F.when(F.col("reason").isNotNull(), F.struct(F.lit("excluded").alias("kind"), F.col("reason").alias("name"))),
        F.when(F.col("reason").isNull(), F.struct(F.lit("intent").alias("kind"), F.col("intent").alias("name"))),
    )
    return c.select(F.explode(F.array_compact(tags)).alias("t")).groupBy("t.kind", "t.name").agg(F.count("*").alias("n"))


def window(commits: DataFrame, since=None, until=None) -> DataFrame:
    """Commits from since to until, both included."""
    if since is not None:
        commits = commits.where(F.col("committed_at") >= F.lit(since))
    return commits if until is None else commits.where(F.col("committed_at") <= F.lit(until))


def ticket_history(corpus: DataFrame, ticket_id: str, cap: int = 30) -> DataFrame:
    """Distinct paths, in order, that the commits of a ticket touched."""
    hit = corpus.where(F.upper("ticket_id") == ticket_id.upper()).select(F.explode("files").alias("path"))
    return hit.distinct().orderBy("path").limit(cap)
