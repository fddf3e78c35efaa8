"""Reverts: which commit a revert undoes, chains of reverts, and counts per path.

A revert is resolved by three rules, the first that finds something: a commit hash named in
its body, the quoted subject (the latest strictly earlier commit of that subject), the body
digest (likewise). All three are equi-joins, the first on the 7-character prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.functions.text import EXCLUDED_PATH
from driftmap.session import saved

QUOTED = r'(?s)^\s*Revert "(.*)"\s*\z'
MENTION = r"(?i)\bthis\s+reverts\s+commit\s+([a-f0-9]{7,40})"


def latest_before(events: DataFrame, candidates: DataFrame, keys: list[str], id_: str = "id", at: str = "ts") -> DataFrame:
    """As-of join: for each event the latest candidate of equal keys that is strictly earlier: id, found, found_at.

    Ties in time go to the candidate with the smaller ``ord`` if there is one, else the smaller id.
    One shuffle on the keys, no pair of rows is made: both sides are sorted together and the
    last candidate before an event is carried along.
    """
    tie = "ord" if "ord" in candidates.columns else id_
    here = events.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.col(id_).alias("_event"), F.lit(None).cast(candidates.schema[id_].dataType).alias("_found"), F.lit(None).cast(candidates.schema[tie].dataType).alias("_tie"))
    there = candidates.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(events.schema[id_].dataType).alias("_event"), F.col(id_).alias("_found"), F.col(tie).alias("_tie"))
    # at one time events come first, so a candidate of the same time is not seen; of candidates the preferred one last
    w = Window.partitionBy(*keys).orderBy("_t", "_side", F.desc("_tie")).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_found").isNotNull(), F.struct(F.col("_found").alias("f"), F.col("_t").alias("t"))), ignorenulls=True).over(w)
    both = here.unionAll(there).withColumn("_last", last).where("_side = 0")
    return both.select(F.col("_event").alias("id"), F.col("_last.f").alias("found"), F.col("_last.t").alias("found_at"))


def is_revert(subject: Column, intent: Column) -> Column:
    return (intent == "revert") | subject.rlike(QUOTED)


def revert_links(corpus: DataFrame) -> DataFrame:
    """revert_sha, reverted_sha (null: unresolved), resolution, reverted_at, days_to_revert.

    Days below zero (a hash may name a later commit) become null with ``days_invalid`` set.
    """
    c = corpus.select("sha", "subject", "body", "body_digest", "committed_at", "intent", "ord")
    reverts = c.where(is_revert(F.col("subject"), F.col("intent")))
    named = reverts.select("sha", F.lower(F.regexp_extract(F.coalesce("body", F.lit("")), MENTION, 1)).alias("mention")).where("mention != ''")
    named = named.withColumn("head", F.substring("mention", 1, 7))
    by_head = c.select(F.col("sha").alias("target"), F.substring("sha", 1, 7).alias("head"), "ord")
    hit = named.join(by_head, "head").where(F.col("target").startswith(F.col("mention")))
    order = F.struct(F.col("target") != F.col("mention"), "ord", "target")
    by_sha = hit.groupBy("sha").agg(F.min_by("target", order).alias("s1"))

    quoted = reverts.withColumn("key", F.regexp_extract("subject", QUOTED, 1)).where(F.col("subject").rlike(QUOTED))
    by_subject = latest_before(
        quoted.select("key", F.col("sha").alias("id"), F.col("committed_at").alias("ts")),
        c.select(F.col("subject").alias("key"), F.col("sha").alias("id"), F.col("committed_at").alias("ts"), "ord"),
        ["key"],
    ).where("found is not null").select(F.col("id").alias("sha"), F.col("found").alias("s2"))
    by_digest = latest_before(
        reverts.select(F.col("body_digest").alias("key"), F.col("sha").alias("id"), F.col("committed_at").alias("ts")),
        c.select(F.col("body_digest").alias("key"), F.col("sha").alias("id"), F.col("committed_at").alias("ts"), "ord"),
        ["key"],
    ).where("found is not null").select(F.col("id").alias("sha"), F.col("found").alias("s3"))
    out = reverts.join(by_sha, "sha", "left").join(by_subject, "sha", "left").join(by_digest, "sha", "left")
    out = out.select(
        F.col("sha").alias("revert_sha"),
        F.col("committed_at").alias("reverted_at"),
        F.coalesce("s1", "s2", "s3").alias("reverted_sha"),
        F.when(F.col("s1").isNotNull(), "sha").when(F.col("s2").isNotNull(), "subject").when(F.col("s3").isNotNull(), "digest").otherwise("unresolved").alias("resolution"),
    )
    when = corpus.select(F.col("sha").alias("reverted_sha"), F.col("committed_at").alias("original_at"))
    out = out.join(when, "reverted_sha", "left")
    days = (F.unix_micros("reverted_at") - F.unix_micros("original_at")) / F.lit(86_400_000_000.0)
    return out.select("revert_sha", "reverted_sha", "resolution", "reverted_at", F.when(days >= 0, days).alias("days_to_revert"), F.coalesce(days < 0, F.lit(False)).alias("days_invalid"))


def chains(links: DataFrame) -> DataFrame:
    """root, step, id, role of chains of depth two or more; links: id, target, ts.

    A root is reverted but reverts nothing itself. From each commit the chain follows the
    earliest reverter (smallest id of equals) to its end, however long. One join for each step,
    over the chains that still grow; each front is a table, so no step is computed twice. A
    commit has one target (the smallest, if links name several), so no two steps lead to one
    commit and no chain can come back to itself.
    """
    links = links.where("target is not null").groupBy("id").agg(F.min(F.struct("target", "ts")).alias("m")).select("id", "m.target", "m.ts")
    links = saved(links, "links")
    nxt = links.groupBy("target").agg(F.min(F.struct("ts", "id")).alias("m")).select("target", F.col("m.id").alias("next"))
    roots = nxt.select(F.col("target").alias("root")).join(links.select(F.col("id").alias("root")), "root", "left_anti")
    front = saved(roots.select("root", F.lit(0).alias("step"), F.col("root").alias("id")), "front")
    nxt = saved(nxt, "next")
    done, step = front, 0
    while True:
        step += 1
        front = saved(front.join(nxt, front["id"] == nxt["target"]).select("root", F.lit(step).alias("step"), F.col("next").alias("id")), "front")
        if front.isEmpty():
            break
        done = done.unionAll(front)
    role = F.when(F.col("step") == 0, "original").when(F.col("step") % 2 == 1, "revert").otherwise("reapply")
    return done.withColumn("role", role)


def chain_summary(chain_rows: DataFrame) -> DataFrame:
    """root, depth, has_reapply."""
    return chain_rows.groupBy("root").agg(F.count("*").alias("depth"), F.max(F.col("role") == "reapply").alias("has_reapply"))


def path_stats(touches: DataFrame, links: DataFrame, chain_rows: DataFrame, exclude: str | None = EXCLUDED_PATH) -> DataFrame:
    """path, commits, reverts, density, median_days, chains, last_reverted_at of every path that a revert undid.

    touches: commit_id, path; links: id, target, ts, days; chain_rows: as ``chains`` gives them.
    Reverts count a path as often as the undone commit lists it, commits count it once.
    """
    t = touches if exclude is None else touches.where(~F.col("path").rlike(exclude))
    commits = t.select("commit_id", "path").distinct().groupBy("path").agg(F.count("*").alias("commits"))
    undone = links.where("target is not null").join(t, F.col("target") == F.col("commit_id"))
    r = undone.groupBy("path").agg(F.count("*").alias("reverts"), F.median("days").alias("median_days"), F.max("ts").alias("last_reverted_at"))
    inside = chain_rows.join(t, F.col("id") == F.col("commit_id")).groupBy("path").agg(F.countDistinct("root").alias("chains"))
    out = r.join(commits, "path").join(inside, "path", "left")
    return out.select("path", "commits", "reverts", F.least(F.lit(1.0), F.col("reverts") / F.col("commits")).alias("density"), "median_days", F.coalesce("chains", F.lit(0)).alias("chains"), "last_reverted_at")
