"""Retrieval: BM25 over commit texts, lexical match of prompts and paths, synonyms. Many prompts at once.

Both work on an inverted index: tokens of documents joined with tokens of prompts, so cost
follows the matches. Scores are rounded to six places before they rank anything, because
sums of floats depend on the order in which partitions arrive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmap.functions.text import NOISE_PATH, path_tokens
from driftmap.session import saved

K1, B = 1.5, 0.75


def bm25(docs: DataFrame, prompts: DataFrame) -> DataFrame:
    """prompt, doc, bm25 of every pair that shares a token. docs: doc, tokens; prompts: prompt, tokens.

    Only tokens that some prompt has are counted and shuffled; ``docs`` is best a table that holds its tokens.
    """
    q = prompts.select("prompt", F.explode(F.array_distinct("tokens")).alias("token"))
    size = docs.select("doc", F.size("tokens").alias("dl"), "tokens")
    whole = size.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    tf = size.select("doc", "dl", F.explode("tokens").alias("token")).join(q.select("token").distinct(), "token", "left_semi")
    tf = saved(tf.groupBy("doc", "token", "dl").agg(F.count("*").alias("tf")), "token-counts")
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    q = q.join(df, "token").crossJoin(F.broadcast(whole))
    q = q.withColumn("idf", F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    hit = tf.join(q, "token")
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return hit.groupBy("prompt", "doc").agg(F.round(F.sum(F.col("idf") * part), 6).alias("bm25"))


def corpus_scores(docs: DataFrame, prompts: DataFrame, as_of: str, half_life: float = 180, intent_boost: float = 0.1, path_boost: float = 0.3, top_k: int = 7) -> DataFrame:
    """prompt, doc, score, rank: BM25 with a bonus for path words, recency and intent.

    docs: doc, tokens, path_tokens, committed_at, intent, ord; prompts: prompt, title, tokens.
    """
    base = bm25(docs, prompts)
    path = docs.select("doc", F.explode(F.array_distinct("path_tokens")).alias("token"))
    q = prompts.select("prompt", F.explode(F.array_distinct("tokens")).alias("token"))
    bonus = path.join(q, "token").groupBy("prompt", "doc").agg(F.least(F.lit(3 * path_boost), F.count("*") * path_boost).alias("bonus"))
    s = base.join(bonus, ["prompt", "doc"], "left").join(docs.select("doc", "committed_at", "intent", "ord"), "doc").join(prompts.select("prompt", "title"), "prompt")
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("committed_at")) / F.lit(86_400_000_000.0)
    title = F.lower("title")
    wants_fix = title.rlike(r"\b(?:bug|broken|error|fix|issue)\b")
    wants_feat = title.rlike(r"\b(?:add|create|feat|implement|new)\b")
    boost = F.when((wants_fix & (F.col("intent") == "fix")) | (wants_feat & (F.col("intent") == "feat")), intent_boost).otherwise(0.0)
    score = (F.col("bm25") + F.coalesce("bonus", F.lit(0.0))) * (1 + 0.2 * F.pow(F.lit(0.5), age / half_life)) + boost
    w = Window.partitionBy("prompt").orderBy(F.desc("score"), "ord")
    return s.select("prompt", "doc", "ord", F.round(score, 6).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def corpus_paths(top: DataFrame, touches: DataFrame) -> DataFrame:
    """prompt, path, weighted, support, confidence, rank: the paths of the top documents, each with its share of their scores.

    touches: doc, path, file_ord. The median is the upper one of an even number.
    """
    n = touches.groupBy("doc").agg(F.count("*").alias("files"))
    t = top.join(touches, "doc").join(n, "doc").where(~F.col("path").rlike(NOISE_PATH))
    p = t.groupBy("prompt", "path").agg(F.round(F.sum(F.col("score") / F.col("files")), 8).alias("weighted"), F.count("*").alias("support"), F.min(F.struct("rank", "file_ord")).alias("first"))
    by = Window.partitionBy("prompt")
    p = p.withColumn("n", F.count("*").over(by)).withColumn("r", F.row_number().over(by.orderBy("weighted", "path")))
    p = p.withColumn("median", F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("weighted"))).over(by))
    conf = F.when((F.col("support") >= 2) & (F.col("weighted") >= F.col("median") * 1.25), "high").when(F.col("weighted") >= F.col("median"), "medium").otherwise("low")
    p = p.withColumn("confidence", conf).withColumn("rank", F.row_number().over(by.orderBy(F.desc("weighted"), "first")))
    return p.select("prompt", "path", "weighted", "support", "confidence", "rank")


def with_synonyms(prompts: DataFrame, groups: DataFrame) -> DataFrame:
    """prompt, token: the prompts' tokens and all members of the groups that name them (one step, not transitive). groups: token, grp."""
    q = prompts.select("prompt", F.explode("tokens").alias("token")).distinct()
    other = groups.alias("g").join(groups.select(F.col("token").alias("more"), "grp").alias("h"), F.col("g.grp") == F.col("h.grp")).select("token", "more")
    return q.unionAll(q.join(other, "token").select("prompt", F.col("more").alias("token"))).distinct()


def lexical(query: DataFrame, paths: DataFrame, stopwords: list[str] = (), name_weight: float = 2, min_score: float = 1, top_k: int = 15) -> DataFrame:
    """prompt, path, score, confidence, rank; query: prompt, token; paths: path. A word in the file's name counts twice one in its folders."""
    every, name = path_tokens(F.col("path"))
    p = paths.where(~F.col("path").rlike(NOISE_PATH)).distinct()
    t = p.select("path", F.explode(F.array_distinct(every)).alias("token"), name.alias("name"))
    t = t.select("path", "token", F.when(F.array_contains("name", F.col("token")), F.lit(float(name_weight))).otherwise(1.0).alias("w"))
    q = query.where(~F.col("token").isin(*stopwords)) if stopwords else query
    s = t.join(q.distinct(), "token").groupBy("prompt", "path").agg(F.sum("w").alias("score")).where(F.col("score") >= min_score)
    w = Window.partitionBy("prompt").orderBy(F.desc("score"), "path")
    s = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return s.withColumn("confidence", F.when(F.col("score") >= 2, "medium").otherwise("low"))
