"""Queries over commits: co-change, volatility, corpus, reverts; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftmap.functions.text import DEPENDENCY_PATH, DOCS_PATH
from driftmap.operators import cochange, corpus, reverts, volatility
from driftmap.plans.bindings import AS_OF, commits1, events, sql, touches1, touches2, work1
from driftmap.session import table

QUERIES, ORACLE = {}, {}


def query(oracle: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return put


def pairs_sql(touches: str, min_joint: int, min_coupling: float, most: int | None = 50) -> str:
    """CTEs base, n, p: items, their counts, the pairs that pass."""
    keep = "" if most is None else f" AND commit_id IN (SELECT commit_id FROM base GROUP BY 1 HAVING count(*) FILTER (path IN (SELECT path FROM n WHERE c >= {min_joint})) <= {most})"
    return f"""WITH base AS (SELECT DISTINCT commit_id, path FROM {touches}),
        n AS (SELECT path, count(*) AS c FROM base GROUP BY 1),
        small AS (SELECT * FROM base WHERE true{keep}),
        j AS (SELECT x.path AS a, y.path AS b, count(*) AS joint FROM small x JOIN small y ON x.commit_id = y.commit_id AND x.path < y.path GROUP BY 1, 2),
        p AS (SELECT a, b, joint, na.c AS a_commits, nb.c AS b_commits, joint::DOUBLE / least(na.c, nb.c) AS coupling
              FROM j JOIN n na ON na.path = a JOIN n nb ON nb.path = b WHERE joint >= {min_joint} AND joint::DOUBLE / least(na.c, nb.c) >= {min_coupling})"""


TOP = """m AS (SELECT anchor, neighbor, joint, coupling, row_number() OVER (PARTITION BY anchor ORDER BY coupling DESC, joint DESC, neighbor) AS rank
    FROM (SELECT a AS anchor, b AS neighbor, joint, coupling FROM p UNION ALL SELECT b, a, joint, coupling FROM p))"""
_MATRIX = "SELECT anchor, neighbor, joint, round(coupling, 6) AS coupling, rank FROM m WHERE rank <= 10"


def _matrix(m):
    return m.select("anchor", "neighbor", "joint", F.round("coupling", 6).alias("coupling"), F.col("rank").cast("long").alias("rank"))


def matrix2(spark, d):
    """The flagship matrix: names of parts that customers buy together."""
    return cochange.co_change(touches2(spark, d), max_files=None, exclude=None)


@query(sql("touches2", pairs_sql("touches2", 3, 0.3, None) + f", {TOP} {_MATRIX}"))
def cochange_all(spark, d):
    return _matrix(matrix2(spark, d))


@query(sql("touches1", pairs_sql("touches1", 2, 0.05) + f", {TOP} {_MATRIX}"))
def cochange_sparse(spark, d):
    return _matrix(cochange.co_change(touches1(spark, d), min_joint=2, min_coupling=0.05, exclude=None))


def _view_sql(view: str) -> str:
    t = "touches1" if view == "all" else f"(SELECT t.* FROM touches1 t JOIN commits1 USING (commit_id) WHERE intent = '{view}')"
    return sql("commits1 touches1", pairs_sql(t, 2, 0.05) + f", {TOP} SELECT '{view}' AS view, anchor, neighbor, joint, round(coupling, 6) AS coupling, rank FROM m WHERE rank <= 10")


_VIEWS = " UNION ALL ".join(f"SELECT * FROM ({_view_sql(v)})" for v in ("all", "fix", "feat"))


def _views(spark, d):
    return cochange.views(commits1(spark, d), touches1(spark, d), min_joint=2, min_coupling=0.05, exclude=None)


@query(_VIEWS)
def cochange_views(spark, d):
    v = _views(spark, d)
    return v.select("view", "anchor", "neighbor", "joint", F.round("coupling", 6).alias("coupling"), F.col("rank").cast("long").alias("rank"))


@query(
    sql(
        "commits1",
        f"""SELECT c.view, coalesce(anchors, 0) AS anchors, coalesce(directed_pairs, 0) AS directed_pairs, commits FROM
        (SELECT 'all' AS view, count(*) AS commits FROM commits1 UNION ALL SELECT intent, count(*) FROM commits1 WHERE intent <> 'other' GROUP BY 1) c
        LEFT JOIN (SELECT view, count(DISTINCT anchor) AS anchors, count(*) AS directed_pairs FROM ({_VIEWS}) GROUP BY 1) USING (view)""",
    )
)
def cochange_stats(spark, d):
    return cochange.view_stats(commits1(spark, d), _views(spark, d))


# --- volatility


def floor_pct_sql(source: str, value: str, q: float) -> str:
    return f"(SELECT v FROM (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS i, count(*) OVER () AS n FROM {source}) WHERE i = least(n - 1, floor(n * {q})))"


VOLATILITY_SQL = f"""WITH au AS (SELECT path, author, count(*) AS k FROM work1 GROUP BY 1, 2),
    r AS (SELECT path, count(*) AS commits, sum(additions) AS lines_added, sum(deletions) AS lines_deleted, min(committed_at) AS f, max(committed_at) AS l,
            count(*) FILTER (intent = 'fix') AS fix_commits FROM work1 GROUP BY 1),
    t AS (SELECT path, max(k) AS top FROM au GROUP BY 1),
    c AS (SELECT r.*, top, fix_commits::DOUBLE / commits AS bug_fix_density,
            least(1.0, commits::DOUBLE / nullif({floor_pct_sql("r", "commits", 0.95)}, 0)) AS churn,
            least(1.0, fix_commits::DOUBLE / (commits + 5)) AS bug_density,
            CASE WHEN commits <= 1 THEN 0 ELSE 1 - (top::DOUBLE / commits) * (top::DOUBLE / commits) END AS ownership,
            CASE WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(l) <= 180 * 86400 THEN 1.0 WHEN epoch(TIMESTAMP '{AS_OF}') - epoch(l) <= 540 * 86400 THEN 0.5 ELSE 0.2 END AS recency,
            CASE WHEN commits < 5 THEN commits / 5.0::DOUBLE ELSE 1.0 END AS dampener FROM r JOIN t USING (path)),
    s AS (SELECT *, greatest(0.0, least(1.0, (0.35::DOUBLE * churn + 0.3::DOUBLE * bug_density + 0.15::DOUBLE * ownership + 0.2::DOUBLE * recency) * dampener)) AS raw_risk FROM c),
    e AS (SELECT * FROM s WHERE commits >= 5),
    v AS (SELECT *, raw_risk / CASE WHEN ref > 0 THEN ref ELSE 1 END AS scaled FROM s, (SELECT CASE WHEN (SELECT count(*) FROM e) > 0 THEN {floor_pct_sql("e", "raw_risk", 0.95)} ELSE {floor_pct_sql("s", "raw_risk", 0.95)} END AS ref))"""
_VOL = """SELECT path, commits, CAST(lines_added AS BIGINT) AS lines_added, CAST(lines_deleted AS BIGINT) AS lines_deleted, CAST(floor(epoch(f)) AS BIGINT) AS first_s, CAST(floor(epoch(l)) AS BIGINT) AS last_s, fix_commits,
    round(bug_fix_density, 6) AS bug_fix_density, round(raw_risk, 6) AS raw_risk, round({score}, 6) AS risk_score FROM v"""


def risk1(spark, d, normalize=True):
    return volatility.volatility(work1(spark, d), AS_OF, normalize=normalize)


def _volatility(v):
    keep = [F.col(c) for c in ("path", "commits", "lines_added", "lines_deleted", "fix_commits")]
    return v.select(*keep, F.unix_seconds("first_touched").alias("first_s"), F.unix_seconds("last_touched").alias("last_s"), *(F.round(c, 6).alias(c) for c in ("bug_fix_density", "raw_risk", "risk_score")))


@query(sql("commits1 touches1 work1", VOLATILITY_SQL + _VOL.format(score="least(1.0, scaled)")))
def volatility_percentile(spark, d):
    return _volatility(risk1(spark, d))


@query(sql("commits1 touches1 work1", VOLATILITY_SQL + _VOL.format(score="raw_risk")))
def volatility_raw(spark, d):
    return _volatility(risk1(spark, d, False))


@query(
    sql(
        "commits1 touches1 work1",
        """SELECT path, author, commits, CAST(floor(epoch(l)) AS BIGINT) AS last_s, rank FROM (SELECT path, author, count(*) AS commits, max(committed_at) AS l,
        row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, max(committed_at) DESC, author) AS rank FROM work1 GROUP BY 1, 2) WHERE rank <= 5""",
    )
)
def top_authors(spark, d):
    a = volatility.top_authors(work1(spark, d))
    return a.select("path", "author", "commits", F.unix_seconds("last").alias("last_s"), F.col("rank").cast("long").alias("rank"))


# --- corpus

_SUBJECTS = [
    "feat(cart): add totals", "Fix: rounding of totals", "hotfix!: broken session", "Revert \"feat(cart): add totals\"", "wip", "Merged in bugfix/v3/ABC-12_totals (pull request #4)",
    "Merged in release/2 (pull request #9)", "refactor the order page", "speed up the listing", "PROJ-77 update readme", "bump webpack", "deploy to staging", "introduce coupons",
    "docs: how to deploy", "odd: nothing known", "style(css): indent", "merge.", "closes #12 at last", "perf(db): fewer queries", "Typo!", "test(api): cover edge cases", "nothing in particular",
]
_AUTHORS = ["ana", "Bo", "dependabot", "cy[bot]", "deploy-bot", "dee", "eli", "flo", "gus", "hal"]
_FILES = ["app/Order.php", "docs/guide.md", "composer.lock", "src/cart.ts", "README.md", "package.json", "app/Http/Cart.php", "notes/todo.txt"]
_BODIES = ["first line\r\nsecond line  \n\nSigned-off-by: A <a@x.y>\n", "refs DEV-4 and DEV-5\n\n\n", "", "plain\nCo-authored-by: B\nlast   "]


def messages(spark, d):
    """Commits with made-up messages, one for each order."""
    o = table(spark, d, "orders")
    pick = lambda xs, step=1: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.floor(F.col("o_orderkey") / step) % len(xs) + 1).cast("int"))
    k = F.col("o_orderkey")
    return o.select(
        k.alias("sha"),
        F.when(k % 11 == 0, F.array(F.lit("p"), F.lit("q"))).otherwise(F.array(F.lit("p"))).alias("parent_shas"),
        pick(_AUTHORS, 3).alias("author"),
        F.when(k % 29 == 0, "x@users.noreply@github.com").otherwise("dev@example.org").alias("author_email"),
        F.col("o_orderdate").cast("timestamp").alias("committed_at"),
        pick(_SUBJECTS).alias("subject"),
        pick(_BODIES, 7).alias("body"),
        F.slice(F.array(*[F.lit(f) for f in _FILES]), (k % 7 + 1).cast("int"), (F.floor(k / 7) % 3).cast("int")).alias("files"),
        (k % 1500).alias("additions"),
        (k % 900).alias("deletions"),
        F.lit(None).cast("array<struct<path:string,additions:bigint,deletions:bigint>>").alias("per_file"),
        k.alias("ord"),
    )


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''").replace("\r", "§r").replace("\n", "§n") + "'" for x in xs) + "]"


def _pick(xs, step=1) -> str:
    return f"replace(replace(({_list(xs)})[(o_orderkey // {step}) % {len(xs)} + 1], '§r', chr(13)), '§n', chr(10))"


_MESSAGES = f"""messages AS (SELECT o_orderkey AS sha, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END AS parents, {_pick(_AUTHORS, 3)} AS author,
    CASE WHEN o_orderkey % 29 = 0 THEN 'x@users.noreply@github.com' ELSE 'dev@example.org' END AS email, {_pick(_SUBJECTS)} AS subject, {_pick(_BODIES, 7)} AS body,
    ({_list(_FILES)})[o_orderkey % 7 + 1 : o_orderkey % 7 + (o_orderkey // 7) % 3] AS files, o_orderkey % 1500 + o_orderkey % 900 AS changed FROM orders)"""


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _all_files(p: str) -> str:
    return f"(len(files) > 0 AND len(list_filter(files, lambda f: regexp_matches(f, {_q(p)}))) = len(files))"


_CFG = corpus.FilterConfig()
_REASON = f"""CASE WHEN parents > 1 THEN 'merge_commit'
    WHEN lower(trim(author)) IN ({", ".join(map(_q, _CFG.bot_names))}) OR lower(trim(author)) LIKE '%[bot]' OR lower(trim(author)) LIKE '%-bot' OR contains(lower(email), '[bot]')
        OR {" OR ".join(f"suffix(lower(trim(email)), {_q(s)})" for s in _CFG.bot_email_suffixes)} THEN 'bot_author'
    WHEN regexp_matches(subject, {_q(corpus.NOISE_SUBJECT)}) THEN 'noise_subject' WHEN len(files) > 50 THEN 'mega_files' WHEN changed > 2000 THEN 'mega_lines'
    WHEN {_all_files(DOCS_PATH)} THEN 'docs_only' WHEN {_all_files(DEPENDENCY_PATH)} THEN 'dependency_churn' END"""


def _types(types, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} IN ({', '.join(map(_q, v))}) THEN '{k}'" for k, v in types.items()) + " END"


_CONV = f"lower(regexp_extract(trim(subject), {_q(corpus.CONVENTIONAL)}, 1))"
_INTENT = f"""coalesce({_types(corpus.TYPES, _CONV)}, CASE WHEN regexp_matches(trim(subject), '(?i)^revert\\b') THEN 'revert' END,
    {_types(corpus.MERGE_TYPES, f"lower(regexp_extract(trim(subject), {_q(corpus.MERGED)}, 1))")},
    CASE {" ".join(f"WHEN regexp_matches(trim(subject), {_q(rf'(?i){chr(92)}b(?:{w}){chr(92)}b')}) THEN '{k}'" for k, w in corpus.KEYWORDS.items())} END, 'other')"""


@query(f"WITH {_MESSAGES} SELECT sha, {_REASON} AS reason FROM messages")
def corpus_filter_cascade(spark, d):
    return corpus.with_reason(messages(spark, d)).select("sha", "reason")


@query(
    f"""WITH {_MESSAGES}, x AS (SELECT {_REASON} AS reason, {_INTENT} AS intent FROM messages)
    SELECT 'total' AS kind, 'all' AS name, count(*) AS n FROM x UNION ALL SELECT 'kept', 'all', count(*) FROM x WHERE reason IS NULL
    UNION ALL SELECT 'excluded', reason, count(*) FROM x WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'intent', intent, count(*) FROM x WHERE reason IS NULL GROUP BY intent"""
)
def corpus_stats(spark, d):
    return corpus.corpus_stats(messages(spark, d))


@query(
    f"""WITH {_MESSAGES} SELECT sha, {_INTENT} AS intent, CASE WHEN {_types(corpus.TYPES, _CONV)} IS NOT NULL THEN nullif(trim(regexp_extract(trim(subject), {_q(corpus.CONVENTIONAL)}, 2)), '') END AS scope FROM messages"""
)
def intent_classify(spark, d):
    return messages(spark, d).select("sha", corpus.intent(F.col("subject")).alias("intent"), corpus.scope(F.col("subject")).alias("scope"))


@query(f"WITH {_MESSAGES} SELECT sha, coalesce(nullif(regexp_extract(subject, {_q(corpus.TICKET)}, 1), ''), nullif(regexp_extract(body, {_q(corpus.TICKET)}, 1), '')) AS ticket FROM messages")
def ticket_extract(spark, d):
    return messages(spark, d).select("sha", corpus.ticket(F.col("subject"), F.col("body")).alias("ticket"))


_DIGEST = f"""sha256(regexp_replace(array_to_string(list_transform(list_filter(string_split(replace({{0}}, chr(13) || chr(10), chr(10)), chr(10)), lambda x: NOT regexp_matches(x, {_q(corpus.TRAILER)})),
    lambda x: regexp_replace(x, '\\s+\\z', '')), chr(10)), '\\n+\\z', ''))"""


@query(f"WITH {_MESSAGES} SELECT sha AS id, 'message' AS kind, {_DIGEST.format('body')} AS digest FROM messages UNION ALL SELECT doc_id, 'document', {_DIGEST.format('text')} FROM documents")
def body_digest(spark, d):
    m = messages(spark, d).select(F.col("sha").alias("id"), F.lit("message").alias("kind"), corpus.body_digest(F.col("body")).alias("digest"))
    return m.unionAll(table(spark, d, "documents").select("doc_id", F.lit("document"), corpus.body_digest(F.col("text"))))


@query(
    f"""WITH {_MESSAGES} SELECT DISTINCT unnest(files) AS path FROM messages
    WHERE {_REASON} IS NULL AND coalesce(nullif(regexp_extract(subject, {_q(corpus.TICKET)}, 1), ''), nullif(regexp_extract(body, {_q(corpus.TICKET)}, 1), '')) = 'PROJ-77' ORDER BY 1 LIMIT 30"""
)
def ticket_history(spark, d):
    return corpus.ticket_history(corpus.build_corpus(messages(spark, d)), "proj-77")


# --- reverts


def revert_targets(spark, d):
    """id, target, ts, days: an error event undoes the latest earlier other event of its user and properties."""
    e = events(spark, d)
    ev = e.where("event_type = 'error'").select("user_id", "props", F.col("event_id").alias("id"), "ts")
    cand = e.where("event_type <> 'error'").select("user_id", "props", F.col("event_id").alias("id"), "ts")
    found = reverts.latest_before(ev, cand, ["user_id", "props"])
    days = (F.unix_micros("ts") - F.unix_micros("found_at")) / F.lit(86_400_000_000.0)
    return found.join(ev.select("id", "ts"), "id").select("id", F.col("found").alias("target"), "ts", days.alias("days"))


def chain_links(spark, d):
    """As revert_targets, but undone events may be errors themselves, so that chains come about."""
    e = events(spark, d)
    ev = e.where("event_type = 'error'").select("user_id", "props", F.col("event_id").alias("id"), "ts")
    cand = e.select("user_id", "props", F.col("event_id").alias("id"), "ts")
    found = reverts.latest_before(ev, cand, ["user_id", "props"])
    days = (F.unix_micros("ts") - F.unix_micros("found_at")) / F.lit(86_400_000_000.0)
    return found.join(ev.select("id", "ts"), "id").select("id", F.col("found").alias("target"), "ts", days.alias("days"))


def _links_sql(any_type: bool) -> str:
    cand = "" if any_type else " AND c.event_type <> 'error'"
    return f"""links AS (SELECT id, target, ts, CASE WHEN target IS NOT NULL THEN (epoch_us(ts) - epoch_us(found_at)) / 86400000000.0::DOUBLE END AS days FROM
        (SELECT e.event_id AS id, e.ts AS ts, c.event_id AS target, c.ts AS found_at, row_number() OVER (PARTITION BY e.event_id ORDER BY c.ts DESC, c.event_id) AS r
         FROM events e LEFT JOIN events c ON c.user_id = e.user_id AND c.props = e.props AND c.ts < e.ts{cand} WHERE e.event_type = 'error') WHERE r = 1)"""


_CHAINS = """nxt AS (SELECT target, id AS next FROM (SELECT target, id, row_number() OVER (PARTITION BY target ORDER BY ts, id) AS r FROM links WHERE target IS NOT NULL) WHERE r = 1),
    walk AS (SELECT target AS root, 0 AS step, target AS id FROM nxt WHERE target NOT IN (SELECT id FROM links WHERE target IS NOT NULL)
             UNION ALL SELECT root, step + 1, next FROM walk JOIN nxt ON nxt.target = walk.id)"""


@query(f"WITH {_links_sql(False)} SELECT id, target, round(days, 6) AS days FROM links")
def revert_links(spark, d):
    return revert_targets(spark, d).select("id", "target", F.round("days", 6).alias("days"))


@query(f"WITH RECURSIVE {_links_sql(True)}, {_CHAINS} SELECT root, CAST(step AS BIGINT) AS step, id, CASE WHEN step = 0 THEN 'original' WHEN step % 2 = 1 THEN 'revert' ELSE 'reapply' END AS role FROM walk")
def revert_chains(spark, d):
    return reverts.chains(chain_links(spark, d)).select("root", F.col("step").cast("long").alias("step"), "id", "role")


@query(
    f"""WITH RECURSIVE {_links_sql(True)}, {_CHAINS}, t AS (SELECT event_id AS commit_id, props AS path FROM events),
    n AS (SELECT path, count(DISTINCT commit_id) AS commits FROM t GROUP BY 1),
    r AS (SELECT path, count(*) AS reverts, median(days) AS md, max(ts) AS l FROM links JOIN t ON t.commit_id = target GROUP BY 1),
    c AS (SELECT path, count(DISTINCT root) AS chains FROM walk JOIN t ON t.commit_id = id GROUP BY 1)
    SELECT path, commits, reverts, round(least(1.0, reverts::DOUBLE / commits), 6) AS density, round(md, 6) AS median_days, coalesce(chains, 0) AS chains, CAST(floor(epoch(l)) AS BIGINT) AS last_s
    FROM r JOIN n USING (path) LEFT JOIN c USING (path)"""
)
def revert_path_stats(spark, d):
    t = events(spark, d).select(F.col("event_id").alias("commit_id"), F.col("props").alias("path"))
    links = chain_links(spark, d)
    s = reverts.path_stats(t, links, reverts.chains(links), exclude=None)
    return s.select("path", "commits", "reverts", F.round("density", 6).alias("density"), F.round("median_days", 6).alias("median_days"), "chains", F.unix_seconds("last_reverted_at").alias("last_s"))
