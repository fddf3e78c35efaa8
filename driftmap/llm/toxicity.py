"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters look at a text and vote or abstain: built-in lexicons (insults, contempt, profanity,
   each in several languages), threat patterns of adjacent words, shouting, runs of
   exclamation marks, and three lexicons learned from labelled training rows (words that go
   with label 1 far more often than with label 0).
2. The label model is generative: a hidden class, each voter's rate of voting in either class
   (its accuracy), and correlations as a tree: every voter may depend on one other besides
   the class (the tree of largest conditional mutual information). It is fitted by
   expectation-maximisation on how often each pattern of votes occurs in the whole corpus (at
   most 2**voters rows, counted in Spark). Labels act through the learned lexicons alone.
3. The classifier is logistic: votes and hashed words, trained on the label model's posterior
   labels of training rows.

Labels come only from rows whose crc32(doc_id) mod 3 is not 1, and lang, source and doc_id
are no inputs of a score. Learned from are the labelled rows with the smallest hashed ids, at most
``fit_rows`` of them and together at most ``fit_bytes`` of text, so what reaches the driver is
bounded; everything else is counted over all rows. Of rows with one id the smallest text is
learned from, so runs agree, and each row is scored. Null text is the empty text. A null doc_id has
no label, is not held out and stays null. Without labels the label model alone decides; without
rows the result is empty. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import BYTE_LOWER, U, flat, materialize, mix, pieces, prefix_hash, span_hash
from .langid import held_out

LEXICONS = {
    "insults": """idiot idiots moron morons imbecile cretin dumb dumbass stupid fool fools loser losers clown clowns jerk
        dummkopf trottel depp idioten arschloch connard imbécile crétin abruti idiota imbécil estúpido estúpida tonto""",
    "contempt": """pathetic worthless disgusting trash garbage scum filth vermin parasite subhuman vile repulsive despicable
        abschaum widerlich erbärmlich wertlos dégoûtant minable ordure pourriture asqueroso basura escoria inútil patético""",
    "profanity": """fuck fucking fucker shit bullshit bitch bastard asshole cunt dick whore slut damn
        scheiße fick hure putain merde salope mierda puta cabrón joder""",
}
#: Adjacent words.
THREATS = """kill you|kill yourself|shut up|go die|hate you|hurt you|go hell|to hell|destroy you|beat you|you deserve|bring dich|halt maul|ta gueule|te mato|vete mierda"""
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
FEATURES = 1 << 18


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ASCII letters, digits and other characters' bytes, A-Z as a-z, and the rows' offsets."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    word = _WORD[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[off] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    ends[:-1] &= ~word[1:] | cut[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return mix(span_hash(prefix_hash(data, BYTE_LOWER), s, e) + (e - s).astype(np.uint64)), np.searchsorted(s, off)


def _hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return np.unique(tokens(np.frombuffer(b"".join(raw), np.uint8), off)[0]) if raw else np.empty(0, np.uint64)


def _pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * U(3) + h[1:]) if len(h) > 1 else h[:0]


def _within(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(h):
        return np.zeros(len(h), dtype=bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


class Voters:
    """All voters; ``learned``: sorted hash arrays of the learned lexicons."""

    def __init__(self, learned: list[np.ndarray]):
        self.lexicons = [_hashes(words.split()) for words in LEXICONS.values()] + learned
        self.threats = np.unique(np.concatenate([_pairs(np.array([_hashes([a])[0], _hashes([b])[0]])) for a, b in (t.split() for t in THREATS.split("|"))]))
        self.names = [*LEXICONS, *(f"learned{k}" for k in range(len(learned))), "threats", "shouting", "exclaims"]

    def votes(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row of 0 and 1 for each text, and the texts' tokens."""
        h, w = tokens(data, off)
        n = len(off) - 1
        out = np.zeros((n, len(self.names)), dtype=bool)
        row = np.repeat(np.arange(n), np.diff(w))
        for k, table in enumerate(self.lexicons):
            out[row[_within(h, table)], k] = True
        at = len(self.lexicons)
        if len(h) > 1:
            hit = _within(_pairs(h), self.threats) & (row[1:] == row[:-1])
            out[row[1:][hit], at] = True
        total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
        upper, letters, size = total(_UPPER[data]), total(_LETTER[data]), np.diff(off)
        out[:, at + 1] = (letters > 20) & (2 * upper > letters)
        out[:, at + 2] = total(data == 33) * 50 > np.maximum(size, 50)
        return out, h, w


class LabelModel:
    """P(y), and P(vote | y, the voter it depends on)."""

    def fit(self, votes: np.ndarray, weight: np.ndarray, rounds: int = 60) -> LabelModel:
        """votes: distinct patterns; weight: how often each occurs."""
        v, m = votes.astype(np.int64), votes.shape[1]
        # words decide at first: any lexicon or threat
        first = v[:, : max(1, m - 2)].any(axis=1)
        post = np.where(first, 0.9, 0.02)
        self.parent = np.full(m, -1)
        for r in range(rounds):
            w1, w0 = weight * post, weight * (1 - post)
            if r == 10:
                self.parent = self._tree(v, w0, w1)
            self.prior = (w1.sum() + 1) / (weight.sum() + 20)
            self.rate = np.zeros((m, 2, 2))  # voter, y, the vote it depends on
            for j in range(m):
                on = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), np.int64)
                for y, w in ((0, w0), (1, w1)):
                    for s in (0, 1):
                        pick = w * (on == s)
                        # a little evidence that voters rarely vote on clean text, and more often on the other
                        self.rate[j, y, s] = ((pick * v[:, j]).sum() + (0.02, 0.3)[y]) / (pick.sum() + 1)
            post = self.posterior(v)
        return self

    def _tree(self, v: np.ndarray, w0: np.ndarray, w1: np.ndarray) -> np.ndarray:
        """For each voter the one it depends on (-1: none), by conditional mutual information."""
        m = v.shape[1]
        info = np.zeros((m, m))
        for i in range(m):
            for j in range(i):
                for w in (w0, w1):
                    t = np.array([[(w * (v[:, i] == a) * (v[:, j] == b)).sum() for b in (0, 1)] for a in (0, 1)]) + 1e-9
                    p = t / t.sum()
                    info[i, j] += t.sum() * (p * np.log(p / p.sum(1, keepdims=True) / p.sum(0, keepdims=True))).sum()
        info = (info + info.T) / max(1.0, w0.sum() + w1.sum())
        parent, inside = np.full(m, -1), [0]
        while len(inside) < m:
            gain, i, j = max((info[i, j], i, j) for i in range(m) if i not in inside for j in inside)
            parent[i] = j if gain > 1e-4 else -1
            inside.append(i)
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v = votes.astype(np.int64)
        lp = np.tile(np.log([1 - self.prior, self.prior]), (len(v), 1))
        for j in range(v.shape[1]):
            on = v[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(v), np.int64)
            for y in (0, 1):
                r = self.rate[j, y][on]
                lp[:, y] += np.log(np.where(v[:, j] == 1, r, 1 - r))
        lp -= lp.max(axis=1, keepdims=True)
        p = np.exp(lp)
        return p[:, 1] / p.sum(axis=1)


def _word_features(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of hashed words: counts over the square root of the row's tokens."""
    n = len(w) - 1
    row = np.repeat(np.arange(n), np.diff(w))
    size = np.sqrt(np.maximum(np.diff(w), 1))
    return row, (h % U(FEATURES)).astype(np.int64), (1 / size)[row]


class Classifier:
    """Logistic regression: votes first, then hashed words under a stronger penalty."""

    def fit(self, votes: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray], target: np.ndarray, rounds: int = 150) -> Classifier:
        n, m = votes.shape
        v = np.hstack([np.ones((n, 1)), votes.astype(np.float64)])
        row, col, val = words
        self.bias_votes, self.words = np.zeros(m + 1), np.zeros(FEATURES)
        self.bias_votes[0] = np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3))
        step = [np.zeros_like(self.bias_votes), np.zeros_like(self.words)]
        for _ in range(rounds):  # AdaGrad on the whole sample
            g = _sigmoid(v @ self.bias_votes + np.bincount(row, val * self.words[col], n)) - target
            for k, (x, grad, ridge) in enumerate(((self.bias_votes, v.T @ g / n, 1e-5), (self.words, np.bincount(col, val * g[row], FEATURES) / n, 1e-3))):
                grad = grad + ridge * x
                step[k] += grad**2
                x -= (0.5, 0.05)[k] * grad / (np.sqrt(step[k]) + 1e-9)
        return self

    def score(self, votes: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        row, col, val = _word_features(h, w)
        return _sigmoid(self.bias_votes[0] + votes @ self.bias_votes[1:] + np.bincount(row, val * self.words[col], len(votes)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _each(texts: pa.Array, voters: Voters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    data, off = flat(texts)
    for i, j in pieces(off, 1 << 18):
        yield voters.votes(data[off[i] : off[j]], off[i : j + 1] - off[i])


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_bytes: int) -> DataFrame:
    """toxic, text of at most ``fit_rows`` labelled training rows and ``fit_bytes`` of text, as a table. Their ids are few enough to be sent to every task."""
    few = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    few = few.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    held = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    # one task sums at most fit_rows lengths
    size = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    held = materialize(held, "labelled")
    fits = held.select("doc_id", size.alias("size")).where(F.col("size") <= fit_bytes).select("doc_id")
    return held.join(F.broadcast(fits), "doc_id", "left_semi").select("toxic", "text")


def _learned(sample: DataFrame, words: int, least: int) -> list[np.ndarray]:
    """Three lexicons of the words that go with label 1: document counts by label, from the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            data, off = flat(b.column(1))
            h, w = tokens(data, off)
            row = np.repeat(np.arange(len(y)), np.diff(w))
            order = np.lexsort((h, row))
            first = np.ones(len(h), dtype=bool)
            first[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
            pick = order[first]
            u, at = np.unique(h[pick], return_inverse=True)
            n1 = np.bincount(at, y[row[pick]], len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(at, minlength=len(u)) - n1), pa.array(n1)], ["h", "n0", "n1"])

    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = sample.mapInArrow(run, "h long, n0 long, n1 long").groupBy("h").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n1") >= least)
    odds = (F.col("n1") + 0.5) / (size.get(1, 0) + 1) / ((F.col("n0") + 0.5) / (size.get(0, 0) + 1))
    got = counts.withColumn("odds", odds).where("odds > 20").orderBy(F.desc(F.col("n1") * F.ln("odds")), "h").limit(words).toArrow()
    h = got["h"].to_numpy().view(np.uint64) if got.num_rows else np.empty(0, np.uint64)
    return [np.sort(h[k::3]) for k in range(3)]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = 10_000, words: int = 300, least: int = 8, threshold: float = 0.7, fit_bytes: int = 1 << 26) -> DataFrame:
    """doc_id, held_out, score, predicted, votes (the names of those that voted)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sc = docs.sparkSession.sparkContext
    sample = _sample(docs, labels, fit_rows, fit_bytes)
    voters = Voters(_learned(sample, words, least))
    m = len(voters.names)
    shared = sc.broadcast(voters)
    code = 1 << np.arange(m)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << m, dtype=np.int64)
        for b in batches:
            for v, _, _ in _each(b.column(0), shared.value):
                n += np.bincount(v @ code, minlength=1 << m)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pattern", "n"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for v, h, w in _each(b.column(1), shared.value):
                row, col, val = _word_features(h, w)
                cut = np.cumsum(np.bincount(row, minlength=len(v)))[:-1]
                cols = [pa.array(list(np.split(x, cut)), pa.list_(t)) for x, t in ((col.astype(np.int32), pa.int32()), (val.astype(np.float32), pa.float32()))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(v)), pa.array(v @ code), *cols], ["toxic", "pattern", "col", "val"])
                at += len(v)

    counted = docs.select("text").mapInArrow(patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    train = sample.mapInArrow(features, "toxic int, pattern long, col array<int>, val array<float>").toArrow()
    seen = np.unique(np.concatenate([counted["pattern"].to_numpy(), train["pattern"].to_numpy()])) if train.num_rows else np.unique(counted["pattern"].to_numpy())
    votes = (seen[:, None] >> np.arange(m)) & 1
    weight = np.zeros(len(seen))
    weight[np.searchsorted(seen, counted["pattern"].to_numpy())] = counted["n"].to_numpy()
    model = LabelModel().fit(votes, weight) if len(seen) else None
    if train.num_rows:
        pattern = train["pattern"].to_numpy()
        size = np.array([len(x) for x in train["col"]])
        flat_cols = [np.concatenate([c.values.to_numpy() for c in train[x].chunks]) for x in ("col", "val")]
        y = model.posterior((pattern[:, None] >> np.arange(m)) & 1)
        linear = Classifier().fit((pattern[:, None] >> np.arange(m)) & 1, (np.repeat(np.arange(len(size)), size), flat_cols[0].astype(np.int64), flat_cols[1].astype(np.float64)), y)
        linear.words = linear.words.astype(np.float32)
    else:
        linear = None
    learned = sc.broadcast((model, linear))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v_, (model_, linear_) = shared.value, learned.value
        names = np.array(v_.names)
        for b in batches:
            at = 0
            for v, h, w in _each(b.column(2), v_):
                s = linear_.score(v, h, w) if linear_ is not None else model_.posterior(v)
                said = [",".join(names[x]) for x in v]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(v)), b.column(1).slice(at, len(v)), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(said, pa.string())], ["doc_id", "held_out", "score", "predicted", "votes"])
                at += len(v)

    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, votes string")
