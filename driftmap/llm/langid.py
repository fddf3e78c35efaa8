"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays.

Characters are folded: letters to lower case, everything else to a space. For each language
the 4-character strings of all its training documents are counted (in Spark, merged in each
task first); from their types come the continuation counts of the lower orders, and from
those the interpolated probabilities with one absolute discount for each order. All
languages share one sorted array of packed strings for each order, with a row of log
probabilities (one for each language) beside it. A text gets the language of the lowest
cross-entropy per scored character.

``score`` is the posterior of that language: a softmax over the languages' mean log
probabilities, its temperature fitted on labelled training rows. ``rejected`` says that the
cross-entropy lies outside what the language's training rows show (their 99.9th percentile
and a margin); ``lang_pred`` names the nearest language all the same.

Every type of every training row stays in the model, so discounts, totals and continuation
counts are those of the whole corpus. The model is sent to all executors and grows with the
corpus' types: 8 bytes, and 4 for each language, for each type and each context of an order.
Temperature and rejection are fitted on every training row with a letter: each text is scored once,
its mean log probabilities are written, and both passes read those. The percentile is exact. Null text, and text without a letter, is ``und`` with
score 0; with no training rows every text is, and without rows the result is empty. A null doc_id
is held in, as its remainder is unknown, and stays null. Rows with one id, and repeated rows, are
each counted and each scored. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import U, flat, materialize, pieces

N = 4
SPACE = 32
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """What each code point of the first plane counts as."""
    if not _FOLD:
        t = np.full(65536, SPACE, dtype=np.uint64)
        for i in range(65536):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _FOLD.append(t)
    return _FOLD[0]


def fold(cp: np.ndarray) -> np.ndarray:
    """Letters in lower case, all else a space; letters beyond the first plane are one letter."""
    out = fold_table()[np.minimum(cp, 0xFFFF)]
    far = np.flatnonzero(cp > 0xFFFF)
    if len(far):
        u, at = np.unique(cp[far], return_inverse=True)
        out[far] = np.array([0xFFFD if chr(c).isalpha() else SPACE for c in u.tolist()], dtype=np.uint64)[at]
    return out


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed 4-character strings of the rows (16 bits each, the last character lowest), the rows' n + 1 offsets, and which are scored.

    A string is scored if its last character is a letter, or the first space after one. Every
    row begins as if after spaces.
    """
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begin = lead[off]
    f = fold(cp)
    n = len(f)
    place = np.arange(n) - np.repeat(begin[:-1], np.diff(begin))
    g = f.copy()
    for j in range(1, N):
        back = np.full(n, SPACE, dtype=np.uint64)
        back[j:] = f[:-j] if j < n else f[:0]
        back[place < j] = SPACE
        g |= back << U(16 * j)
    last, before = g & U(0xFFFF), (g >> U(16)) & U(0xFFFF)
    return g, begin, (last != SPACE) | (before != SPACE)


class Model:
    """Sorted strings of each order with the languages' log probabilities and back-off weights."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts: for each language its packed strings and how often they occur."""
        self.langs = langs
        self.temperature, self.limit = 1.0, np.zeros(len(langs))
        self.keys: dict[int, np.ndarray] = {}
        self.logp: dict[int, np.ndarray] = {}
        self.back: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        tables = [self._orders(g, c) for g, c in counts]
        alphabet = max([len(np.unique(g & U(0xFFFF))) for g, _ in counts] + [1]) + 1
        n = len(langs)
        self.floor = np.log(np.full(n, 1.0 / alphabet))
        lower = None
        for order in range(1, N + 1):
            keys = np.unique(np.concatenate([t[order][0] for t in tables]))
            context = np.unique(keys >> U(16)) if order > 1 else np.zeros(1, np.uint64)
            p = np.zeros((len(keys), n))
            gamma = np.ones((len(context), n))
            for l, t in enumerate(tables):
                g, c, d = t[order]
                ctx = g >> U(16) if order > 1 else np.zeros(len(g), np.uint64)
                at = np.searchsorted(context, ctx)
                total = np.bincount(at, c, len(context))
                types = np.bincount(at, minlength=len(context))
                seen = total > 0
                gamma[seen, l] = d * types[seen] / total[seen]
                p[np.searchsorted(keys, g), l] = np.maximum(c - d, 0) / total[at]
            below = 1.0 / alphabet if lower is None else np.exp(self._lookup(order - 1, keys & U((1 << 16 * (order - 1)) - 1)))
            at = np.searchsorted(context, keys >> U(16)) if order > 1 else np.zeros(len(keys), np.int64)
            p += gamma[at] * below
            self.keys[order], self.logp[order] = keys, np.log(np.maximum(p, 1e-12)).astype(np.float32)
            self.back[order] = context, np.log(gamma).astype(np.float32)
            lower = order

    @staticmethod
    def _orders(g: np.ndarray, c: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
        """For each order the strings, their counts (below the highest: distinct characters before) and the discount."""
        out = {}
        g, c = g.astype(np.uint64), c.astype(np.float64)
        for order in range(N, 0, -1):
            n1, n2 = np.count_nonzero(c == 1), np.count_nonzero(c == 2)
            out[order] = g, c, n1 / (n1 + 2 * n2) if n1 else 0.5
            if order > 1:
                g, c = np.unique(g & U((1 << 16 * (order - 1)) - 1), return_counts=True)
                c = c.astype(np.float64)
        return out

    def _lookup(self, order: int, g: np.ndarray) -> np.ndarray:
        """Log probabilities of the last character after the others: a row for each string."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(g), len(self.langs)))
        keys = self.keys[order]
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        out = self.logp[order][at]
        miss = np.flatnonzero(keys[at] != g)
        if len(miss):
            gm = g[miss]
            context, gamma = self.back[order]
            ctx = gm >> U(16) if order > 1 else np.zeros(len(gm), np.uint64)
            ca = np.minimum(np.searchsorted(context, ctx), len(context) - 1)
            weight = np.where((context[ca] == ctx)[:, None], gamma[ca], 0)
            out[miss] = weight + self._lookup(order - 1, gm & U((1 << 16 * (order - 1)) - 1))
        return out

    def mean_logp(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For ranges of rows: the languages' mean log probabilities, and whether a row has a letter."""
        data, off = flat(texts)
        for i, j in pieces(off, 1 << 18):
            g, begin, scored = grams(data[off[i] : off[j]], off[i : j + 1] - off[i])
            n = j - i
            row = np.repeat(np.arange(n), np.diff(begin))
            letter = np.bincount(row[(g & U(0xFFFF)) != SPACE], minlength=n) > 0
            row, g = row[scored], g[scored]
            lp = self._lookup(N, g)
            size = np.maximum(np.bincount(row, minlength=n), 1)
            yield np.stack([np.bincount(row, lp[:, l], n) / size for l in range(lp.shape[1])], axis=1), letter

    def predict(self, m: np.ndarray, letter: np.ndarray) -> list[pa.Array]:
        """lang_pred, score, bits, rejected from the mean log probabilities."""
        best = m.argmax(axis=1)
        z = (m - m.max(axis=1, keepdims=True)) * self.temperature
        p = 1 / np.exp(z).sum(axis=1)
        h = -m[np.arange(len(m)), best] / np.log(2)
        name = [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist())]
        rejected = ~letter | (h > self.limit[best])
        return [pa.array(name, pa.string()), pa.array(np.where(letter, p, 0.0)), pa.array(h, mask=~letter), pa.array(rejected)]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows (lang, text), every type of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def put(lang: str, g: np.ndarray, c: np.ndarray) -> None:
            if lang in total:
                g, at = np.unique(np.concatenate([total[lang][0], g]), return_inverse=True)
                c = np.bincount(at, np.concatenate([total[lang][1], c])).astype(np.int64)
            total[lang] = g, c

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (g, c) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(c)], ["lang", "gram", "n"])

        for b in batches:
            langs = np.array(b.column(0).to_pylist())
            for lang in np.unique(langs).tolist():
                data, off = flat(b.column(1).filter(pa.array(langs == lang)))
                for i, j in pieces(off, 1 << 20):
                    g, _, scored = grams(data[off[i] : off[j]], off[i : j + 1] - off[i])
                    u, c = np.unique(g[scored], return_counts=True)
                    put(lang, u, c)
            if sum(len(g) for g, _ in total.values()) > 2_000_000:
                yield from out()
                total.clear()
        yield from out()

    return rows.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Model | None:
    """A model from doc_id, lang, text of the rows that are not held out, without temperature and limits."""
    rows = docs.where(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    table = count_grams(rows).toArrow()
    if not table.num_rows:
        return None
    lang = np.array(table["lang"].to_pylist())
    g, c = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    langs = sorted(set(lang.tolist()))
    counts = []
    for name in langs:
        pick = np.flatnonzero(lang == name)
        pick = pick[np.argsort(g[pick])]
        counts.append((g[pick], c[pick]))
    return Model(langs, counts)


#: Temperatures that are tried, and the percentile of a language's cross-entropy beyond which it is rejected.
TEMPERATURES, WITHIN = 2.0 ** np.arange(-2, 5), 0.999


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang, letter, m (the languages' mean log probabilities); docs: doc_id, held_out, lang, text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for m, letter in shared.value.mean_logp(b.column(3)):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(at, len(m)) for c in range(3)), pa.array(letter), lists], ["doc_id", "held_out", "lang", "letter", "m"])
                at += len(m)

    return materialize(docs.select("doc_id", "held_out", "lang", "text").mapInArrow(run, "doc_id long, held_out boolean, lang string, letter boolean, m array<double>"), "scored")


def _vectors(m: pa.Array) -> np.ndarray:
    return m.flatten().to_numpy().reshape(len(m), -1)


def calibrate(model: Model, scored: DataFrame) -> None:
    """Temperature by the highest likelihood, limits by the percentile of each language's cross-entropy, over all training rows with a letter."""
    langs = model.langs
    own = scored.where("not held_out and letter and lang is not null").select("lang", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m, y = _vectors(b.column(1)), np.searchsorted(langs, b.column(0).to_pylist())
            right = np.arange(len(y)), y
            z = m - m.max(axis=1, keepdims=True)
            loss = np.stack([np.log(np.exp(z * t).sum(axis=1)) - z[right] * t for t in TEMPERATURES], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, loss.size + 1, loss.shape[1]), pa.int32()), pa.array(loss.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(-m[right] / np.log(2)), lists], ["y", "h", "loss"])

    each = materialize(own.mapInArrow(run, "y long, h double, loss array<double>"), "calibration")
    # an approximate quantile, off by at most 2e-4 of a language's rows, lies well below the percentile
    near = F.percentile_approx("h", WITHIN - 2e-3, 5000)
    sums = [F.sum(F.col("loss")[i]).alias(f"t{i}") for i in range(len(TEMPERATURES))]
    stats = each.groupBy("y").agg(F.count("*").alias("n"), near.alias("near"), *sums).collect()
    if not stats:
        return
    total = [math.fsum(r[f"t{i}"] for r in stats) for i in range(len(TEMPERATURES))]
    model.temperature = float(min(zip(total, TEMPERATURES))[1])
    # only what lies above it is ranked, from the top; of a language of few rows, all
    model.limit[:] = np.inf
    bounds = each.sparkSession.createDataFrame([(r.y, r.n, r.near if r.n > 10_000 else -math.inf) for r in stats], "y long, n long, low double")
    top = each.join(F.broadcast(bounds), "y").where("h >= low").select("y", "n", "h")
    rank = F.row_number().over(Window.partitionBy("y").orderBy(F.desc("h")))
    # np.quantile's two neighbours: places floor and ceil of (n - 1) * WITHIN from below
    place = F.expr(f"(n - 1) * {WITHIN}d")
    two = top.select("y", "h", (F.col("n") - rank).alias("at"), place.alias("place")).where("at = floor(place) or at = ceil(place)")
    for r in two.groupBy("y").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("place").alias("place")).collect():
        model.limit[r.y] = r.lo + (r.hi - r.lo) * (r.place - math.floor(r.place)) + 0.5


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (cross-entropy per character), rejected."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(docs)
    out = docs.select("doc_id", held_out("doc_id").alias("held_out"), "lang", "text")
    if model is None:
        return out.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"), F.lit(True).alias("rejected"))
    scored = _scored(out, model)
    calibrate(model, scored)
    # the tables of the model stay behind: the second pass needs names, temperature and limits
    model.keys, model.logp, model.back = {}, {}, {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                letter = b.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *model.predict(_vectors(b.column(3)), letter)], ["doc_id", "held_out", "lang_pred", "score", "bits", "rejected"])

    return scored.select("doc_id", "held_out", "letter", "m").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits double, rejected boolean")
