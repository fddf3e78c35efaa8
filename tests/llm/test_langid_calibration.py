"""Temperature and limits come from every training row, not from some of them."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from driftmap.llm import langid


def test_calibration_over_all_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang", "text").repartition(3)
    own = [r for r in d.collect() if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    assert len(own) > 6000
    model = langid.train(d)
    m, letter = (np.concatenate(x) for x in zip(*model.mean_logp(pa.array([r.text for r in own]))))
    y = np.array([model.langs.index(r.lang) for r in own])[letter]
    m = m[letter]
    z = m - m.max(axis=1, keepdims=True)
    loss = {t: (np.log(np.exp(z * t).sum(axis=1)) - z[np.arange(len(y)), y] * t).sum() for t in 2.0 ** np.arange(-2, 5)}
    h = -m[np.arange(len(y)), y] / np.log(2)
    limit = {name: np.quantile(h[y == i], 0.999) + 0.5 for i, name in enumerate(model.langs)}
    best = min(loss, key=loss.get)
    found = langid.identify(d).where("not held_out and lang_pred != 'und'").select("bits", "rejected", "lang_pred").collect()
    assert all(r.rejected == (r.bits > limit[r.lang_pred]) for r in found)
    assert len(found) >= len(y)
    scored = langid._scored(d.withColumn("held_out", langid.held_out("doc_id")), model)
    langid.calibrate(model, scored)
    assert model.temperature == best
    assert np.allclose(model.limit, [limit[x] for x in model.langs], rtol=1e-12)


def test_percentile_of_many_rows(spark):
    """More rows than are ranked whole: the model here gives each row its own entropy."""
    rng = np.random.default_rng(3)
    m = -rng.gamma(4, 1, (24_000, 2))
    y = (rng.random(24_000) < 0.9).astype(int)
    table = spark.createDataFrame([(["a", "b"][k], True, False, v) for k, v in zip(y.tolist(), m.tolist())], "lang string, letter boolean, held_out boolean, m array<double>")
    model = langid.Model(["a", "b"], [(np.array([97], np.uint64), np.array([1]))] * 2)
    langid.calibrate(model, table)
    assert np.allclose(model.limit, [np.quantile(-m[y == k, k] / np.log(2), 0.999) + 0.5 for k in (0, 1)], rtol=1e-12)


def test_calibration_of_few_and_tied_rows(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, "en", "the cat sat on the mat") for i in ids[:-1]] + [(ids[-1], "es", "el gato")]
    d = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.train(d)
    langid.calibrate(model, langid._scored(d.withColumn("held_out", F.lit(False)), model))
    h = {t: -m[0, model.langs.index(lang)] / np.log(2) for _, lang, t in rows for m, _ in model.mean_logp(pa.array([t]))}
    assert np.allclose(model.limit, [h["the cat sat on the mat"] + 0.5, h["el gato"] + 0.5])


def test_rows_that_a_sample_would_miss(spark):
    """The rows with unusual text come last in the order by which ids were once sampled; the limit knows them."""
    ids = [r.id for r in spark.range(9000).orderBy(F.xxhash64("id")).collect() if zlib.crc32(str(r.id).encode()) % 3 != 1][:5000]
    rows = [(d, "en", "the cat sat on the mat and the rat ran") for d in ids[:-60]] + [(d, "en", f"zq{chr(97 + k % 26)}x") for k, d in enumerate(ids[-60:])]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)).collect()
    limit = np.quantile([r.bits for r in out], 0.999) + 0.5
    assert [r.rejected for r in out] == [r.bits > limit for r in out] == [False] * 5000
