"""The language model keeps every type, however many there are."""

import zlib

import numpy as np

from driftmap.llm import langid


def test_every_type_is_kept(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 4000))) for _ in range(150)]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:150]
    d = spark.createDataFrame([(i, "zh", t) for i, t in zip(ids, texts)], "doc_id long, lang string, text string")
    types = len({t[i : i + 4] for t in texts for i in range(len(t) - 3)})
    model = langid.train(d)
    assert types > 300_000
    assert len(model.keys[4]) >= types
