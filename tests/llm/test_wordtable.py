"""The table of words in arrays gives the library's ids, also when it is far too small or its hashes collide."""

import numpy as np
import pyarrow as pa
import pytest

from driftmap.llm import queries, wordids
from driftmap.llm._common import flat, span_hashes, word_spans
from tests.llm.test_llm import AWKWARD, rows, docs, word_ids  # noqa: F401


@pytest.fixture(scope="module")
def texts(rows):  # noqa: F811
    found = [*list(rows.values())[:60], *(t for _, t in AWKWARD)]
    found += ["<|ENDOFTEXT|> <|endoftext|> a<b A<B", "ÀÉ àé Àé ÇA Ça x\x00 x x\x00\x00 \x00", "K k ſ Σ ΑΣ ας İ i̇", "a\xa0b a b a b \x85 \x1cx\x1f", "q" * 24 + " " + "q" * 25 + " " + "Q" * 24, "日本語 テキスト 中文" * 20, "it's IT'S we'll 12ab!!", "é é É"]
    return [(t, word_ids(t)[:-1]) for t in found]


@pytest.mark.parametrize("bits, step, collide", [(21, 1 << 17, False), (10, 256, False), (21, 1 << 17, True)])
def test_word_table_is_the_library(texts, monkeypatch, bits, step, collide):
    monkeypatch.setattr(wordids, "STEP", step)
    table = wordids.WordTable(queries.vocabulary("word_bpe_49k.json"), bits=bits, most_parts=50)
    for part in (texts[-9:] if collide else texts, texts[-9:]):
        data, off = flat(pa.array([t for t, _ in part], pa.string()))
        s, e, w = word_spans(data, off)
        h = span_hashes(data, s, e)
        found, count = table.ids(data, s, e, h & np.uint64(1) if collide else h)
        cut = np.concatenate([[0], np.cumsum(count)])[w]
        for (_, expected), a, b in zip(part, cut[:-1], cut[1:]):
            assert found[a:b].tolist() == expected
    none = np.empty(0, np.int64)
    assert table.ids(np.empty(0, np.uint8), none, none, none.astype(np.uint64))[0].size == 0
