"""Operators that must tell rows apart when doc_id does not: null and repeated ids, hot buckets, the pipeline's edges."""

import collections
import random

from driftmap.llm import neardup, pii, quality, suffix
from tests.llm.test_llm import AWKWARD, PASSAGE, awkward, brute_components, brute_suffix, check_sequences, crc, docs, empty, rows, word_ids  # noqa: F401

OTHER = "Some other passage, of words that the first one has not, and it is as long as that so that a hundred bytes fit in. "
#: Ids that say nothing: none, and one id for several texts; repeated rows among them.
TWINS = [
    (None, "left " + PASSAGE + "this text differs, so nothing may go from here but the passage"),
    (None, PASSAGE + " " + OTHER + "right"),
    (None, "an unrelated text without an id that must stay whole, as nobody else has any hundred bytes of it, not even one"),
    (7, OTHER * 2 + "seven, first"),
    (7, "seven, second " + PASSAGE),
    (7, "seven, second " + PASSAGE),
    (9, OTHER * 2 + "seven, first"),
    (11, "seven, second " + PASSAGE),
]


def _table(spark, rows):
    return spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, place int").coalesce(1)


def test_suffix_by_row(spark):
    order = sorted(range(len(TWINS)), key=lambda i: -1 if TWINS[i][0] is None else TWINS[i][0])
    expected = brute_suffix([(i, TWINS[i][1]) for i in order])
    found = collections.Counter(tuple(r) for r in suffix.dedup(_table(spark, TWINS)).collect())
    assert found == collections.Counter((TWINS[i][0], *expected[i]) for i in order)
    left = {r.place: r for r in suffix.without_repeats(_table(spark, TWINS)).collect()}
    assert {i: len(r.text.encode()) for i, r in left.items()} == {i: n - gone for i, (n, gone, *_) in expected.items()}
    assert left[2].text == TWINS[2][1] and PASSAGE[:90] in left[0].text and all(PASSAGE[:90] not in left[i].text for i in (1, 4, 5, 7))


def test_near_duplicates_by_row(spark):
    order = sorted(range(len(TWINS)), key=lambda i: -1 if TWINS[i][0] is None else TWINS[i][0])
    brute = brute_components({k: TWINS[i][1] for k, i in enumerate(order)}, 4)
    expected = collections.Counter((TWINS[i][0], brute[k][0], TWINS[order[brute[k][1]]][0], TWINS[i][0] == TWINS[order[brute[k][1]]][0]) for k, i in enumerate(order))
    out = neardup.near_duplicates(_table(spark, TWINS), words=4).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == expected
    groups = len({root for _, root, _ in brute.values()})
    assert sum(r.first for r in out) == groups
    one = neardup.first_of_each(_table(spark, TWINS), words=4)
    assert one.columns == ["doc_id", "text", "place"] and one.count() == groups
    assert sorted(r.text for r in one.collect()) == sorted({t for _, t in TWINS})


def test_hot_bucket_makes_few_pairs(spark):
    """Documents that are half boilerplate and half their own meet in one bucket, yet the prefix filter pairs only relatives."""
    r = random.Random(5)
    shared = [f"s{i}" for i in range(200)]
    texts = []
    for i in range(400):
        own = [f"o{i}x{r.randint(0, 10**6)}" for _ in range(100)]
        texts.append(" ".join(shared + own))
        if i % 50 == 0:  # a relative of its own: eight of ten parts alike
            texts.append(" ".join(shared + own[:92] + [f"n{i}y{k}" for k in range(8)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in neardup.near_duplicates(df, words=4, pair_limit=8).collect()}
    assert found == brute_components(dict(enumerate(texts)), 4)
    import zstandard

    zstd = zstandard.ZstdCompressor()
    packed = spark.createDataFrame([(i, i, zstd.compress(t.encode())) for i, t in enumerate(texts)], "node long, component long, packed binary")
    assert neardup.prefix_pairs(packed, 4, 80).count() <= 2 * 8


def test_pipeline_awkward_and_empty(spark, awkward, empty, tmp_path):  # noqa: F811
    import corpus_pipeline

    for name, table in (("awkward", awkward), ("empty", empty)):
        folder = str(tmp_path / name)
        table.write.parquet(f"{folder}/documents.parquet")
        found = corpus_pipeline.run(spark, folder).collect()
        if name == "empty":
            assert not found
        else:
            check_sequences(found)
    # without the word rules the awkward rows themselves come through; of relatives, and of repeated rows, the first stays
    docs_ = awkward
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs_ = stage(spark, docs_, "")
        assert docs_.columns == awkward.columns
    got = collections.Counter(r.doc_id for r in docs_.collect())
    order = sorted(AWKWARD, key=lambda r: -1 if r[0] is None else r[0])
    first = {d for d in set(brute_components({k: t for k, (_, t) in enumerate(order)}, 5).items()) if d[1][2]}
    assert got == collections.Counter(order[k][0] for k, _ in first)


def test_pipeline_result_by_brute_force(spark, docs, rows):  # noqa: F811
    """The pieces of the whole pipeline hold the ids of texts that brute force leaves after each stage."""
    import corpus_pipeline

    kept = {r.doc_id: rows[r.doc_id] for r in quality.rules(docs).where("kept").collect()}
    marks = brute_components(kept, 5)
    alone = {d: t for d, t in kept.items() if marks[d][2]}
    seen, ids = set(), {}
    for d, t in sorted(alone.items()):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        at, text = 0, []
        for c in t:  # a character goes with all its bytes
            n = len(c.encode())
            if not all(gone[at : at + n]):
                text.append(c)
            at += n
        left = "".join(text)
        spans = pii.find(left)
        ids[d] = word_ids(pii.redact(left, spans) if spans else left)
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    check_sequences(found)
    got = collections.defaultdict(list)
    for r in found:
        got[r.doc_id].append(r)
    assert set(got) == set(ids)
    for d, pieces in got.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[d]) and p.ids_crc32 == crc(ids[d][at : at + p.length])
            at += p.length
        assert at == len(ids[d])
