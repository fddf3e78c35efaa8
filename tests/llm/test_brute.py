"""Brute-force versions, written from the definitions alone, of personal data, toxicity votes and scores, and language models."""

import collections
import hashlib
import math
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from driftmap.llm import bytebpe, langid, pii, quality, toxicity
from tests.llm.test_llm import AWKWARD, SF, docs, rows  # noqa: F401


def checksum(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        d = int(c) * (2 if k % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def brute_base(text):
    """Base spans from the definition: patterns by finditer, then the checks."""
    digits = lambda s: [c for c in s if c in "0123456789"]
    out = [("email", m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and checksum(digits(m[0]))]
    out += [("phone", m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return out


TRICKY = [
    "1.2.3.4.5.6.7.8 and 0001.2.3.256 or 255.255.255.255.1 x12.1.1.1y",
    "a@b.co,a@@b.c a.b@c-d.e.f @x.y x@y é@b.co ü.x@b.co a@b a@b.c@d.e",
    "4539148803436467 4539 1488 0343 6467 4539-1488-0343-6467-0000-0000 45391488034364670",
    "+1 (234) 567-8901 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 ++49.30.1234567. +1)(2",
    "🎈 a@b.co 日本 1.1.1.1",
    "",
]


def test_base_kinds_by_definition(rows):  # noqa: F811
    base = [k.name for k in pii.KINDS if k.base]
    for text in [*TRICKY, *rows.values(), *(t for _, t in AWKWARD)]:
        text = text or ""
        assert [(pii.KINDS[k].name, (s, e)) for k, s, e, _ in pii.find(text) if pii.KINDS[k].name in base] == brute_base(text)


def test_digest_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)] + [(None, None)], "doc_id long, text string")
    for r in pii.scan(df).collect():
        found = brute_base("" if r.doc_id is None else TRICKY[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _ in found) for x in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, (s, e) in found).encode()).hexdigest()


def test_words_nearby_and_other_kinds():
    kinds = lambda t, **how: [(pii.KINDS[k].name, t[s:e]) for k, s, e, _ in pii.find(t, **how)]
    assert kinds("number 123-45-6789") == [] and kinds("my ssn: 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("my ssn: 000-45-6789") == [] and kinds("number 123-45-6789", least=0.4) == [("ssn", "123-45-6789")]
    assert kinds("ssn " + "x" * 60 + " 123-45-6789") == []
    assert kinds("api_key = 'AbCdEf0123456789xyz'") == [("secret", "AbCdEf0123456789xyz")] and kinds("api_key = short") == []
    assert kinds("GB82 WEST 1234 5698 7654 32") == [("iban", "GB82 WEST 1234 5698 7654 32")] and kinds("GB83 WEST 1234 5698 7654 32") == []
    scores = [pii.find(t)[0][3] for t in ("write to a@b.co", "see a@b.co")]
    assert scores == [1.0, 0.9]


@pytest.mark.parametrize("text", ["7" * 400_000, "1." * 200_000, "+" * 200_000 + "1" * 200_000, "a" * 200_000 + "@", "a@" * 100_000, "token " * 60_000], ids=str.__len__)
def test_searches_are_linear(text):
    t = time.time()
    pii.find(text)
    assert time.time() - t < 20


def test_votes_by_definition(rows):  # noqa: F811
    voters = toxicity.Voters([toxicity._hashes(["ond", "erth"])])
    lexicons = [set(x.lower().split()) for x in toxicity.LEXICONS.values()] + [{"ond", "erth"}]
    threats = {tuple(t.split()) for t in toxicity.THREATS.split("|")}
    texts = [t or "" for t in [*rows.values(), *(t for _, t in AWKWARD)]] + ["IDIOT! KILL YOU all, halt maul!!! DAMN THE WHOLE THING AND EVERYONE", "!!!", "shut\nup", "shut-up"]
    data = "".join(texts).encode()
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got, h, w = voters.votes(np.frombuffer(data, np.uint8), off)
    for t, v in zip(texts, got):
        low = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
        low = [x.decode() for x in low]
        letters = re.findall("[A-Za-z]", t)
        expected = [any(x in lex for x in low) for lex in lexicons]
        expected.append(any(p in threats for p in zip(low, low[1:])))
        expected.append(len(letters) > 20 and 2 * sum(c.isupper() for c in letters) > len(letters))
        expected.append(t.count("!") * 50 > max(len(t.encode()), 50))
        assert v.tolist() == expected, t[:80]


def test_posterior_and_score_by_definition():
    rng = np.random.default_rng(2)
    votes = (np.arange(32)[:, None] >> np.arange(5)) & 1
    model = toxicity.LabelModel().fit(votes, rng.integers(1, 100, 32).astype(float))
    for v, p in zip(votes.tolist(), model.posterior(votes)):
        both = []
        for y in (0, 1):
            x = model.prior if y else 1 - model.prior
            for j, on in enumerate(v):
                r = model.rate[j, y, v[model.parent[j]] if model.parent[j] >= 0 else 0]
                x *= r if on else 1 - r
            both.append(x)
        assert p == pytest.approx(both[1] / sum(both))
    text = b"some words and some more"
    h, w = toxicity.tokens(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    c = toxicity.Classifier()
    c.bias_votes, c.words = rng.normal(size=6), rng.normal(size=toxicity.FEATURES)
    z = c.bias_votes[0] + votes[5] @ c.bias_votes[1:] + sum(c.words[int(x) % toxicity.FEATURES] for x in h) / math.sqrt(len(h))
    assert c.score(votes[5:6], h, w)[0] == pytest.approx(1 / (1 + math.exp(-z)))


def test_toxicity_is_the_same_in_every_run(spark, docs):  # noqa: F811
    """Repeated ids with different texts: whichever row comes first, scores stay."""
    twice = docs.select("doc_id", "text").unionByName(docs.selectExpr("doc_id", "concat(text, ' you idiot') as text"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    runs = [sorted((r.doc_id, r.score) for r in toxicity.score(twice.repartition(n), labels).collect()) for n in (2, 5)]
    assert np.allclose(np.array(runs[0], float), np.array(runs[1], float), atol=1e-6)


def brute_model(texts, alphabet):
    """Interpolated Kneser-Ney of order 4 over one language's texts: a function (three characters before, character) to probability."""
    fold = lambda t: "".join(c.lower() if c.isalpha() else " " for c in t)
    top = collections.Counter()
    for t in texts:
        s = "   " + fold(t)
        for i in range(3, len(s)):
            if s[i] != " " or s[i - 1] != " ":
                top[s[i - 3 : i + 1]] += 1
    counts = {4: top}
    for n in (3, 2, 1):
        counts[n] = collections.Counter(g[1:] for g in counts[n + 1])
    context = {n: collections.defaultdict(list) for n in counts}
    for n, table in counts.items():
        for g, c in table.items():
            context[n][g[:-1]].append(c)
    discount = {}
    for n, table in counts.items():
        n1, n2 = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        discount[n] = n1 / (n1 + 2 * n2) if n1 else 0.5

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / alphabet
        seen = context[n].get(g[:-1])
        if not seen:
            return p(g[1:])
        total = sum(seen)
        return max(counts[n].get(g, 0) - discount[n], 0) / total + discount[n] * len(seen) / total * p(g[1:])

    return p


def test_language_model_by_definition():
    texts = {"a": ["the cat sat on the mat and the dog", "a cat and a dog"], "b": ["el gato y el perro", "la casa es grande, y el perro duerme"]}
    tables = []
    for name in sorted(texts):
        arr = pa.array(texts[name])
        data, off = langid.flat(arr)
        g, _, scored = langid.grams(data, off)
        tables.append(np.unique(g[scored], return_counts=True))
    model = langid.Model(sorted(texts), tables)
    asked = ["the dog sat", "el gato grande", "cat? perro! la dog...", "zzz qqq"]
    (got, letter), = model.mean_logp(pa.array(asked))
    # the languages share one alphabet: the larger one, and one more
    alphabet = 1 + max(len({c for x in own for c in x.lower() if c.isalpha()} | {" "}) for own in texts.values())
    for k, name in enumerate(sorted(texts)):
        p = brute_model(texts[name], alphabet)
        for t, value in zip(asked, got[:, k]):
            s = "   " + "".join(c.lower() if c.isalpha() else " " for c in t)
            logs = [math.log(p(s[i - 3 : i + 1])) for i in range(3, len(s)) if s[i] != " " or s[i - 1] != " "]
            assert value == pytest.approx(sum(logs) / len(logs), rel=1e-4)
    assert letter.all()


def test_no_letter_is_und(spark):
    table = [(i, t, lang) for i, (t, lang) in enumerate([("the cat sat on the mat", "en"), ("el gato y el perro", "es")] * 6)]
    table += [(100, "🎈🎈", None), (101, "👍👍👍 12 !?", None), (102, "𝒳 𐐀", None), (103, None, None), (104, "", None)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame(table, "doc_id long, text string, lang string")).collect()}
    assert [out[i].lang_pred for i in (100, 101, 103, 104)] == ["und"] * 4 and out[102].lang_pred != "und" and out[100].score == 0


def test_any_other_pattern_is_applied_whole():
    import public_tokenizers as p
    import tiktoken

    ranks = bytebpe.codec(p.path("byte_bpe_50k.tiktoken"), p.PATTERN).ranks
    assert bytebpe.codec(p.path("byte_bpe_50k.tiktoken"), p.PATTERN).by_space
    for pattern in (r"\S+\s*|\s+", r"[a-z]+ [a-z]+|[\s\S]"):
        own = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        c = bytebpe.BytePairCodec(ranks, pattern)
        for t in ("two words and three more", " a b  c", "one"):
            assert np.frombuffer(c.encode(t)[0], "<u4").tolist() == own.encode(t)


def test_bands_by_definition(docs, rows):  # noqa: F811
    """The verdict from zstandard's ratios, document by document."""
    import zstandard

    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))

    def fits(b):
        low, high = [(x, y) for least, x, y in quality.BANDS if len(b) >= least][-1]
        return low * len(b) <= size(b) <= high * len(b)

    for r in quality.rules(docs).collect():
        b = rows[r.doc_id].encode()
        chunks = [b[i : i + 4096] for i in range(0, len(b), 4096)] if len(b) > 4096 else []
        assert r.kept == (not r.base_failed and fits(b) and 4 * sum(not fits(c) for c in chunks) <= len(chunks))
