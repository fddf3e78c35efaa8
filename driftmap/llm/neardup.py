"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A document's set holds its distinct k-word shingles (words lower-cased A-Z; with fewer
words the whole sequence is one shingle). Documents with equal sets form a class, and only
its smallest doc_id goes on. The sketch of a set has ``bins`` coordinates: in round i every
shingle is placed in a hashed bin with a hashed value, an empty bin keeps its smallest one,
and the rounds end when all bins are filled; after ``bins`` rounds the remaining bins take
the minimum of the whole set each, so every coordinate fills. Bands of ``rows`` coordinates
give buckets; two sets of similarity 0.8 share none of 40 bands of 4 with a probability of
7e-10.

Candidates are verified on the full sets, in two steps. First each bucket's members against
its smallest member. Then, within a bucket, only pairs whose documents are still in
different components, so a bucket of documents that are all alike costs as many pairs as it
has members, yet no link between components is lost. A bucket that is still mixed and has more
than ``pair_limit`` members makes no pairs of its own: its members go through an exact prefix
filter. Shingles are put in order of how many of these documents have them; two sets of
similarity t share one of the rarest n - ceil(t n) + 1 shingles of each, so a phrase that
thousands of otherwise different documents share brings none of them together. What the filter
cannot avoid are documents whose rarest shingles are shared and which are no duplicates.

Identity is by row: every row gets an id of its own when the sketches are written, and doc_id
only says which row counts as the smallest. Rows with one doc_id (or with none) and different
texts are different documents; repeated rows are copies of each other. ``kept`` is doc_id =
component_id, hence true for each row of a repeated smallest doc_id; ``first`` is true for one
row of each component. Null, empty and wordless texts have an empty set, are linked with
nothing, and each is ``kept`` and ``first``. A null doc_id is smaller than all others; it is
null again in the result. Without rows the result is empty. Other columns of ``docs`` are not
looked at, whatever their names; ``first_of_each`` hands them on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, U, flat, ids_of, materialize, mix, pieces, release, shingle_hashes, word_hashes
from .components import components

_SEEDS = np.random.default_rng(7).integers(0, 2**64, 4096, dtype=np.uint64)


def sketch(s: np.ndarray, bins: int) -> np.ndarray:
    """The coordinates of a non-empty set of hashes: (round << 48) + 48 bits of the winner's hash."""
    out = np.full(bins, 2**64 - 1, dtype=np.uint64)
    i, step = 0, max(1, 2048 // len(s))
    while i < bins:
        r = np.arange(i, min(bins, i + step))
        x = mix(s[None, :] ^ _SEEDS[r][:, None])
        at = ((x >> U(40)) * U(bins)) >> U(24)
        value = (r.astype(np.uint64)[:, None] << U(48)) | (x & U(0xFFFFFFFFFFFF))
        np.minimum.at(out, at.ravel().astype(np.int64), value.ravel())
        if out.max() != 2**64 - 1:
            return out
        i += len(r)
    for b in np.flatnonzero(out == 2**64 - 1):
        out[b] = (U(bins + int(b)) << U(48)) | (mix(s ^ _SEEDS[(bins + int(b)) % 4096]) & U(0xFFFFFFFFFFFF)).min()
    return out


def band_keys(sk: np.ndarray, rows: int) -> np.ndarray:
    m = sk.reshape(-1, rows)
    h = np.arange(1, len(m) + 1, dtype=np.uint64)
    for j in range(rows):
        h = mix(h * U(0x9FB21C651E98DF25) + m[:, j])
    return h


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, off = flat(texts)
    for i, j in pieces(off):
        wh, w = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        yield from shingle_hashes(wh, w, k)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct hashes."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketched(docs: DataFrame, k: int, bins: int, rows: int, more: str = "") -> DataFrame:
    """docs: row, doc_id, text and other columns, which ``more`` names as DDL and which stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zstd = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                n, cls, keys, packed = [], [], [], []
                for s, t in zip(sets_of(part.column(2), k), part.column(2)):
                    n.append(len(s))
                    packed.append(zstd.compress(t.as_buffer()) if t.is_valid else None)
                    cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(band_keys(sketch(s, bins), rows).view(np.int64) if len(s) else None)
                cols = [part.column(0), pa.array(ids_of(part.column(1))), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary()), *part.columns[3:]]
                yield pa.RecordBatch.from_arrays(cols, [*_BASE, *part.schema.names[3:]])
        release()

    return docs.mapInArrow(run, "row long, doc_id long, n_shingles long, cls binary, keys array<long>, packed binary" + more)


_BASE = ["row", "doc_id", "n_shingles", "cls", "keys", "packed"]


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar; texts: node, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                pa_, pb = part.column(0).to_pylist(), part.column(1).to_pylist()
                raw: dict[bytes, int] = {}
                x = [raw.setdefault(p, len(raw)) for p in part.column(2).to_pylist()]
                y = [raw.setdefault(p, len(raw)) for p in part.column(3).to_pylist()]
                sets = list(sets_of(pa.array([unzip.decompress(p) for p in raw], pa.binary()).cast(pa.string()), k))
                ok = [similar(sets[p], sets[q], percent) for p, q in zip(x, y)]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()).filter(pa.array(ok)) for v in (pa_, pb)], ["u", "v"])
        release()

    # a is the hot end (a bucket's smallest member), so its text joins last and is never shuffled along
    one = texts.select(F.col("node").alias("a"), F.col("packed").alias("pa"))
    two = texts.select(F.col("node").alias("b"), F.col("packed").alias("pb"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "pa", "pb").mapInArrow(run, "u long, v long")


def _shingles(texts: DataFrame, k: int) -> DataFrame:
    """node, component, n, h: every shingle of every document; texts: node, component, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                sets = list(sets_of(pa.array([unzip.decompress(x.as_buffer()) for x in part.column(2)], pa.binary()).cast(pa.string()), k))
                n = np.array([len(s) for s in sets])
                ids = [np.repeat(part.column(c).to_numpy(), n) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[0]), pa.array(ids[1]), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], ["node", "component", "n", "h"])

    return texts.select("node", "component", "packed").mapInArrow(run, "node long, component long, n long, h long")


def prefix_pairs(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b of different components which share one of the rarest shingles of each: a superset of the links between components.

    texts: node, component, packed. A shingle that one document has brings nobody together,
    but takes a place among its rarest.
    """
    sets = materialize(_shingles(texts, k), "shingles")
    often = sets.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    have = sets.join(often, "h").groupBy("node", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    # n - ceil(n * percent / 100) + 1 places, less those of shingles that no other document has
    places = F.expr(f"cast(size(s) - floor((n * {percent} + 99) / 100) + 1 as int)")
    rare = have.withColumn("places", places).where("places > 0").select("node", "component", "n", F.explode(F.expr("slice(s, 1, places)")).alias("x")).select("node", "component", "n", F.col("x.h").alias("h"))
    rare = materialize(rare, "rare")
    mixed = rare.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("h")
    rare = rare.join(mixed, "h")
    one, two = rare.alias("x"), rare.alias("y")
    fits = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    pairs = one.join(two, (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & fits)
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _placed(docs: DataFrame, more: str, words: int, percent: int, bins: int, rows: int, pair_limit: int) -> tuple[DataFrame, DataFrame]:
    """The sketches, and for each class: cls, class_id, component_id, first_row. docs: row, doc_id, text and others (``more``)."""
    base = materialize(_sketched(docs, words, bins, rows, more), "sketches")
    full = base.where("cls is not null")
    # equal sets: partial aggregation leaves one row for each class and task, however many copies there are
    classes = full.groupBy("cls").agg(F.min(F.struct("doc_id", "row", "keys")).alias("m"))
    classes = materialize(classes.select("cls", F.col("m.doc_id").alias("class_id"), F.col("m.row").alias("node"), F.col("m.keys").alias("keys")), "classes")

    # the aggregation combines within tasks first and the join may split a hot key, so no bucket must fit a task
    member = classes.select(F.explode("keys").alias("key"), "node")
    shared = member.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", "least")
    member = materialize(member.join(shared, "key").select("key", "least", "node"), "buckets")

    named = materialize(member.where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    who = member.select("node").distinct()
    # a class is looked for by its row, so each text comes once however many copies it has
    texts = materialize(full.select(F.col("row").alias("node"), "packed").join(who, "node", "left_semi"), "texts")
    links = materialize(_verified(named, texts, words, percent), "links")
    found = components(links)

    # what the stars left apart: pairs of one bucket whose documents are in different components
    placed = member.join(found.select(F.col("id").alias("node"), "component"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
    placed = materialize(placed.join(mixed, "key"), "placed")
    small = placed.where(F.col("size") <= pair_limit)
    one, two = small.alias("x"), small.alias("y")
    rest = one.join(two, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    large = placed.where(F.col("size") > pair_limit).select("node", "component").distinct()
    if not large.isEmpty():
        rest = rest.unionAll(prefix_pairs(texts.join(large, "node"), words, percent))
    rest = rest.distinct().join(named, ["a", "b"], "left_anti")
    extra = materialize(_verified(rest, texts, words, percent), "links")
    if not extra.isEmpty():
        found = components(links.unionAll(extra))

    one = classes.join(found.select(F.col("id").alias("node"), "component"), "node", "left").select("cls", "class_id", "node", F.coalesce("component", "node").alias("component"))
    least = one.groupBy("component").agg(F.min(F.struct("class_id", "node")).alias("m")).select("component", F.col("m.class_id").alias("component_id"), F.col("m.node").alias("first_row"))
    return base, one.join(least, "component").select("cls", "class_id", "component_id", "first_row")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bins: int = 160, rows: int = 4, pair_limit: int = 64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, class_id, component_id, kept, first."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base, names = _placed(docs, "", words, percent, bins, rows, pair_limit)
    out = base.select("row", "doc_id", "n_shingles", "cls").join(names, "cls", "left")
    least, null = F.coalesce("component_id", "doc_id"), F.lit(NO_ID).cast("long")
    return out.select(
        F.nullif("doc_id", null).alias("doc_id"),
        "n_shingles",
        F.nullif(F.coalesce("class_id", "doc_id"), null).alias("class_id"),
        F.nullif(least, null).alias("component_id"),
        (F.col("doc_id") == least).alias("kept"),
        (F.col("row") == F.coalesce("first_row", "row")).alias("first"),
    )


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bins: int = 160, rows: int = 4, pair_limit: int = 64) -> DataFrame:
    """The rows of ``docs`` that are ``first``, with all their columns: one of each component, and all without words.

    The rows travel in the table of sketches, so that the same row is found again whatever its doc_id.
    """
    names, text_at = docs.columns, docs.columns.index(text_col)
    inner = docs.toDF(*[f"_{k}" for k in range(len(names))])
    others = [k for k in range(len(names)) if k != text_at]
    keyed = inner.select(F.monotonically_increasing_id().alias("row"), F.col(f"_{names.index(id_col)}").cast("long").alias("doc_id"), F.col(f"_{text_at}").cast("string").alias("text"), *[f"_{k}" for k in others])
    more = "".join(f", _{k} {docs.schema[k].dataType.simpleString()}" for k in others)
    base, classes = _placed(keyed, more, words, percent, bins, rows, pair_limit)
    first = base.where("cls is null").unionByName(base.join(classes.select(F.col("first_row").alias("row")).distinct(), "row", "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            texts = pa.array([unzip.decompress(x.as_buffer()) if x.is_valid else None for x in b.column(0)], pa.binary()).cast(pa.string())
            cols = list(b.columns[1:])
            yield pa.RecordBatch.from_arrays([*cols[:text_at], texts, *cols[text_at:]], names)

    return first.select("packed", *[f"_{k}" for k in others]).mapInArrow(run, docs.schema)
