"""Related-document packing: neighbour graph, greedy low-degree-first paths, windows along each path.

1. Every text is encoded and sketched: each shingle of ``SHINGLE`` words is hashed into one of
   ``BINS`` bins, and a bin keeps its smallest hash. The likeness of two documents is the share of
   equal bins among those that either fills, which estimates the likeness of their shingle sets.
2. The graph is sought over the whole corpus, not in blocks, and it is exact: a document's
   neighbours are its ``k`` best of all documents with ``FLOOR`` equal bins (or more than half of
   few). Every filled bin is a bucket, and buckets of one document leave first. In a bucket, sorted
   by the bins after its own, every document is compared with the next ``REACH``. That is every
   pair of a bucket of up to ``REACH`` + 1 documents, so a pair that was not compared shares only
   larger, hot buckets. For those a second pass looks: a document whose worst neighbour so far (or
   the least likeness, if it has fewer than ``k``) is beaten by ``least`` equal bins asks in all
   but the ``least`` - 1 largest of its hot buckets, where every better partner must meet it, and
   is compared with all documents there that have ``least`` hot buckets of that size or more.
   Hot buckets are dealt out, so each task holds ``HELD`` of their documents.
3. Connected documents have one component. Components are laid one after the other and cut into
   blocks of about ``block_docs`` documents, so no task grows with the corpus; only a component
   larger than a block is cut. Walks need row numbers, lengths and links alone: texts and ids stay
   where they are. A walk starts at the unvisited document of lowest degree and goes on to the most
   similar unvisited neighbour until there is none; then the next walk starts.
4. The ids along the walks are one stream, cut into windows of ``window`` ids. The last, open
   window of a block is cut into powers of two, largest first, so nothing is padded. The pieces
   then meet the ids by row number.

Null text is the empty text: its document is the end id alone. A null doc_id packs like any
other. Rows with the same doc_id, and repeated rows, stay separate documents; each has its own
pieces, starting at 0. Without rows the result is empty. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import U, flat, ids_back, ids_of, materialize, mix, pieces, release, span_hashes, word_hashes, word_spans
from .components import components
from .wordids import word_table

SHINGLE, BINS, FLOOR = 3, 24, 3
#: First pass: documents of a bucket that each is compared with, and those of a bucket that go to one task.
REACH, HOT = 24, 1 << 16
#: Second pass: documents of a hot bucket that a task holds, and those that ask them in one task.
HELD, ASKING = 1 << 12, 1 << 16
_NONE = np.uint64(2**64 - 1)


def sketches(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each row the smallest hash in every bin, or all ones where it is empty. A row with fewer than SHINGLE words has one shingle."""
    return _sketches(*word_hashes(data, off))


def _sketches(wh: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The same from the words' hashes and the rows' word offsets."""
    n = len(w) - 1
    out = np.full(n * BINS, _NONE, dtype=np.uint64)
    row = np.repeat(np.arange(n), np.diff(w))
    if len(wh) >= SHINGLE:
        m = len(wh) - SHINGLE + 1
        h = np.zeros(m, dtype=np.uint64)
        for j in range(SHINGLE):
            h = mix(h * U(0x9FB21C651E98DF25) + wh[j : m + j])
        whole = row[:m] == row[SHINGLE - 1 :]
        h, at = h[whole], row[:m][whole]
        np.minimum.at(out, at * BINS + _bin(h), h)
    size = np.diff(w)
    for i in np.flatnonzero((size > 0) & (size < SHINGLE)).tolist():
        x = np.full(1, size[i], dtype=np.uint64)
        for v in wh[w[i] : w[i + 1]]:
            x = mix(x * U(0xD6E8FEB86659FD93) + v)
        out[i * BINS + _bin(x)] = x
    return out.reshape(n, BINS)


def _bin(h: np.ndarray) -> np.ndarray:
    return (((h >> U(40)) * U(BINS)) >> U(24)).astype(np.int64)


def short(sk: np.ndarray) -> np.ndarray:
    """16 bits of each bin, never 0 but where it is empty: enough to compare documents that share a bucket."""
    return np.where(sk == _NONE, 0, (sk & U(0x7FFF)).astype(np.uint16) + np.uint16(1)).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal bins of rows of ``short`` sketches, and their share of the bins that either fills."""
    same = ((a == b) & (a != 0)).sum(axis=1)
    return same, same / np.maximum(((a | b) != 0).sum(axis=1), 1)


def _best(key: np.ndarray, a: np.ndarray, b: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs are among the k best of (key, a)."""
    order = np.lexsort((b, -score, a, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (key[order][1:] != key[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < k]


def _compared(k: int):
    """Rows (key, salt, row, sketch), sorted by bucket, to directed pairs a, b, score."""

    def pairs(key: np.ndarray, row: np.ndarray, sk: np.ndarray, fresh: int) -> pa.RecordBatch | None:
        """Pairs whose later row is at ``fresh`` or after."""
        found: list[tuple[np.ndarray, ...]] = []
        for step in range(1, min(REACH, len(key) - 1) + 1):
            i = np.flatnonzero(key[step:] == key[:-step])
            i = i[i + step >= fresh]
            if not len(i):
                continue
            same, score = likeness(sk[i], sk[i + step])
            ok = (same >= FLOOR) | (score > 0.5)
            found.append((key[i][ok], row[i][ok], row[i + step][ok], score[ok].astype(np.float32)))
        if not found:
            return None
        g, a, b, x = (np.concatenate(c) for c in zip(*found))
        g, a, b, x = np.concatenate([g, g]), np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([x, x])
        ok = _best(g, a, b, x, k)
        return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(x[ok])], ["a", "b", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        old: list[np.ndarray] = []
        for b in batches:
            # a bucket's number and part as one value; equal only by a chance of 2**-64
            key = mix(b.column(0).to_numpy().view(np.uint64) * U(3) + b.column(1).to_numpy().astype(np.uint64))
            sk = np.frombuffer(b"".join(b.column(3).to_pylist()), dtype="<u2").reshape(-1, BINS)
            new = [key, b.column(2).to_numpy(), sk]
            fresh = len(old[0]) if old else 0
            new = [np.concatenate(x) for x in zip(old, new)] if old else new
            out = pairs(*new, fresh)
            if out is not None:
                yield out
            old = [x[-REACH:].copy() for x in new]
        release()

    return run


def _asked(k: int):
    """Rows (key, part, turn, asks, row, least, sketch), sorted by bucket and those that ask last, to directed pairs a, b, score."""

    def pairs(held: tuple[np.ndarray, ...], row: np.ndarray, least: np.ndarray, sk: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, rest, other = held
        columns = np.ascontiguousarray(other.T)
        step = max(1, (1 << 18) // len(rows))
        for i in range(0, len(row), step):
            asking = sk[i : i + step]
            mine = np.where(asking == 0, np.uint16(0xFFFF), asking)  # empty bins equal nothing
            same = np.zeros((len(mine), len(rows)), dtype=np.uint8)
            for c in range(BINS):
                same += mine[:, c, None] == columns[c]
            need = least[i : i + step, None]
            x, y = np.nonzero((same >= need) & (rest >= need) & (row[i : i + step, None] != rows))
            if not len(x):
                continue
            scores = [likeness(asking[x[j : j + 65536]], other[y[j : j + 65536]]) for j in range(0, len(x), 65536)]
            equal, score = (np.concatenate(c) for c in zip(*scores))
            ok = (equal >= FLOOR) | (score > 0.5)
            a, b, score = row[i : i + step][x[ok]], rows[y[ok]], score[ok].astype(np.float32)
            ok = _best(np.zeros(len(a), dtype=np.int64), a, b, score, k)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(score[ok])], ["a", "b", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part, turn, asks, row, least = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(6))
            sk = np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype="<u2").reshape(-1, BINS)
            new = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (turn[1:] != turn[:-1]) | (asks[1:] != asks[:-1])
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(key)]
            for i, j in zip(edges, edges[1:]):
                if bucket != (key[i], part[i], turn[i]):
                    bucket, held = (key[i], part[i], turn[i]), []
                if not asks[i]:
                    held.append((row[i:j], least[i:j], sk[i:j]))
                elif held:
                    held = [tuple(map(np.concatenate, zip(*held)))]
                    yield from pairs(held[0], row[i:j], least[i:j], sk[i:j])
        release()

    return run


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """row, near: the ``k`` best of directed pairs a, b, score as structs (score, row), best first."""
    best = pairs.groupBy("a").agg(F.sort_array(F.collect_set(F.struct("score", (-F.col("b")).alias("b"))), asc=False).alias("near"))
    return best.select(F.col("a").alias("row"), F.expr(f"transform(slice(near, 1, {k}), x -> struct(x.score as score, -x.b as row))").alias("near"))


def neighbours(base: DataFrame, k: int) -> DataFrame:
    """row, near: its at most ``k`` neighbours as structs (score, row), best first; base: row, keys (bins or null), sketch."""
    keys = base.select("row", F.posexplode("keys").alias("bin", "key")).where("key is not null")
    member = materialize(keys.withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1"), "buckets")
    held = member.join(base.select("row", "sketch"), "row")
    held = held.select("key", F.expr(f"cast(pmod(row, 1 + size div {HOT}) as int)").alias("salt"), "row", "sketch", F.expr("substring(concat(sketch, sketch), 2 * bin + 3, 12)").alias("tail"))
    held = held.repartition("key", "salt").sortWithinPartitions("key", "salt", "tail", "row").select("key", "salt", "row", "sketch")
    first = materialize(_nearest(held.mapInArrow(_compared(k), "a long, b long, score float"), k), "nearest")

    # second pass: what only hot buckets bring together; each document's hot buckets, smallest first
    hot = member.where(F.col("size") > REACH + 1).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("size", "key"))).alias("hot"))
    fill = F.expr("size(filter(keys, x -> x is not null))").alias("fill")
    hot = hot.join(base.select("row", "sketch", fill), "row").join(first, "row", "left")
    # a likeness above x takes more than x * fill equal bins
    least = f"greatest(least({FLOOR}, fill div 2 + 1), if(size(near) >= {k}, floor(near[{k - 1}].score * fill + 1e-4) + 1, 0))"
    hot = materialize(hot.select("row", "sketch", "hot", F.expr(f"cast({least} as int)").alias("least")), "hot")
    asks = hot.where("size(hot) >= least").select("row", "sketch", "least", F.explode(F.expr("slice(hot, 1, size(hot) - least + 1)")).alias("x"))
    asks = asks.select(F.col("x.key").alias("key"), F.explode(F.expr(f"sequence(0, x.size div {HELD})")).alias("part"), F.expr(f"pmod(row, 1 + x.size div {ASKING})").alias("turn"), F.lit(True).alias("asks"), "row", "least", "sketch")
    there = hot.select("row", "sketch", F.size("hot").alias("n"), F.posexplode("hot").alias("place", "x"))
    there = there.select(F.col("x.key").alias("key"), F.expr(f"pmod(row, 1 + x.size div {HELD})").alias("part"), F.explode(F.expr(f"sequence(0, x.size div {ASKING})")).alias("turn"), F.lit(False).alias("asks"), "row", F.expr("n - place").alias("least"), "sketch")
    there = there.join(asks.select("key").distinct(), "key", "left_semi")
    both = there.unionAll(asks).repartition("key", "part", "turn").sortWithinPartitions("key", "part", "turn", "asks", "row")
    more = _nearest(both.mapInArrow(_asked(k), "a long, b long, score float"), k)
    every = first.join(more.select("row", F.col("near").alias("more")), "row", "full")
    every = every.select("row", F.expr("array_distinct(concat(coalesce(near, array()), coalesce(more, array())))").alias("near"))
    return every.select("row", F.expr(f"transform(slice(sort_array(transform(near, x -> struct(x.score as score, -x.row as b)), false), 1, {k}), x -> struct(x.score as score, -x.b as row))").alias("near"))


def neighbour_walk(links: list[dict[int, float]], tie: list[int]) -> list[int]:
    """The order in which the walks visit the nodes; ``links``: each node's neighbours with their scores, ``tie`` decides between equals."""
    start = sorted(range(len(links)), key=lambda a: (len(links[a]), tie[a]))
    seen = bytearray(len(links))
    out = []
    for a in start:
        while a is not None and not seen[a]:
            seen[a] = 1
            out.append(a)
            a = min((b for b in links[a] if not seen[b]), key=lambda b: (-links[a][b], len(links[b]), tie[b]), default=None)
    return out


def windows(lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Cuts documents that follow each other into sequences: for each piece its document's index, start, length, sequence and offset."""
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    edges = np.arange(0, total - total % window + 1, window)
    rest, more = total % window, []
    at = int(edges[-1])
    while rest:
        size = 1 << (rest.bit_length() - 1)
        at += size
        more.append(at)
        rest -= size
    edges = np.append(edges, more).astype(np.int64)
    cuts = np.unique(np.concatenate([edges, ends]))
    begin, length = cuts[:-1], np.diff(cuts)
    doc = np.searchsorted(ends, begin, "right")
    seq = np.searchsorted(edges, begin, "right") - 1
    return doc, begin - (ends - lengths)[doc], length, seq, begin - edges[seq]


def _encoded(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """row, doc_id, n, keys, sketch, ids; docs: row, doc_id, text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        table, zstd = word_table(vocabulary), zstandard.ZstdCompressor(level=1)
        small = _small(table.size, end_id)
        for b in batches:
            ids = ids_of(b.column(1))
            data, off = flat(b.column(2))
            out, size = [], 0
            for i, j in pieces(off, 1 << 17):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                s, e, w = word_spans(part, at)
                wh = span_hashes(part, s, e)
                sk = _sketches(wh, w)
                if table.by_word:
                    found, count = table.ids(part, s, e, wh)
                    n = np.diff(np.concatenate([[0], np.cumsum(count)])[w])
                else:
                    raw = [table.encoder.ids(t) for t in b.column(2).slice(i, j - i).to_pylist()]
                    found, n = np.frombuffer(b"".join(raw), dtype="<u4"), np.array([len(r) // 4 for r in raw])
                ended = np.full(len(found) + j - i, end_id, dtype=small)
                ended[np.arange(len(found)) + np.repeat(np.arange(j - i), n)] = found
                n = n + 1
                cut = np.concatenate([[0], np.cumsum(n)]).tolist()
                packed = [zstd.compress(ended[x:y].tobytes()) for x, y in zip(cut, cut[1:])]
                keys = pa.array(sk.ravel().view(np.int64), mask=(sk == _NONE).ravel())
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BINS), pa.int32()), keys)
                cols = [b.column(0).slice(i, j - i), pa.array(ids[i:j]), pa.array(n, pa.int64()), keys]
                cols += [pa.array([x.tobytes() for x in short(sk)], pa.binary()), pa.array(packed, pa.binary())]
                out.append(pa.RecordBatch.from_arrays(cols, ["row", "doc_id", "n", "keys", "sketch", "ids"]))
                size += j - i
                if size >= 1000 or j == b.num_rows:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, size = [], 0
        release()

    return materialize(docs.mapInArrow(encode, "row long, doc_id long, n long, keys array<long>, sketch binary, ids binary"), "encoded")


def _laid(window: int):
    """Rows (block, row, n, near) of one block to their pieces: row, starts, lengths, sequences, offsets."""

    def done(t: pa.Table) -> pa.RecordBatch:
        row, n = t["row"].to_numpy(), t["n"].to_numpy()
        links: list[dict[int, float]] = [{} for _ in range(len(row))]
        near = t["near"].combine_chunks()
        other, score = (near.values.field(c).to_numpy(zero_copy_only=False) for c in ("row", "score"))
        mine = np.repeat(np.arange(len(row)), pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False))
        base = near.offsets[0].as_py()
        other, score = other[base : base + len(mine)], score[base : base + len(mine)]
        order = np.argsort(row)
        at = np.minimum(np.searchsorted(row[order], other), len(row) - 1)
        inside = row[order][at] == other
        for a, b, x in zip(mine[inside].tolist(), order[at[inside]].tolist(), score[inside].tolist()):
            links[a][b] = links[b][a] = x
        walk = np.array(neighbour_walk(links, row.tolist()))
        doc, start, length, seq, offset = windows(n[walk], window)
        seq = seq + (int(t["block"][0].as_py()) << 34)
        cut = np.searchsorted(doc, np.arange(len(walk) + 1))
        lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.astype(np.int64))) for x in (start, length, seq, offset)]
        return pa.RecordBatch.from_arrays([pa.array(row[walk]), *lists], ["row", "starts", "lengths", "sequences", "offsets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield done(pa.Table.from_batches(held))
        del held
        release()

    return run


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text", k: int = 8, block_docs: int = 32768, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    encoded = _encoded(docs, vocabulary, end_id)
    near = materialize(neighbours(encoded.select("row", "keys", "sketch"), k), "near")
    parts = components(near.select("row", F.explode("near.row").alias("other")), "row", "other")
    light = encoded.select("row", "n").join(near, "row", "left").join(parts.select(F.col("id").alias("row"), "component"), "row", "left")
    light = materialize(light.select(F.coalesce("component", "row").alias("code"), "row", "n", "near"), "linked")
    blocks = max(1, -(-light.count() // block_docs))
    # the table is written, so the sampled bounds of the blocks hold for every task that runs again
    ranged = light.repartitionByRange(blocks, "code", "row").withColumn("block", F.spark_partition_id()).sortWithinPartitions("code", "row")
    laid = ranged.select("block", "row", "n", "near").mapInArrow(_laid(window), "row long, starts array<long>, lengths array<long>, sequences array<long>, offsets array<long>")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                count, crc, kept = [], [], []
                for n, packed, starts, lengths in zip(part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), part.column(4).to_pylist()):
                    raw = unzip.decompress(packed.as_buffer())
                    raw = np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype("<u4").tobytes()
                    count.append(len(starts))
                    for s, m in zip(starts, lengths):
                        piece = raw[4 * s : 4 * (s + m)]
                        crc.append(zlib.crc32(piece))
                        if keep_ids:
                            kept.append(piece)
                ids, n = (np.repeat(x, count) for x in (ids_of(part.column(0)), part.column(1).to_numpy()))
                start, length, seq, offset = (part.column(c).flatten() for c in (3, 4, 5, 6))
                cols = [ids_back(ids), start, length, pa.array(crc, pa.int64()), pa.array(n), seq, offset]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.binary())] if keep_ids else cols, [*names, "ids"] if keep_ids else names)
        release()

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    out = encoded.join(laid, "row").select("doc_id", "n", "ids", "starts", "lengths", "sequences", "offsets").mapInArrow(fill, ddl)
    # pieces are small: two partitions for each block, so that a write makes no crowd of small files
    return out.coalesce(2 * blocks)


def _small(size: int, end_id: int) -> np.dtype:
    return np.dtype("<u2") if max(size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
