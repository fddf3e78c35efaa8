"""Suffix dedup: bytes that lie in a long string seen earlier, found by prefix doubling.

The operator removes every byte covered by a string of ``length`` bytes that also starts
earlier (smaller doc_id, or same document and earlier start). Ranking every suffix of a
corpus takes more shuffle than the corpus itself for each doubling, so positions are ranked
on a synchronising sample, which loses no match:

* A string of ``length`` bytes holds ``length - seed + 1`` seeds (strings of ``seed`` bytes);
  the one with the smallest hash (the leftmost of equals) is its anchor. Equal strings have
  their anchors at equal places, and the strings with one anchor start in one interval.
  About 2 in ``length - seed + 2`` positions are anchors.
* A seed's hash is built by doubling: the name of 2h bytes is made from the names of its two
  halves of h bytes, as prefix doubling does, so positions are ranked at offsets 1, 2, 4 ...
  up to the seed within the task, and past the seed by the shuffle below.
* Spark brings anchors of one seed name together and sorts them by (seed name, context name,
  position), the context being all the bytes that the anchor's strings reach. An anchor
  whose seed name is unique is done: none of its strings occurs again. An anchor that is not
  the first of its context has only repeated strings. What is left, the first of each of
  several contexts of one seed (the ends of a repeated passage), is ranked once more: its
  context goes to the place of its seed, where the single strings of ``length`` bytes are
  named and sorted by position, and all but the first of a name are repeats. A seed with
  more than ``CONTEXTS`` contexts has its strings ranked by a shuffle of their own instead.

Copies within a task are merged before the shuffle, so a passage that a third of all
documents share sends one row for each task and anchor. Names have 64 bits for the seed and 64
more for context or string, both functions of random byte values: two different strings meet
with a probability of about 2**-100 for each pair compared.

Every row is a document of its own: it gets a row number when the texts are packed into a table
of the shared folder, and spans, anchors and contexts belong to row numbers, never to doc_id.
doc_id only puts documents in order; a null doc_id is the smallest, and rows with the same
doc_id (or none) follow each other in the order of the table. So of repeated rows the first
keeps its text, and what different texts with one doc_id share stays in the first of them.
Null text is the empty text (``without_repeats`` hands null on); an empty table gives an empty
result. Other columns are not looked at, whatever their names; ``without_repeats`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BYTE, BYTE2, U, flat, ids_back, ids_of, materialize, mix, prefix_hash, release, span_hash

#: Bytes of text that a task looks at in one go; copies are merged within a group of GROUP such pieces.
PIECE, GROUP = 1 << 17, 64
#: Contexts of one seed that a task compares in memory.
CONTEXTS = 4096


def doubled_names(data: np.ndarray, seed: int) -> np.ndarray:
    """A name for each string of ``seed`` bytes (a power of two), from the names of its halves."""
    names, h = BYTE[data], 1
    while h < seed:
        n = len(names) - h
        names = mix(names[:n] * U(0x9FB21C651E98DF25) + names[h:]) if n > 0 else names[:0]
        h *= 2
    return names


def anchors(data: np.ndarray, off: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the strings that lie within one row each: position, first and last start of its strings, seed name."""
    e = np.empty(0, np.int64)
    if len(data) < length:
        return e, e, e, e.astype(np.uint64)
    names = doubled_names(data, seed)
    w = length - seed + 1
    # the smallest name in each window of w, leftmost of equals: by doubling, as positions
    best = np.arange(len(names))
    h = 1
    while 2 * h <= w:
        a, b = best[: len(best) - h], best[h:]
        best = np.where(names[b] < names[a], b, a)
        h *= 2
    if h < w:
        a, b = best[: len(best) - (w - h)], best[w - h :]
        best = np.where(names[b] < names[a], b, a)
    starts = np.arange(len(best))
    # a start needs its whole string within its row
    row_end = np.repeat(off[1:], np.diff(off))[: len(best)]
    ok = starts + length <= row_end
    starts, at = starts[ok], best[ok]
    if not len(starts):
        return e, e, e, e.astype(np.uint64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    i = np.flatnonzero(new)
    last = np.append(i[1:], len(at)) - 1
    return at[i], starts[i], starts[last], names[at[i]]


def _first_of(one: np.ndarray, two: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that are first of their name (one, two), and places that are repeats; the first place met again is neither."""
    order = np.lexsort((at, row, doc, two, one))
    new, again = _marks(one[order], two[order], row[order], at[order])
    return order[new], order[again]


def _marks(one: np.ndarray, two: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted places: whether each opens a new name, and whether it is a repeat."""
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(one)), 0))
    return new, ~new & ((row != row[head]) | (at != at[head]))


def _spans(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of overlapping or touching spans of each row, sorted."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    fresh = np.ones(len(row), dtype=bool)
    group = np.cumsum(np.r_[True, row[1:] != row[:-1]]) - 1
    # running maximum of hi within the row
    shift = group * (int(hi.max()) + 1)
    reach = np.maximum.accumulate(hi + shift) - shift
    fresh[1:] = (row[1:] != row[:-1]) | (lo[1:] > reach[:-1])
    i = np.flatnonzero(fresh)
    return row[i], lo[i], np.maximum.reduceat(hi, i)


#: Between tasks. kind 0: an anchor (place: its position, first and last start before it, packed); kind 1: a repeated span (place, context: lo, hi).
_ANCHOR_NAMES = ["kind", "seed", "context", "doc_id", "row", "place"]
_ANCHOR = "kind byte, seed long, context long, doc_id long, row long, place long"
#: kind 1: a repeated span; kind 2: an anchor whose strings, starting at lo to hi, are open; kind 3: a string at lo, named seed and hi.
_FOUND_NAMES = ["kind", "seed", "doc_id", "row", "lo", "hi"]
_FOUND = "kind byte, seed long, doc_id long, row long, lo long, hi long"


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False))


def _batch(kind: int, names: list[str], *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int8)), *map(_long, cols)], names)


def _found(kind: int, row: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: np.ndarray | None = None, doc: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.zeros(len(row), np.int64)
    return _batch(kind, _FOUND_NAMES, none if seed is None else seed, none if doc is None else doc, row, lo, hi)


def _by_piece(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Packed texts (row, doc_id, packed) to doc_id, row, bytes and offsets of about PIECE bytes."""
    import zstandard

    unzip = zstandard.ZstdDecompressor()
    for b in batches:
        row, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
        held: list[bytes] = []
        first = size = 0
        for k, x in enumerate(b.column(2)):
            held.append(unzip.decompress(x.as_buffer()))
            size += len(held[-1])
            if size >= PIECE or k == b.num_rows - 1:
                off = np.concatenate([[0], np.cumsum([len(t) for t in held])])
                yield doc[first : k + 1], row[first : k + 1], np.frombuffer(b"".join(held), np.uint8), off
                held, first, size = [], k + 1, 0


def _contexts(length: int, seed: int):
    """Texts to anchors, those of one context in one group merged."""

    def combined(part: list[tuple]) -> Iterator[pa.RecordBatch]:
        s, c, d, r, at, lo, hi = (np.concatenate(x) for x in zip(*part))
        first, rest = _first_of(s, c, d, r, at)
        place = (at[first] << 16) | ((at[first] - lo[first]) << 8) | (at[first] - hi[first])
        yield _batch(0, _ANCHOR_NAMES, s[first], c[first], d[first], r[first], place)
        if len(rest):
            row, lo, hi = _spans(r[rest], lo[rest], hi[rest] + length)
            yield _batch(1, _ANCHOR_NAMES, mix(row.view(np.uint64)), hi, np.zeros(len(row), np.int64), row, lo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for doc, rows, data, off in _by_piece(batches):
            at, lo, hi, name = anchors(data, off, length, seed)
            if len(at):
                p = prefix_hash(data, BYTE2)
                context = mix(span_hash(p, lo, hi + length) + (((at - lo) << 32) | (hi - lo)).astype(np.uint64))
                i = np.searchsorted(off, at, "right") - 1
                part.append((name, context, doc[i], rows[i], at - off[i], lo - off[i], hi - off[i]))
            if len(part) == GROUP:
                yield from combined(part)
                part = []
        if part:
            yield from combined(part)
        part.clear()
        release()

    return run


def _with_head(batches: Iterator[list[np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Sorted places (two names, doc_id, row, place), each batch led by the head (first row) of the name that was open, with their marks; the first batch has none."""
    head: list[np.ndarray] = []
    for cols in batches:
        if not len(cols[0]):
            continue
        if head:
            cols = [np.concatenate(x) for x in zip(head, cols)]
        one, two, _, row, at = cols
        new, again = _marks(one, two, row, at)
        yield cols, new, again
        i = int(np.flatnonzero(new)[-1])
        head = [c[i : i + 1] for c in cols]


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(k).to_numpy(zero_copy_only=False) for k in range(b.num_columns)]


def _ranked(length: int):
    """Rows sorted by kind, names and place to: kind 1, spans of anchors that are not first of their context, and the spans known before; kind 2, open anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[pa.RecordBatch] = []

        def anchors_only() -> Iterator[list[np.ndarray]]:
            for b in batches:
                kind, *cols = _columns(b)
                n = int(np.searchsorted(kind, 1))
                if n < len(kind):
                    _, hi, _, row, lo = (c[n:] for c in cols)
                    known.append(_found(1, row, lo, hi))
                yield [c[:n] for c in cols]

        several = False  # the open seed has had more than one context, so its head has been sent
        for (s, _, d, r, place), new, again in _with_head(anchors_only()):
            at, lo, hi = place >> 16, (place >> 8) & 255, place & 255
            lo, hi = at - lo, at - hi
            seed = np.ones(len(s), dtype=bool)
            seed[1:] = s[1:] != s[:-1]
            group = np.cumsum(seed) - 1
            contexts = np.bincount(group, weights=new) + (several * (np.arange(group[-1] + 1) == 0))
            if again.any():
                yield _found(1, r[again], lo[again], hi[again] + length)
            open_ = new & (contexts[group] > 1)
            open_[0] &= not several
            if open_.any():
                yield _found(2, r[open_], lo[open_], hi[open_], s[open_], d[open_])
            several = bool(contexts[-1] > 1)
            yield from known
            known.clear()
        yield from known

    return run


def _context_bytes(length: int):
    """Packed documents with their open anchors to one row for each: seed, doc_id, row, lo and the context's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            for row, doc, packed, seeds, los, his in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), b.column(4), b.column(5)):
                raw = unzip.decompress(packed.as_buffer())
                seed, lo, hi = (x.values.to_numpy() for x in (seeds, los, his))
                ok = hi + length <= len(raw)
                seed, lo, hi = seed[ok], lo[ok], hi[ok] + length
                for i in range(0, len(lo), 50_000):
                    part = slice(i, i + 50_000)
                    texts = [raw[x:y] for x, y in zip(lo[part].tolist(), hi[part].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(seed[part]), pa.array(np.full(len(texts), doc)), pa.array(np.full(len(texts), row)), pa.array(lo[part]), pa.array(texts, pa.binary())], ["seed", "doc_id", "row", "lo", "context"])

    return run


def _by_seed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by seed, cut between two seeds; a seed with more than CONTEXTS rows comes in parts, marked so."""
    held: list[pa.RecordBatch] = []
    large: int | None = None
    for b in batches:
        for i in range(0, b.num_rows, CONTEXTS):
            part = b.slice(i, CONTEXTS)
            seed = part.column(0).to_numpy()
            if large is not None:
                n = int(np.searchsorted(seed, large, "right"))
                if n:
                    yield pa.Table.from_batches([part.slice(0, n)]), True
                if n == len(seed):
                    continue
                part, seed, large = part.slice(n), seed[n:], None
            cut = int(np.searchsorted(seed, seed[-1], "left"))
            if cut:
                yield pa.Table.from_batches([*held, part.slice(0, cut)]), False
                held = []
            held.append(part.slice(cut))
            if sum(x.num_rows for x in held) > CONTEXTS:
                large = int(seed[-1])
                yield pa.Table.from_batches(held), True
                held = []
    if held:
        yield pa.Table.from_batches(held), False


def _resolved(length: int):
    """Contexts of the same seeds to kind 1, spans of repeated strings; kind 3, the strings of seeds with too many contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, large in _by_seed(batches):
            t = t.combine_chunks()
            doc, rows, lo = (t[c].to_numpy() for c in ("doc_id", "row", "lo"))
            size = pc.binary_length(t["context"]).to_numpy().astype(np.int64)
            data = np.frombuffer(b"".join(t["context"].to_pylist()), dtype=np.uint8)
            off = np.concatenate([[0], np.cumsum(size)])
            count = size - length + 1
            i = np.repeat(np.arange(len(size)), count)
            step = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            begin = off[i] + step
            one = mix(span_hash(prefix_hash(data, BYTE), begin, begin + length))
            two = mix(span_hash(prefix_hash(data, BYTE2), begin, begin + length))
            doc, row, at = doc[i], rows[i], lo[i] + step
            if large:
                yield _found(3, row, at, two, one, doc)
                continue
            _, rest = _first_of(one, two, doc, row, at)
            if len(rest):
                yield _found(1, *_spans(row[rest], at[rest], at[rest] + length))
        release()

    return run


def _repeats(length: int):
    """Sorted strings to the spans of all but the first of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, r, at), _, again in _with_head(map(_columns, batches)):
            if again.any():
                yield _found(1, *_spans(r[again], at[again], at[again] + length))

    return run


def _packed(docs: DataFrame, more: str = "") -> DataFrame:
    """row, doc_id and the text's bytes, packed, written as a table; docs: row, doc_id, text and other columns, which ``more`` names as DDL and which stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zstd = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                data, off = flat(part.column(2))
                raw, o = data.tobytes(), off.tolist()
                packed = [zstd.compress(raw[x:y]) for x, y in zip(o, o[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids_of(part.column(1))), pa.array(packed, pa.binary()), *part.columns[3:]], ["row", "doc_id", "packed", *part.schema.names[3:]])

    return materialize(docs.mapInArrow(run, "row long, doc_id long, packed binary" + more), "packed")


def repeated_spans(packed: DataFrame, length: int, seed: int) -> DataFrame:
    """row, lo, hi of spans whose union is what to remove; packed: the table of ``_packed``."""
    if length - seed > 255:
        raise ValueError("a seed must be at most 255 bytes shorter than length")
    packed = packed.select("row", "doc_id", "packed")
    sent = packed.mapInArrow(_contexts(length, seed), _ANCHOR).repartition("seed").sortWithinPartitions("kind", "seed", "context", "doc_id", "row", "place")
    ranked = materialize(sent.mapInArrow(_ranked(length), _FOUND), "ranked")
    open_ = ranked.where("kind = 2").groupBy("row").agg(F.collect_list(F.struct("seed", "lo", "hi")).alias("s")).select("row", *(F.col(f"s.{c}").alias(f"{c}s") for c in ("seed", "lo", "hi")))
    contexts = packed.join(open_, "row").select("row", "doc_id", "packed", "seeds", "los", "his").mapInArrow(_context_bytes(length), "seed long, doc_id long, row long, lo long, context binary")
    resolved = materialize(contexts.repartition("seed").sortWithinPartitions("seed", "doc_id", "row", "lo").mapInArrow(_resolved(length), _FOUND), "resolved")
    spans = ranked.where("kind = 1").select("row", "lo", "hi").unionAll(resolved.where("kind = 1").select("row", "lo", "hi"))
    large = resolved.where("kind = 3")
    if large.isEmpty():
        return spans
    names = large.select("seed", "hi", "doc_id", "row", "lo").repartition("seed", "hi").sortWithinPartitions("seed", "hi", "doc_id", "row", "lo")
    return spans.unionAll(names.mapInArrow(_repeats(length), _FOUND).select("row", "lo", "hi"))


def _cut(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether each byte goes."""
    mark = np.zeros(len(data) + 1, dtype=np.int64)
    ok = lo < len(data)
    np.add.at(mark, lo[ok], 1)
    np.add.at(mark, np.minimum(hi[ok], len(data)), -1)
    return np.cumsum(mark)[:-1] > 0


def _with_spans(docs: DataFrame, length: int, seed: int, more: str = "") -> DataFrame:
    """doc_id, packed, los, his and the other columns."""
    packed = _packed(docs, more)
    spans = repeated_spans(packed, length, seed).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("s")).select("row", F.col("s.lo").alias("los"), F.col("s.hi").alias("his"))
    return packed.join(spans, "row", "left").select("doc_id", "packed", "los", "his", *packed.columns[3:])


def _each(b: pa.RecordBatch, unzip) -> Iterator[tuple[bytes, np.ndarray]]:
    for packed, los, his in zip(b.column(1), b.column(2), b.column(3)):
        raw = unzip.decompress(packed.as_buffer())
        data = np.frombuffer(raw, dtype=np.uint8)
        if los.is_valid:
            yield raw, _cut(data, los.values.to_numpy(), his.values.to_numpy())
        else:
            yield raw, np.zeros(0, dtype=bool)


def dedup(docs: DataFrame, length: int = 100, seed: int = 32) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in batches:
            n, removed, spans, digest = [], [], [], []
            for raw, gone in _each(b, unzip):
                n.append(len(raw))
                removed.append(int(np.count_nonzero(gone)))
                spans.append(int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0]))
                kept = raw if not removed[-1] else np.frombuffer(raw, np.uint8)[~gone].tobytes()
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([ids_back(ids_of(b.column(0))), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_spans(keyed, length, seed).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _kept_text(raw: bytes, gone: np.ndarray) -> str:
    """What is left of a text, whole characters only."""
    if gone.any():
        data = np.frombuffer(raw, np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        stays = np.zeros(int(char[-1]) + 1, dtype=bool)
        stays[char[~gone]] = True
        raw = data[stays[char]].tobytes()
    return raw.decode()


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", length: int = 100, seed: int = 32) -> DataFrame:
    """``docs`` with repeats cut from ``text_col``; a length column, if there is one, follows; null text stays null, all other columns stay.

    A character goes only with all its bytes: one that a span cuts stays.
    """
    names = docs.columns
    text_at, others = names.index(text_col), [k for k, c in enumerate(names) if c != text_col]
    inner = docs.toDF(*[f"_{k}" for k in range(len(names))])
    null = F.col(f"_{text_at}").isNull().alias("_null")
    keyed = inner.select(F.monotonically_increasing_id().alias("row"), F.col(f"_{names.index(id_col)}").cast("long").alias("doc_id"), F.col(f"_{text_at}").cast("string").alias("text"), null, *[f"_{k}" for k in others])
    more = ", _null boolean" + "".join(f", _{k} {docs.schema[k].dataType.simpleString()}" for k in others)
    long_at = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for b in (b.slice(i, 500) for b in batches for i in range(0, b.num_rows, 500)):
            texts, hit = [], []
            for (raw, gone), null in zip(_each(b, unzip), b.column(4).to_pylist()):
                hit.append(bool(gone.any()))
                texts.append(None if null else _kept_text(raw, gone))
            cols = list(b.columns[5:])
            cols.insert(text_at, pa.array(texts, pa.string()))
            if long_at is not None:
                n = [len(t) if h else old for t, h, old in zip(texts, hit, cols[long_at].to_pylist())]
                cols[long_at] = pa.array(n, pa.int64()).cast(cols[long_at].type)
            yield pa.RecordBatch.from_arrays(cols, names)
        release()

    return _with_spans(keyed, length, seed, more).mapInArrow(run, docs.schema)
