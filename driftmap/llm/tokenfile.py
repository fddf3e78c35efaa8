"""Bit-plane shuffled token files.

``write`` encodes documents and writes their ids in ascending id order, one file for each
range of ids; ``read`` gives the documents' ids back from the files alone.

File layout: magic; for each block of ``block`` ids its planes, one zstandard frame each
(bit mode: one plane for each bit an id may need; byte mode: one for each byte); the
document table (ids and lengths) as a frame; the chunk index (JSON: for each block the
offset, its ids and the planes' sizes); the length of the index; magic.

Null text is the empty text: its document holds the end id alone. A null doc_id sorts
first. Rows with the same doc_id stay separate documents, next to each other. A file
appears under its final name only when it is whole, so a task that is run again after an
executor was lost writes the same file once more. Without rows there is no file and the result is
empty. Other columns are not looked at.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import NO_ID, IdRanges, ids_back, ids_of, materialize, shared_path
from .wordids import encoder

MAGIC = b"PLANES01"


def shuffle_planes(ids: np.ndarray, bits: int, mode: str) -> list[bytes]:
    """The planes of a block of ids, lowest first."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [raw[:, b].tobytes() for b in range((bits + 7) // 8)]
    out = []
    for b in range((bits + 7) // 8):
        col = np.unpackbits(np.ascontiguousarray(raw[:, b])[:, None], axis=1, bitorder="little")
        out += [np.packbits(col[:, k], bitorder="little").tobytes() for k in range(min(8, bits - 8 * b))]
    return out


def join_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    """The ids of a block from its planes."""
    raw = np.zeros((n, 4), dtype=np.uint8)
    if mode == "byte":
        for b, p in enumerate(planes):
            raw[:, b] = np.frombuffer(p, dtype=np.uint8)
    else:
        for k, p in enumerate(planes):
            bit = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little")
            raw[:, k // 8] |= bit << (k % 8)
    return raw.reshape(-1).view("<u4")


class PlaneWriter:
    """Writes one file; ``add`` takes documents in order."""

    def __init__(self, out, bits: int, mode: str = "byte", block: int = 1 << 16, level: int = 3):
        import zstandard

        self.out, self.bits, self.mode, self.block = out, bits, mode, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.pending: list[np.ndarray] = []
        self.n_pending = self.at = 0
        self.chunks: list[list] = []
        self.doc_ids: list[int] = []
        self.lengths: list[int] = []
        self._put(MAGIC)

    def _put(self, b: bytes) -> None:
        self.out.write(b)
        self.at += len(b)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.n_pending += len(ids)
        if self.n_pending >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        if not self.n_pending:
            return
        ids = np.concatenate(self.pending)
        i = 0
        while len(ids) - i >= self.block or (last and i < len(ids)):
            part = ids[i : i + self.block]
            at, sizes = self.at, []
            for p in shuffle_planes(part, self.bits, self.mode):
                z = self.zstd.compress(p)
                sizes.append(len(z))
                self._put(z)
            self.chunks.append([at, len(part), sizes])
            i += len(part)
        self.pending, self.n_pending = [ids[i:]], len(ids) - i

    def close(self) -> int:
        self._flush(True)
        table = self.zstd.compress(np.array([self.doc_ids, self.lengths], dtype="<i8").tobytes())
        index = json.dumps({"mode": self.mode, "docs": [self.at, len(table), len(self.doc_ids)], "chunks": self.chunks}).encode()
        self._put(table)
        self._put(index)
        self._put(len(index).to_bytes(8, "little") + MAGIC)
        return sum(self.lengths)


class PlaneReader:
    """Reads one file; blocks are decoded one at a time, and any block can be reached by its index entry."""

    def __init__(self, src):
        import zstandard

        self.src, self.zstd = src, zstandard.ZstdDecompressor()
        src.seek(0, 2)
        size = src.tell()
        src.seek(size - 16)
        tail = src.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a plane file")
        n = int.from_bytes(tail[:8], "little")
        src.seek(size - 16 - n)
        head = json.loads(src.read(n))
        self.mode, self.chunks = head["mode"], head["chunks"]
        at, length, docs = head["docs"]
        src.seek(at)
        table = np.frombuffer(self.zstd.decompress(src.read(length)), dtype="<i8").reshape(2, docs)
        self.doc_ids, self.lengths = table

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.chunks[k]
        self.src.seek(at)
        return join_planes([self.zstd.decompress(self.src.read(s)) for s in sizes], n, self.mode)

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        rest, k = np.empty(0, dtype="<u4"), 0
        for d, n in zip(self.doc_ids.tolist(), self.lengths.tolist()):
            got = [rest]
            have = len(rest)
            while have < n:
                got.append(self.block(k))
                have += len(got[-1])
                k += 1
            ids = np.concatenate(got) if len(got) > 1 else rest
            yield d, ids[:n]
            rest = ids[n:]


def write(docs: DataFrame, vocabulary: str, end_id: int, out: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "byte", block: int = 1 << 16, mb: float = 24) -> DataFrame:
    """Encodes and writes ``docs``; returns one row for each file: part, path, n_docs, n_ids, base.

    ``base`` counts the ids in all files before. The only shuffle carries the compressed
    ids, once, straight to the range of their doc_id.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = IdRanges(docs, "doc_id", "text", mb)
    at_of = ranges.of

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, zstd = encoder(vocabulary), zstandard.ZstdCompressor(level=1)
        end = np.array([end_id], dtype="<u4").tobytes()
        small = np.dtype("<u2") if max(enc.size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        for b in batches:
            ids = ids_of(b.column(0))
            part = at_of(ids)
            for i in range(0, b.num_rows, 500):
                col = b.column(1).slice(i, 500)
                data = [zstd.compress(np.frombuffer(enc.ids(t) + end, dtype="<u4").astype(small).tobytes()) for t in col.to_pylist()]
                j = i + len(data)
                yield pa.RecordBatch.from_arrays([pa.array(part[i:j]), pa.array(ids[i:j]), pa.array(data, pa.binary())], ["part", "doc_id", "ids"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs

        unzip, enc = zstandard.ZstdDecompressor(), encoder(vocabulary)
        n = max(enc.size, end_id + 1)
        small, bits = np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4"), max(1, (n - 1).bit_length())
        where, base = fs.FileSystem.from_uri(out)
        writer = sink = part = None
        for b in batches:
            for p, d, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if writer is None:
                    part, tmp = p, f"{base}/_{uuid.uuid4().hex}"
                    where.create_dir(base, recursive=True)
                    sink = where.open_output_stream(tmp)
                    writer = PlaneWriter(sink, bits, mode, block)
                writer.add(d, np.frombuffer(unzip.decompress(z.as_py()), dtype=small).astype("<u4"))
        if writer is not None:
            total = writer.close()
            sink.close()
            name = f"part-{part:07d}.planes"
            where.move(tmp, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{out}/{name}"], "n_docs": [len(writer.doc_ids)], "n_ids": [total]})

    encoded = docs.mapInArrow(encode, "part int, doc_id long, ids binary")
    files = (
        encoded.repartitionById(ranges.count, F.col("part"))
        .sortWithinPartitions("part", "doc_id")
        .mapInArrow(put, "part int, path string, n_docs long, n_ids long")
    )
    files = materialize(files, "plane-files")
    # one row for each file of mb MB, not for each document: small enough to sum in one task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read(files: DataFrame) -> DataFrame:
    """The documents of the files: doc_id, start, n_tokens, ids_crc32."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for path, at in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                where, p = fs.FileSystem.from_uri(path)
                with where.open_input_file(p) as src:
                    rows: list[tuple] = []
                    for d, ids in PlaneReader(src).documents():
                        rows.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                        if len(rows) == 20_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    n = max(1, files.count())
    return files.repartitionById(n, F.col("part")).mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    d, s, n, c = zip(*rows)
    return pa.RecordBatch.from_arrays([ids_back(d), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_and_read(docs: DataFrame, vocabulary: str, end_id: int = 2, **how) -> DataFrame:
    """Writes ``docs`` to the shared folder and returns what the files hold."""
    return read(write(docs, vocabulary, end_id, shared_path(docs.sparkSession, "planes"), **how))


__all__ = ["PlaneReader", "PlaneWriter", "join_planes", "read", "shuffle_planes", "write", "write_and_read", "NO_ID"]
