"""Quality rules: word statistics and compression bands.

Words are maximal runs of bytes other than space, \\t, \\n, \\v, \\f and \\r. The base rule
rejects a text of fewer than 10 words, or with more than a fifth of its words inside 5-word
windows that occur twice or more. The bands then reject text that zstandard packs too well
(repetitive) or hardly at all (no language): the ratio of the whole document and of each
fixed chunk of ``CHUNK`` bytes must lie within the limits for its length, and a document
goes when its whole, or more than a quarter of its chunks, falls outside.

Null text is the empty text: no words, rejected. A null doc_id stays null. Rows are judged one by
one, so repeated rows and ids get equal verdicts; without rows the result is empty. ``rules`` does
not look at other columns, ``kept`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, flat, pieces, word_spans

#: Bytes of a chunk, and the share of chunks that may fall outside.
CHUNK, CHUNK_SHARE = 4096, 0.25
#: (from this many bytes on, lowest ratio, highest ratio); frames of short texts hardly shrink.
BANDS = ((0, 0.0, 9.0), (128, 0.25, 1.05), (256, 0.25, 0.90), (512, 0.20, 0.82), (1024, 0.18, 0.75), (4096, 0.15, 0.70), (16384, 0.10, 0.68))
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def in_band(raw: int, packed: int) -> bool:
    low, high = next((a, b) for n, a, b in reversed(BANDS) if raw >= n)
    return low <= packed / max(1, raw) <= high


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows that the text has twice or more, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    w = [number.setdefault(x, len(number)) for x in words]
    seen: dict[tuple, int] = {}
    first = [seen.setdefault(x, i) for i, x in enumerate(zip(*[w[j : n + j] for j in range(width)]))]
    if len(seen) == n:
        return 0
    at = np.array(first)
    again = at != np.arange(n)
    again[at[again]] = True
    cover = np.zeros(len(w) + 1, dtype=np.int64)
    i = np.flatnonzero(again)
    np.add.at(cover, i, 1)
    np.add.at(cover, i + width, -1)
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


class Judge:
    """The rules for one Python worker."""

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks_out"]
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64()]
    ddl = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks_out long"

    def __init__(self, level: int = 3):
        import zstandard

        self.pack = zstandard.ZstdCompressor(level=level).compress

    def bands(self, text: bytes) -> tuple[float, int, bool]:
        """The whole's ratio, the chunks outside their band, and the verdict."""
        whole = len(self.pack(text))
        out = n = 0
        if len(text) > CHUNK:
            for i in range(0, len(text), CHUNK):
                c = text[i : i + CHUNK]
                out += not in_band(len(c), len(self.pack(c)))
                n += 1
        return whole / max(1, len(text)), out, in_band(len(text), whole) and out <= CHUNK_SHARE * n

    def columns(self, texts: pa.Array) -> list[pa.Array]:
        data, off = flat(texts)
        cols: list[list] = [[] for _ in self.names]
        for i, j in pieces(off):
            d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
            _, _, w = word_spans(d, o)
            # code points are the bytes that don't continue one
            chars = np.concatenate([[0], np.cumsum(((d & 0xC0) != 0x80) & ~SPACE[d])])
            symbols = np.concatenate([[0], np.cumsum(SYMBOLS[d])])
            cols[0] += np.diff(w).tolist()
            cols[1] += (chars[o[1:]] - chars[o[:-1]]).tolist()
            cols[2] += (symbols[o[1:]] - symbols[o[:-1]]).tolist()
            raw, bounds = d.tobytes(), o.tolist()
            for k, n in enumerate(np.diff(w).tolist()):
                text = raw[bounds[k] : bounds[k + 1]]
                repeated = repeated_words(text.split())
                failed = n < 10 or 100 * repeated > 20 * n
                ratio, out, fits = self.bands(text)
                for c, v in zip(cols[3:], (duplicate_lines(text), repeated, failed, not failed and fits, ratio, out)):
                    c.append(v)
        return [pa.array(c, t) for c, t in zip(cols, self.types)]


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the ratio and outlying chunks behind the verdict."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *judge.columns(b.column(1))], ["doc_id", *judge.names])

    return docs.mapInArrow(run, f"doc_id long, {Judge.ddl}")


def kept(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for b in batches:
            verdict = judge.columns(b.column(at))[judge.names.index("kept")]
            yield b.filter(verdict)

    return docs.mapInArrow(run, docs.schema)


__all__ = ["Judge", "kept", "rules"]
