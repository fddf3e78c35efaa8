"""Byte-level BPE by ranks: linear-time encoding with backtracking, and decoding.

A token sequence is the result of the merges exactly when every adjacent pair is compatible,
that is, when the merges of the two tokens' bytes never cross their border. So the encoder
takes the longest token at each place (found by an Aho-Corasick automaton over the bytes,
read as Latin-1), keeps it if it is compatible with the token before, tries shorter ones
otherwise, and steps back past a place from which nothing fits, never to enter it again.
Each place is left for good at most once, so the time is linear in the bytes.

Null text is the empty text: no ids. A null doc_id stays null; each row is its own document, also
where ids or whole rows are repeated; without rows the result is empty. Other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern whose matches begin with at most one space and never hold a space elsewhere, unless white space meets.
SPACE_LED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CODECS: dict[tuple[str, str], "BytePairCodec"] = {}


class BytePairCodec:
    """Encodes and decodes by a rank file; ``pattern`` cuts a text into the pieces that are encoded alone."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 500_000):
        import ahocorasick
        import regex

        self.ranks, self.most = ranks, most
        self.split = regex.compile(pattern)
        self.by_space = pattern == SPACE_LED  # any other pattern is applied to the whole text
        self.gaps = regex.compile(r"\s\s")
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for b, i in ranks.items():
            self.token[i] = b
        self.length = [len(b) for b in self.token]
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: The longest token that is a proper prefix of each token; -1: none.
        self.shorter = [-1] * size
        for b, i in ranks.items():
            for k in range(len(b) - 1, 0, -1):
                if (p := ranks.get(b[:k])) is not None:
                    self.shorter[i] = p
                    break
        self.pair: dict[tuple[int, int], int] = {}
        self.left = list(range(size))
        self.right = list(range(size))
        self.known: dict[tuple[int, int], bool] = {}
        for i in sorted(ranks.values()):
            self._learn_split(i)
        self.pieces: dict[str, tuple[bytes, str]] = {}
        self.units: dict[str, tuple[bytes, str]] = {}

    def _learn_split(self, i: int) -> None:
        """Finds the two tokens whose merge makes token i; single bytes have none."""
        b, a = self.token[i], self.shorter[i]
        while a != -1:
            c = self.ranks.get(b[self.length[a] :])
            if c is not None and a < i and c < i and self._meets(a, c):
                self.pair[a, c] = i
                self.left[i], self.right[i] = a, c
                return
            a = self.shorter[a]

    def _meets(self, a: int, b: int) -> bool:
        """Undoes the merges on both sides of the border, latest first, and looks for one across it that came earlier."""
        pair, left, right = self.pair, self.left, self.right
        limit = 1 << 62
        while True:
            across = pair.get((a, b))
            if across is not None and across < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > self.most:
                self.known.clear()
            got = self.known[a, b] = self._meets(a, b)
        return got

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter, compatible = len(piece), self.length, self.shorter, self.compatible
        longest = [-1] * n
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            at = end + 1 - length[i]
            if longest[at] == -1 or length[i] > length[longest[at]]:
                longest[at] = i
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token != -1:
                end = at + length[token]
                if open_[end] and (last == -1 or compatible(last, token)):
                    break
                token = shorter[token]
            if token != -1:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if last == -1:
                    raise ValueError("the ranks lack a byte of the text")
                open_[at] = 0
                out.pop()
                at -= length[last]
                token = last
        return out

    def _piece(self, piece: str) -> tuple[bytes, str]:
        got = self.pieces.get(piece)
        if got is None:
            ids = self.merge(piece.encode())
            got = np.array(ids, dtype="<u4").tobytes(), " ".join(map(str, ids))
            if len(piece) <= 64:
                if len(self.pieces) > self.most:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def _long(self, text: str) -> tuple[list[bytes], list[str]]:
        got = [self._piece(p) for p in self.split.findall(text)]
        return [a for a, _ in got], [b for _, b in got]

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Little-endian uint32 ids, and the same in decimal, one space between."""
        if not text:
            return b"", ""
        if not self.by_space or self.gaps.search(text):
            raw, dec = self._long(text)
            return b"".join(raw), " ".join(dec)
        # Without adjacent white space no match of the pattern reaches over a space, so a
        # text's pieces are those of its space-led words, which are kept with their ids.
        words = text.split(" ")
        keys = [words[0], *[" " + w for w in words[1:]]]
        if not keys[0]:
            del keys[0]
        known = self.units
        got = list(map(known.get, keys))
        if None in got:
            for k, g in enumerate(got):
                if g is None:
                    u = keys[k]
                    g = known.get(u)
                    if g is None:
                        raw, dec = self._long(u)
                        g = b"".join(raw), " ".join(dec)
                        if len(u) <= 128:
                            if len(known) > self.most:
                                known.clear()
                            known[u] = g
                    got[k] = g
        return b"".join([g[0] for g in got]), " ".join([g[1] for g in got])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


def codec(ranks_file: str, pattern: str) -> BytePairCodec:
    """One codec for each Python worker, rank file and pattern."""
    key = ranks_file, pattern
    if key not in _CODECS:
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODECS[key] = BytePairCodec(ranks, pattern)
    return _CODECS[key]


def encode_decode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_file, pattern)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                n, ids_hash, back_hash, kept = [], [], [], []
                for text in part.column(1).to_pylist():
                    raw, decimal = c.encode(text)
                    ids = np.frombuffer(raw, dtype="<u4")
                    n.append(len(ids))
                    ids_hash.append(hashlib.sha256(decimal.encode()).hexdigest())
                    back_hash.append(hashlib.sha256(c.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(raw)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(back_hash)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)
