"""Helpers that the operators of this package share.

The operators that need Python take whole Arrow batches (``mapInArrow``) and work on
the raw UTF-8 buffers with numpy, so no Python string is made for a row unless a
library asks for one.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, and the odd base of the rolling hash.
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BYTE2 = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_lower = np.arange(256)
_lower[65:91] += 32
#: The same with A-Z read as a-z.
BYTE_LOWER = BYTE[_lower]
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 2**64)
#: The separators of words: space and \t\n\v\f\r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, mod 2**64."""
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 16)
        for k, base in (("p", BASE), ("i", BASE_INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE) -> np.ndarray:
    """P with P[i] = sum of values[data[j]] * BASE**j for j < i."""
    p = np.empty(len(data) + 1, dtype=np.uint64)
    p[0] = 0
    np.cumsum(values[data] * powers(len(data))[0], dtype=np.uint64, out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes of each span, wherever it lies."""
    return (p[end] - p[start]) * powers(len(p))[1][start]


def release() -> None:
    """Gives memory that numpy, Arrow and the C library hold but don't use back to the system: a worker serves many stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    if not pa.types.is_string(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if len(arr) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    o = np.frombuffer(off, dtype=np.int32, count=len(arr) + 1, offset=arr.offset * 4).astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(off: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes; a longer row is alone in its range."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and n + 1 offsets of the rows' words."""
    if not len(data):
        e = np.empty(0, np.int64)
        return e, e, np.zeros(len(off), np.int64)
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[off] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | cut[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, off).astype(np.int64)


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z as a-z if ``lower``) and the rows' word offsets."""
    s, e, w = word_spans(data, off)
    return span_hashes(data, s, e, lower), w


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
    """The hash that ``word_hashes`` gives each word, from where the words are."""
    p = prefix_hash(data, BYTE_LOWER if lower else BYTE)
    return mix(span_hash(p, s, e) + (e - s).astype(np.uint64))


def shingle_hashes(wh: np.ndarray, w: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row its sorted distinct k-word shingles; a shorter row's words are one."""
    n = len(wh)
    h = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        h = mix(h * U(0x9FB21C651E98DF25) + wh[j : n - k + 1 + j]) if len(h) else h
    out = []
    for a, b in zip(w[:-1].tolist(), w[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            x = np.full(1, b - a, dtype=np.uint64)
            for v in wh[a:b]:
                x = mix(x * U(0xD6E8FEB86659FD93) + v)
            out.append(x)
        else:
            out.append(np.empty(0, np.uint64))
    return out


_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs in one process."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="driftmap-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        at = f"file://{_own[0]}"
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``clean`` removes what is written there."""
    _written.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_written: list[str] = []


def clean(spark: SparkSession) -> None:
    """Removes the tables and files that operators wrote so far; call it when their results have been used."""
    while _written:
        p = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Stands for a missing doc_id inside an operator; it sorts first, as null does in Spark.
NO_ID = -(2**63)


def ids_of(arr: pa.Array) -> np.ndarray:
    return pc.fill_null(arr.cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)


def ids_back(ids) -> pa.Array:
    a = np.asarray(ids, dtype=np.int64)
    return pa.array(a, type=pa.int64(), mask=a == NO_ID)


class IdRanges:
    """Consecutive ranges of ids, each with about ``mb`` MB of text: numbered by ``of`` (numpy) and ``column`` (Spark) alike.

    One pass counts the bytes and sketches the ids' quantiles. At most 1,001 of them reach the
    driver and the tasks; between two of them ids are cut evenly, by arithmetic, so what is
    sent does not grow with the number of ranges.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, mb: float):
        row = docs.agg(
            F.sum(F.octet_length(text_col)).alias("b"),
            F.percentile_approx(F.col(id_col), [i / 1000 for i in range(1001)], 4000).alias("q"),
        ).first()
        n = max(1, -(-int(row["b"] or 0) // int(mb * 1e6))) if row["q"] else 1
        knots = min(n, 1000)
        self.at = np.array([row["q"][round(1000 * i / knots)] for i in range(knots + 1)] if row["q"] else [0, 1], dtype=np.int64)
        self.each = -(-n // knots)
        self.count = knots * self.each

    def of(self, ids: np.ndarray) -> np.ndarray:
        seg = np.searchsorted(self.at[1:-1], ids, "right")
        lo, width = self.at[seg].astype(np.float64), np.maximum(np.diff(self.at), 1)[seg]
        inside = np.clip(np.floor((ids.astype(np.float64) - lo) * self.each / width), 0, self.each - 1)
        return (seg * self.each + inside).astype(np.int32)

    def column(self, id_col: str):
        at, each, x = self.at.tolist(), self.each, F.col(id_col).cast("double")

        def tree(lo: int, hi: int):
            if lo == hi:
                inside = F.floor((x - F.lit(float(at[lo]))) * F.lit(each) / F.lit(float(max(at[lo + 1] - at[lo], 1))))
                return F.lit(lo * each) + F.greatest(F.lit(0), F.least(F.lit(each - 1), inside))
            mid = (lo + hi + 1) // 2
            return F.when(F.col(id_col) < F.lit(at[mid]), tree(lo, mid - 1)).otherwise(tree(mid, hi))

        return tree(0, len(at) - 2).cast("int")
