"""Document fingerprints: bottom-k sketches of shingle hashes, in built-in functions only.

A sketch is the sorted array of the ``k`` smallest distinct hashes of a document's word
shingles (with fewer words the whole sequence is one). Sketches of parts merge into the
sketch of the whole (``merged``, and ``merge_all`` as an aggregation); two sketches give
resemblance and containment, one gives the number of distinct shingles. A sketch of fewer
than ``k`` hashes holds them all, and every figure from such sketches is exact but for
collisions of 64-bit hashes.

Words are split at the same characters everywhere in this package (space, \\t-\\r) and are
lower-cased A-Z. Null text is the empty text; it has an empty sketch. Two empty sketches are
alike (1), an empty one and any other are not (0). Rows with one id are documents next to each
other; without rows the result is empty. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import NO_ID, IdRanges

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "\t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The words of a text, lower-cased A-Z; empty strings between adjacent separators are gone."""
    flat = F.translate(text, _UPPER + _SPACES, _LOWER + " " * len(_SPACES))
    return F.array_remove(F.split(flat, " "), "")


def _windows(h: Column, width: int) -> Column:
    n = F.size(h)
    each = F.transform(
        F.sequence(F.lit(1), F.greatest(n - F.lit(width - 1), F.lit(1))),
        lambda i: F.xxhash64(*[F.get(h, i + F.lit(j - 1)) for j in range(width)]),
    )
    return F.when(n == 0, F.array().cast("array<long>")).otherwise(each)


def bottom(hashes: Column, k: int) -> Column:
    """The k smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text_col: str, out: str, width: int = 5, k: int = 128) -> DataFrame:
    """``df`` with the sketch of a text column. The words' hashes are a step of their own: inside the windows they would be made anew for each."""
    rest = [c for c in df.columns if c != out]
    step = df.select(*rest, F.transform(words(F.coalesce(text_col, F.lit(""))), lambda x: F.xxhash64(x)).alias("_h"))
    return step.select(*rest, bottom(_windows(F.col("_h"), width), k).alias(out))


def merged(a: Column, b: Column, k: int = 128) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return bottom(F.concat(a, b), k)


def merge_all(df: DataFrame, keys: list[str], sketch_col: str = "sketch", k: int = 128) -> DataFrame:
    """One merged sketch for each key. Hashes are counted once in each task and only the k smallest of a key are gathered."""
    one = df.select(*keys, F.explode(sketch_col).alias("_h")).distinct()
    first = one.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))).where(F.col("_r") <= k)
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """The estimated Jaccard similarity: of the k smallest hashes of the union, the share that both hold."""
    union = F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_shingles(s: Column, k: int = 128) -> Column:
    """The estimated number of distinct shingles: (k - 1) over the k-th smallest hash as a share of the range."""
    share = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """The estimated share of a's shingles that b has."""
    j = resemblance(a, b, k)
    size = F.greatest(distinct_shingles(a, k), F.lit(1.0))
    return F.least(F.lit(1.0), j * distinct_shingles(merged(a, b, k), k) / size)


def to_text(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, width: int, k: int, mb: float = 16) -> DataFrame:
    """doc_id, text, a (its sketch), and the text and sketch of the next doc_id (after the last the first).

    Documents go once to the range of their doc_id, and a range's first document also to the
    range before; there the next document is the next row.
    """
    ranges = IdRanges(docs, "doc_id", "text", mb)
    part, n = ranges.column("doc_id"), ranges.count
    heads = docs.select("doc_id", part.alias("part")).groupBy("part").agg(F.min("doc_id").alias("head"))
    # one row for each range, not for each document
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.coalesce(F.lag("part").over(order), F.last("part").over(whole)).alias("before"))
    heads = F.broadcast(heads) if n <= 50_000 else heads
    own = docs.select(part.alias("part"), F.lit(True).alias("own"), "doc_id", "text")
    extra = docs.join(heads, docs["doc_id"] == heads["head"]).select(F.col("before").alias("part"), F.lit(False).alias("own"), "doc_id", "text")
    ranged = with_sketch(own.unionAll(extra).repartitionById(n, F.col("part")), "text", "a", width, k)
    here = Window.partitionBy("part").orderBy(F.desc("own"), "doc_id", "text")
    return ranged.withColumn("next", F.lead(F.struct("text", "a")).over(here)).where("own").select("doc_id", "text", "a", "next")


def edited(text: Column, next_text: Column) -> Column:
    """``text`` with its last floor(n / 2) code points replaced by as many of the next text's first."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.when(half == 0, "").otherwise(F.substr(next_text, F.lit(1), half)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, k: int = 128) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct.

    Of rows with the same doc_id the order is that of their texts. A null doc_id sorts first
    and is null in the result.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    both = with_next(docs, width, k).select("doc_id", "text", "a", F.col("next.a").alias("b"), edited(F.col("text"), F.col("next.text")).alias("edited"))
    s = with_sketch(both, "edited", "e", width, k).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "a", "e", "b")
    return s.select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        to_text(F.col("a")).alias("fingerprint"),
        to_text(F.col("e")).alias("edited_fingerprint"),
        resemblance(F.col("a"), F.col("e"), k).alias("near_edited"),
        resemblance(F.col("a"), F.col("b"), k).alias("near_next"),
        distinct_shingles(F.col("a"), k).alias("n_distinct"),
    )
