"""Document fingerprints by winnowing, in SQL functions only.

A text becomes tokens, each run of ``k`` tokens a hash, and of each window of
``w`` hashes the smallest is chosen, the rightmost of equal ones. Every match
of at least ``w + k - 1`` tokens between two texts then shares a chosen hash,
and no match shorter than ``k`` tokens does.

The k-gram hash is the cyclic polynomial of a rolling hash: the exclusive or
of the token hashes, each rotated by its distance from the end of the gram.
It is evaluated at each place from its ``k`` terms, which gives the value the
rolling recurrence gives, without carrying state along the array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


K = 5
W = 4
TOKEN = r"[^\s]{1,24}"


def _rotate(x: Column, n: int) -> Column:
    return x if not n else F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def gram_hashes(text: Column, k: int = K) -> Column:
    """Array of the k-gram hashes of a text, in order.

    Tokens are runs without white space, in lower case; a run of over 24
    characters counts as several tokens. A text of fewer than ``k`` tokens has
    one gram, its whole sequence; an empty or null text has none.
    """
    tokens = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0), lambda t: F.xxhash64(t))

    def grams(t: Column) -> Column:
        def gram(i: Column) -> Column:
            terms = [_rotate(F.get(t, i + j), k - 1 - j) for j in range(k)]
            return F.xxhash64(reduce(lambda a, b: a.bitwiseXOR(b), terms))

        n = F.size(t)
        whole = F.array(F.xxhash64(t))
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n < k, whole).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), gram))

    return F.get(F.transform(F.array(tokens), grams), F.lit(0))


def _chosen(h: Column, w: int) -> Column:
    """Positions chosen in an array of hashes, ascending.

    A position is chosen when some window around it holds no smaller hash and
    no equal one to its right.
    """
    n = F.size(h)

    def wins(p: Column) -> Column:
        x = F.get(h, p)
        left = [F.get(h, p - j) >= x for j in range(1, w)]
        right = [F.get(h, p + j) > x for j in range(1, w)]
        windows = [reduce(lambda a, b: a & b, left[:i] + right[: w - 1 - i], F.lit(True)) for i in range(w)]
        return F.when((p < 0) | (p >= n), False).otherwise(reduce(lambda a, b: a | b, windows))

    few = F.array((n - F.array_position(F.reverse(h), F.array_min(h))).cast("int"))
    return F.when(n == 0, F.array().cast("array<int>")).when(n < w, few).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), wins))


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """struct(positions array<int>, hashes array<bigint>) of a text.

    Positions count k-grams from 0. Fewer hashes than a window form one
    window. A null or empty text has empty arrays.
    """

    def picked(h: Column) -> Column:
        at = lambda p: F.struct(p.alias("positions"), F.transform(p, lambda i: F.get(h, i)).alias("hashes"))
        return F.get(F.transform(F.array(_chosen(h, w)), at), F.lit(0))

    return F.get(F.transform(F.array(gram_hashes(text, k)), picked), F.lit(0))


def fingerprint_documents(docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Add ``winnowed`` to a table with a text column; nothing is shuffled."""
    return docs.withColumn("winnowed", winnow(F.col("text"), k, w))


def digest(winnowed: Column) -> Column:
    """A fingerprint as 32 hex digits: of hashes and positions together."""
    h, p = winnowed["hashes"], winnowed["positions"]
    word = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(word(F.xxhash64(h, p)), word(F.xxhash64(p, h, F.lit(1))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of hashes, 1 for two empty ones."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(both / either)


def ranges(docs: DataFrame, order: str = "doc_id", rows: int = 1024, most: int = 16384) -> DataFrame:
    """Cut a table into ranges of descending ``order`` for next_row(), a window.

    ``lead`` over it then gives the row that follows, and after the last row
    the first. Ranges end at values of the order column itself, so the row
    that follows a range's last one is known without looking: it is copied
    into that range with ``_halo`` 1; drop those copies after ``lead``. One
    shuffle serves, and no task needs more than its ranges. A null order value
    comes last; of equal values the smaller text comes first.
    """
    ids = docs.where(F.col(order).isNotNull())
    n, top = ids.agg(F.count("*"), F.max(order)).first()
    buckets = int(min(max(n // rows, 1), most))
    bounds = []
    if buckets > 1:
        bounds = ids.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0]
    bounds = sorted({int(b) for b in bounds if b != top})
    block = 128
    array = lambda v: F.lit(v).cast("array<bigint>") if v else F.array().cast("array<bigint>")
    below = lambda v, x: F.size(F.filter(v, lambda b: b < x))
    x = F.coalesce(F.col(order).cast("bigint"), F.lit(-(2**63)))
    skip = below(array(bounds[block - 1 :: block]), x) * block
    cut = docs.withColumn("_bucket", skip + below(F.slice(array(bounds), skip + 1, block), x))
    last = F.when(F.col(order) == F.lit(top), 0).when(F.get(array(bounds), F.col("_bucket")) == F.col(order), F.col("_bucket") + 1)
    halo = cut.withColumn("_bucket", last).where(F.col("_bucket").isNotNull())
    return cut.withColumn("_halo", F.lit(0)).unionByName(halo.withColumn("_halo", F.lit(1)))


def next_row():
    """The window over ranges(): by descending doc_id, copies last."""
    return Window.partitionBy("_bucket").orderBy("_halo", F.col("doc_id").desc_nulls_last(), "text")
