"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A mask of ones and zeros is laid at each token of a text; the tokens under its
ones make a hash, those under its zeros may be anything. Equal hashes of a
training text and a benchmark item give an offset between them. Around it the
item's tokens are compared with the text's one by one, and a stretch of
``window`` tokens of which enough are equal is an overlap, so that single
replaced words do not hide a leak.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, keep, only

# Weight five, spans of eight to ten tokens.
MASKS = ("11010011", "1100010011", "101001011")
WINDOW = 15
EQUAL = 0.8
BROADCAST_SEEDS = 2_000_000
SEED_BITS = 25
SEPARATORS = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Letters and digits in lower case, cut at everything else; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda t: t != "")


def seeds(df: DataFrame, key: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """(key, at, seed) for each place (from 0) of ``text`` and each mask that fits.

    Only places and hashes leave the text: no row carries its tokens.
    """
    span = min(len(m) for m in masks)

    def places(h: Column) -> Column:
        def masked(i: Column) -> Column:
            made = [F.when(i + len(m) <= F.size(h), F.xxhash64(*[F.get(h, i + j) for j, bit in enumerate(m) if bit == "1"], F.lit(k))) for k, m in enumerate(masks)]
            return F.struct(i.alias("at"), F.array(*made).alias("seeds"))

        made = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - span, F.lit(0))), masked)
        return F.when(F.size(h) >= span, made)

    hashes = F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t))
    listed = df.select(key, F.inline(F.get(F.transform(F.array(hashes), places), F.lit(0))))
    return listed.select(key, "at", F.explode("seeds").alias("seed")).where(F.col("seed").isNotNull())


def best_stretch(equal: Column, window: int) -> Column:
    """Most equal tokens in a stretch of ``window`` (or of all, if fewer)."""
    places = F.sequence(F.lit(1), F.greatest(F.size(equal) - window + 1, F.lit(1)))
    return F.array_max(F.transform(places, lambda i: F.aggregate(F.slice(equal, i, window), F.lit(0), lambda s, x: s + x)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, window: int = WINDOW, equal: float = EQUAL) -> DataFrame:
    """(doc_id, item_id, start, compared, matched, overlap) of each leak.

    ``start`` is the token of the text at which the item begins (below 0 if
    the text holds only a later part), ``compared`` the item's tokens that lie
    inside the text, ``matched`` how many of them are equal, ``overlap`` their
    share; one row, the best, for each document and item. Items and texts of
    fewer than ``window`` tokens need that share of the shorter one's tokens,
    and ones that are shorter than every mask have no seed and no leak. Null
    and empty texts have none, an empty table gives no rows, equal documents
    are reported each, a null doc_id is not, and extra columns are left out.

    The benchmark's seeds are broadcast only up to ``BROADCAST_SEEDS`` rows,
    which are counted first; beyond it both sides are shuffled by seed, the
    documents' only where a bitmap of fixed size may hold them.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    items = benchmark.select("item_id", "text")
    side = seeds(items, "item_id", masks).select("item_id", F.col("at").alias("item_at"), "seed")
    theirs = seeds(docs, "doc_id", masks)
    if side.count() <= BROADCAST_SEEDS:
        side = F.broadcast(side)
    else:
        at = F.shiftrightunsigned("seed", 64 - SEED_BITS)
        marked = theirs.withColumn("word", F.shiftright(at, 6)).join(F.broadcast(bitmap(side, "seed", SEED_BITS)), "word")
        theirs = marked.where(F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))) != 0).drop("word", "bits")
    hits = theirs.join(side, "seed").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("start"))
    hits = keep(hits.distinct(), "hits")
    texts = only(docs, hits.select("doc_id")).select("doc_id", tokens(F.col("text")).alias("tokens"))
    ours = items.select("item_id", tokens(F.col("text")).alias("item_tokens"))
    begin = F.col("start")
    skipped = F.greatest(-begin, F.lit(0))
    length = F.greatest(F.least(F.size("item_tokens") - skipped, F.size("tokens") - F.greatest(begin, F.lit(0))), F.lit(0))
    aligned = hits.join(ours, "item_id").join(texts, "doc_id").select(
        "doc_id",
        "item_id",
        "start",
        F.slice("tokens", F.greatest(begin, F.lit(0)) + 1, length).alias("theirs"),
        F.slice("item_tokens", skipped + 1, length).alias("ours"),
    )
    compared = aligned.withColumn("equal", F.zip_with("theirs", "ours", lambda a, b: F.when(a == b, 1).otherwise(0)))
    scored = compared.select(
        "doc_id",
        "item_id",
        "start",
        F.size("equal").alias("compared"),
        F.aggregate("equal", F.lit(0), lambda s, x: s + x).alias("matched"),
        best_stretch(F.col("equal"), window).alias("best"),
    )
    # a text or item below the window still has to show as many equal tokens as the shortest mask spans
    needed = F.greatest(F.ceil(F.least(F.col("compared"), F.lit(window)) * equal), F.lit(min(len(m) for m in masks)))
    leaks = scored.where(F.col("best") >= needed).withColumn("overlap", F.col("matched") / F.col("compared"))
    best = F.max_by(F.struct("start", "compared", "matched", "overlap"), F.struct("matched", "overlap", -F.col("start")))
    return leaks.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
