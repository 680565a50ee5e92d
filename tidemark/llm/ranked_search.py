"""Ranked lexical search by sort-based accumulation.

Texts become lists of (term, occurrences), kept once. A task turns a slice of
documents into arrays of (item, document, impact), sorts packed keys by radix,
sums runs of equal keys and keeps each item's best in a heap; the heaps of all
tasks meet range-partitioned by item.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import against, column, lanes_for, numbers, ragged
from .common import bitmap, keep, text_chunks, words

BITS = 23
#: Terms of items that a task holds, on average, and triples that it sorts at once.
BLOCK_TERMS = 200_000
TRIPLES = 1_000_000
_BREAKS = np.zeros(256, bool)
_BREAKS[[b for b in range(128) if not chr(b).isalnum()]] = True
_INT64 = 2**63 - 1


def _lists(first: int, rows: int, hashes: np.ndarray, row: np.ndarray):
    """(offsets, terms, occurrences) of each text's distinct terms."""
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    offsets = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(r[at], minlength=rows), out=offsets[1:])
    return offsets, h[at].view(np.int64), np.diff(np.append(at, len(h)))


def term_lists(texts: DataFrame, id_col: str, marked: np.ndarray | None = None, bits: int = BITS) -> DataFrame:
    """(id, n, terms, tfs): a text's terms as 64-bit hashes, with their occurrences.

    ``n`` counts all terms of the whole text; with ``marked``, a bitmap of
    fixed size, only terms that it may hold are listed.
    """

    def listed(batches):
        for batch in batches:
            ids = column(batch, "id")
            for first, offsets, raw in text_chunks(batch):
                rows = len(offsets) - 1
                h, row, _, _ = words(offsets, raw, breaks=_BREAKS)
                n = np.bincount(row, minlength=rows)
                if marked is not None:
                    at = h >> np.uint64(64 - bits)
                    known = (marked[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
                    h, row = h[known], row[known]
                ends, terms, tfs = _lists(first, rows, h, row)
                ends = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, rows), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(terms)), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))],
                    ["id", "n", "terms", "tfs"],
                )

    return texts.select(F.col(id_col).cast("long").alias("id"), "text").mapInArrow(listed, "id long, n long, terms array<long>, tfs array<long>")


def document_counts(lists: DataFrame) -> DataFrame:
    """(term, df): in how many texts each listed term is; summed in tasks first."""

    def counted(batches):
        for batch in batches:
            _, terms = ragged(batch, "terms")
            found, n = np.unique(terms.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["term", "df"])

    return lists.select("terms").mapInArrow(counted, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of keys of at most 48 bits, by digits of 16 bits from the lowest.

    numpy's stable sort of 16-bit numbers is a counting sort; a digit that is
    in order already, as documents within a slice are, costs one comparison.
    """
    order = np.arange(len(keys))
    for shift in (0, 16, 32):
        digit = ((keys[order] >> shift) & 0xFFFF).astype(np.uint16)
        if (digit[1:] < digit[:-1]).any():
            order = order[np.argsort(digit, kind="stable")]
    return order


def accumulate(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
    """(item, document, sum of impacts), by sorted packed keys."""
    if not len(items):
        return items, docs, impacts
    keys = (items.astype(np.int64) << 24) | docs
    order = radix_order(keys)
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at] >> 24, keys[at] & 0xFFFFFF, np.add.reduceat(impacts[order], at)


class _Ranking:
    """The best k documents of each item of a block, in heaps."""

    def __init__(self, items: pa.Table, documents: int, tokens: int, k: int):
        self.k, self.documents, self.tokens = k, documents, tokens
        self.ids = numbers(items, "id")
        offsets, terms = ragged(items, "terms")
        _, weights = ragged(items, "weights")
        item = np.repeat(np.arange(len(self.ids)), np.diff(offsets))
        order = np.argsort(terms.astype(np.int64), kind="stable")
        self.terms, first = np.unique(terms.astype(np.int64)[order], return_index=True)
        self.starts = np.append(first, len(order))
        self.items = item[order]
        self.weights = weights.astype(np.int64)[order][first] if len(order) else np.zeros(0, np.int64)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in self.ids]
        self.floor = np.zeros(len(self.ids), np.int64)

    def _lengths(self, n: np.ndarray) -> np.ndarray:
        """20 * m of documents of n terms."""
        if len(n) and int(n.max()) * 50 * self.documents > _INT64:
            return np.array([20 * (50 + 50 * int(x) * self.documents // self.tokens) for x in n], np.int64)
        return 20 * (50 + 50 * self.documents * n // self.tokens)

    def feed(self, batch) -> None:
        offsets, terms = ragged(batch, "terms")
        _, tfs = ragged(batch, "tfs")
        if not len(terms) or not len(self.terms):
            return
        ids, m = column(batch, "id").to_numpy(zero_copy_only=False), self._lengths(numbers(batch, "n"))
        terms, tfs = terms.astype(np.int64), tfs.astype(np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == terms)
        at, doc = at[hit], np.searchsorted(offsets, hit, "right") - 1
        impact = self.weights[at] * ((1_000_000_000 * tfs[hit]) // (1000 * tfs[hit] + m[doc]))
        copies = self.starts[at + 1] - self.starts[at]
        total = np.cumsum(copies)
        a = 0
        while a < len(hit):
            # whole documents of some TRIPLES triples together, or one longer document
            past = int(np.searchsorted(total, (total[a - 1] if a else 0) + TRIPLES, "right"))
            b = len(hit) if past >= len(hit) else int(np.searchsorted(doc, doc[past], "left"))
            if b <= a:
                b = int(np.searchsorted(doc, doc[a], "right"))
            self._slice(at[a:b], doc[a:b], impact[a:b], copies[a:b], ids)
            a = b

    def _slice(self, at, doc, impact, copies, ids) -> None:
        total = np.cumsum(copies)
        within = np.arange(total[-1]) - np.repeat(total - copies, copies)
        items = self.items[np.repeat(self.starts[at], copies) + within]
        item, local, score = accumulate(items, np.repeat(doc - doc[0], copies), np.repeat(impact, copies))
        may = (score > 0) & (score >= self.floor[item])
        item, names, score = item[may], ids[local[may] + doc[0]], score[may]
        named = names == names  # a document without an id is counted, but can't be returned
        item, names, score = item[named], names[named].astype(np.int64), score[named]
        bounds = np.searchsorted(item, np.arange(len(self.ids) + 1))
        for i in np.flatnonzero(np.diff(bounds)):
            s, n = score[bounds[i] : bounds[i + 1]], names[bounds[i] : bounds[i + 1]]
            if len(s) > self.k:
                enough = s >= np.partition(s, len(s) - self.k)[len(s) - self.k]
                s, n = s[enough], n[enough]
            heap = self.heaps[i]
            for x in zip(s.tolist(), (-n).tolist(), strict=True):
                if len(heap) < self.k:
                    heapq.heappush(heap, x)
                elif x > heap[0]:
                    heapq.heapreplace(heap, x)
            if len(heap) == self.k:
                self.floor[i] = heap[0][0]

    def finish(self) -> pa.RecordBatch:
        n = [len(h) for h in self.heaps]
        both = np.array([x for h in self.heaps for x in h], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, n)), pa.array(-both[:, 1]), pa.array(both[:, 0].copy())], ["item_id", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents.

    Terms are runs of ASCII letters and digits and of all characters beyond
    ASCII, A-Z as a-z, in whole texts; they are compared as 64-bit hashes. The
    score of a document is the sum, over the item's distinct terms, of weight
    times impact as integers: weights fall with the share of documents that
    hold the term, impacts rise with its occurrences and fall with the
    document's length. Equal scores go to the smaller ``doc_id``.

    Every row of ``docs`` counts as a document, equal or not. Null and empty
    texts have no terms and are never found; a document without an id counts
    in the statistics but isn't returned. Items without an id, or whose terms
    no document holds, give no row; rows that repeat an item's id add their
    terms to it. Empty tables give no rows. Other columns are ignored.
    """
    asked = term_lists(items, item_id).where("id is not null").select("id", F.explode("terms").alias("term")).distinct()
    pairs = keep(asked, "item-terms")
    words_ = bitmap(pairs, "term", BITS).toPandas()
    marked = np.zeros(1 << (BITS - 6), np.uint64)
    marked[words_["word"].to_numpy(np.int64)] = words_["bits"].to_numpy(np.int64).view(np.uint64)
    lists = keep(term_lists(docs, doc_id, marked), "term-lists")
    documents, tokens, rows = lists.agg(F.count_if(F.col("n") > 0), F.sum("n"), F.count("*")).first()
    if not documents:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = pairs.join(document_counts(lists).select("term", weight.alias("weight")), "term")
    wanted = keep(weighted.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("x")).select("id", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights")), "items")
    n_items, n_terms = wanted.agg(F.count("*"), F.sum(F.size("terms"))).first()
    n_blocks = max(-(-n_items // 10_000), -(-(n_terms or 0) // block_terms))
    found = against(wanted, lists.where("n > 0").select("id", "n", "terms", "tfs"), lambda t: _Ranking(t, documents, tokens, k), "item_id long, doc_id long, score long", "id", n_blocks, lanes_for(rows))
    ranged = keep(found, "found").repartitionByRange("item_id")  # kept, since a range is sampled first
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return ranged.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
