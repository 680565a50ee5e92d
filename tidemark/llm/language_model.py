"""Language-model scoring: interpolated modified Kneser-Ney of order two or three.

Spark counts the words and then the pairs of neighbouring words of the
training texts. Both become sorted arrays of hashes or ids with their counts,
written as plain files to the shared folder, one file per part of the key
space; workers map the files into memory and search them for every text, so a
model may be larger than a worker's memory. A word is known by a 64-bit hash
and its place in the sorted array is its id; a pair is two ids.

Pairs are dealt out by their first word, and those of a frequent first word
by the second one also, so that no word's pairs meet in one task. A triple is
dealt by its last two words. So the distinct words left of a pair, its
continuation count, are all in one part. So are the triples of a context, its
first two words, unless the middle word is frequent; those contexts are summed
in a shuffle.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, discard, keep, mix, shared_dir, text_chunks, tidy, words

END = np.uint64(0x5BF03635F0B7A54D)
FOLDS, HELD_OUT = 10, 0
PART_ROWS = 1_500_000
HOT = 200_000
FLUSH = 1_500_000
MOST_TASKS = 20_000
SLICE = 1_750_000  # of text: larger than elsewhere, since each one visits all parts of the model
MOST_MAPPED = 500
_MAPPED: dict[str, np.ndarray] = {}


def sentences(offsets: np.ndarray, raw: np.ndarray):
    """(token hash, text, is first) with one end token after each text's words."""
    h, row, _, _ = words(offsets, raw)
    n = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n + 1))
    out = np.empty(len(h) + n, np.uint64)
    owner = np.empty(len(h) + n, np.int64)
    at = np.arange(len(h)) + row
    out[at], owner[at] = h, row
    ends = first[1:] + np.arange(n)
    out[ends], owner[ends] = END, np.arange(n)
    opens = np.zeros(len(out), bool)
    opens[first[:-1] + np.arange(n)] = True
    return out, owner, opens


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sum of their counts."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[begin], np.add.reduceat(n[order], begin)


def _write(path: str, array: np.ndarray) -> None:
    """Write a file of the model under its name only when it is whole.

    A repeated or speculative attempt writes the same bytes, so whichever
    comes first may stay.
    """
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    attempt = f"{where}.{uuid.uuid4().hex}"
    with system.open_output_stream(attempt) as out:
        out.write(np.ascontiguousarray(array).tobytes())
    try:
        system.move(attempt, where)
    except OSError:
        if system.get_file_info(where).type != fs.FileType.File:
            raise
        system.delete_file(attempt)


def mapped(path: str, kind: str) -> np.ndarray:
    """A file of the model, mapped into memory.

    A store that cannot be mapped is copied to an unnamed local file first.
    Each part has its files, empty ones too, so one that is not there is an error.
    """
    if path not in _MAPPED:
        from pyarrow import fs

        if len(_MAPPED) >= MOST_MAPPED:  # each one holds an open file
            _MAPPED.clear()
            _VIEWS.clear()

        system, where = fs.FileSystem.from_uri(path)
        info = system.get_file_info(where)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(f"the model has lost its file {path}")
        if not info.size:
            return np.zeros(0, kind)
        if system.type_name == "local":
            _MAPPED[path] = np.memmap(where, kind, "r").view(np.ndarray)  # each slice of a memmap object costs more than a search
        else:
            import shutil
            import tempfile

            with tempfile.TemporaryFile() as copy, system.open_input_stream(where) as source:
                shutil.copyfileobj(source, copy, 1 << 24)
                copy.flush()
                _MAPPED[path] = np.memmap(copy, kind, "r").view(np.ndarray)
    return _MAPPED[path]


@dataclass
class Model:
    """Where the arrays are, and the few numbers that all scores share."""

    path: str
    bits: int = 1
    starts: list[int] = field(default_factory=list)  # first id of each part of the words
    n_words: int = 0
    n_tokens: int = 0
    n_texts: int = 0
    parts: int = 1
    pairs: int = 0
    discounts: tuple = (0.5, 1.0, 1.5)
    low_discounts: tuple = (0.5, 1.0, 1.5)
    low_rest: float = 1.0
    order: int = 2
    hot: int = HOT
    triples: int = 0
    high_discounts: tuple = (0.5, 1.0, 1.5)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Id of each hash of a sorted array, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int64)
        part = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        cuts = np.searchsorted(part, np.arange(len(self.starts) + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            known = mapped(f"{self.path}/word-{p}", "<u8")
            q = h[cuts[p] : cuts[p + 1]]
            if len(known):
                at = np.minimum(np.searchsorted(known, q), len(known) - 1)
                out[cuts[p] : cuts[p + 1]] = np.where(known[at] == q, at + self.starts[p], -1)
        return out

    def of_ids(self, name: str, kind: str, ids: np.ndarray) -> np.ndarray:
        """Values of a column of the words for ascending ids (0 for -1)."""
        out = np.zeros(len(ids), kind)
        cuts = np.searchsorted(ids, [*self.starts, self.n_words])
        for p in np.flatnonzero(np.diff(cuts)):
            out[cuts[p] : cuts[p + 1]] = mapped(f"{self.path}/{name}-{p}", kind)[ids[cuts[p] : cuts[p + 1]] - self.starts[p]]
        return out

    def encode(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the distinct tokens, their places, counts of the distinct)."""
        distinct, back = np.unique(tokens, return_inverse=True)
        ids = self.ids(distinct)
        counts = np.zeros(len(ids), np.int64)
        known = ids >= 0
        counts[known] = self.of_ids("count", "<i8", ids[known])
        return ids, back, counts

    def part_of(self, first: np.ndarray, second: np.ndarray, n_first: np.ndarray) -> np.ndarray:
        """Part of a pair; a frequent first word is dealt out by the second."""
        salt = mix(second.astype(np.uint64)) % (1 + n_first // self.hot).astype(np.uint64)
        return (mix(first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt) % np.uint64(self.parts)).astype(np.int64)


def _discounts(n: list[float]) -> tuple:
    """Modified Kneser-Ney discounts of counts one, two, and three or more.

    Where one of the counts of counts is zero, as in tiny corpora, they are
    a half, one and one and a half.
    """
    if min(n) <= 0:
        return (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return tuple(min(max(d, 0.01), k + 0.99) for k, d in enumerate(raw))


def _count_words(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        keys, counts, held = [], [], 0

        def flush():
            k, n = _sums(np.concatenate(keys), np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["hash", "n"])

        for batch in batches:
            for _, offsets, raw in text_chunks(batch, max_bytes=SLICE):
                k, n = np.unique(sentences(offsets, raw)[0], return_counts=True)
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > FLUSH:
                    yield flush()
                    keys, counts, held = [], [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _count_pairs(docs: DataFrame, model: Model) -> DataFrame:
    """(part, pairs): compressed sorted pairs and their counts, by part."""

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            pairs, n = _sums(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            part = np.concatenate([x[2] for x in held])
            where = np.concatenate([x[0] for x in held])
            order = np.argsort(where, kind="stable")
            part = part[order][np.searchsorted(where[order], pairs)]
            names, blobs = [], []
            for p, at in _by_part(part):
                names.append(int(p))
                blobs.append(_pack(pairs[at], n[at]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["part", "pairs"])

        for batch in batches:
            for _, offsets, raw in text_chunks(batch, max_bytes=SLICE):
                tokens, _, opens = sentences(offsets, raw)
                ids, back, counts = model.encode(tokens)
                second = ids[back]
                first = np.r_[model.n_words, second[:-1]]
                first[opens] = model.n_words
                n_first = np.r_[0, counts[back][:-1]]
                n_first[opens] = opens.sum()
                pairs, at, n = np.unique((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), return_index=True, return_counts=True)
                n_first = np.where(first[at] == model.n_words, model.n_texts, n_first[at])
                held.append((pairs, n, model.part_of(first[at], second[at], n_first)))
                size += len(pairs)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "part int, pairs binary")


def _pack(pairs: np.ndarray, n: np.ndarray) -> bytes:
    first = np.diff((pairs >> np.uint64(32)).astype("<u4"), prepend=np.uint32(0)).astype("<u4")
    second, n = (pairs & np.uint64(0xFFFFFFFF)).astype("<u4"), n.astype("<u4")
    planes = [x.view(np.uint8).reshape(-1, 4)[:, i] for x in (first, second, n) for i in range(4)]
    return len(pairs).to_bytes(8, "little") + zlib.compress(np.concatenate(planes).tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zlib.decompress(blob[8:]), np.uint8).reshape(3, 4, n)
    first, second, count = (np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes)
    return (np.cumsum(first, dtype=np.uint32).astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), count.astype(np.int64)


def _store_pairs(counted: DataFrame, model: Model) -> DataFrame:
    """Write each part's arrays; (kind, id, a, b, c, d) of what others need.

    Kind 0 is a first word with its total and its pairs seen once, twice and
    more often; kind 1 a second word with its pairs; kind 2 how many pairs
    were seen once to four times; kind 5 a part that has files.
    """

    def store(part: int, blobs: list[bytes]):
        import pyarrow as pa

        got = [_unpack(b) for b in blobs]
        pairs, n = _sums(np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got]))
        large = n > 255
        _write(f"{model.path}/pair-{part}", pairs.astype("<u8"))
        _write(f"{model.path}/seen-{part}", np.where(large, 0, n).astype("u1"))
        _write(f"{model.path}/often-{part}", np.stack([pairs[large].astype("<u8"), n[large].astype("<u8")]))
        first = (pairs >> np.uint64(32)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        sums = [np.add.reduceat(x.astype(np.int64), begin) for x in (n, n == 1, n == 2, n > 2)]
        second, types = np.unique((pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), return_counts=True)
        zero = np.zeros(len(second), np.int64)
        seen = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        columns = [
            np.r_[np.zeros(len(begin), np.int32), np.ones(len(second), np.int32), np.int32(2), np.int32(5)].astype(np.int32),
            np.r_[first[begin], second, 0, part],
            np.r_[sums[0], types, seen[0], 0],
            *(np.r_[s, zero, seen[i + 1], 0] for i, s in enumerate(sums[1:])),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "id", "a", "b", "c", "d"])

    def run(batches):
        part, blobs = None, []
        for batch in batches:
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != part:
                    if blobs:
                        yield store(part, blobs)
                    part, blobs = p, []
                blobs.append(b.as_py())
        if blobs:
            yield store(part, blobs)

    dealt = counted.repartition(min(model.parts, MOST_TASKS), "part").sortWithinPartitions("part")
    schema = "kind int, id long, a long, b long, c long, d long"
    return dealt.mapInArrow(run, schema).groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in "abcd"])


# Files of several arrays: triples by part, and contexts of triples by part.
TRIPLES = ("<u4", "<u4", "<u4", "<u4", "<u4", "u1", "<u4", "<u8")  # first, span, second, from, left, seen, place and count of the often seen
CONTEXTS = ("<u4", "<u4", "<u4", "u1", "<u4", "<u8")  # middle, span, left, four sums each, place and sums of the large
LOW = np.uint64(0xFFFFFFFF)
_VIEWS: dict[str, tuple] = {}


def _write_arrays(path: str, arrays: list[np.ndarray], kinds: tuple) -> None:
    sizes = np.array([a.size for a in arrays], "<i8")
    parts = [sizes.view("u1")]
    for a, kind in zip(arrays, kinds):
        raw = np.ascontiguousarray(a.astype(kind, copy=False)).view("u1").ravel()
        parts += [raw, np.zeros(-len(raw) % 8, "u1")]
    _write(path, np.concatenate(parts))


def _arrays(path: str, kinds: tuple) -> tuple:
    if path not in _VIEWS:
        raw = mapped(path, "u1")
        if not len(raw):
            return tuple(np.zeros(0, k) for k in kinds)
        at, out = 8 * len(kinds), []
        for n, kind in zip(np.array(raw[:at]).view("<i8").tolist(), kinds):
            size = n * np.dtype(kind).itemsize
            out.append(raw[at : at + size].view(kind))
            at += size + -size % 8
        _VIEWS[path] = tuple(out)
    return _VIEWS[path]


def _find(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in its sorted stretch lo..hi, -1 where it is not."""
    if not len(values):
        return np.full(len(wanted), -1, np.int64)
    at, n = lo.astype(np.int64), hi.astype(np.int64) - lo
    for _ in range(int(n.max(initial=0)).bit_length()):
        half = n >> 1  # zero once a stretch is down to one value
        n -= half
        half *= values[at + half - 1] < wanted
        at += half
    return np.where((at < hi) & (values[np.minimum(at, len(values) - 1)] == wanted), at, -1)


def _find_pair(high: np.ndarray, span: np.ndarray, low: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Place of each pair (x, y) among pairs stored by their first number, -1 where it is not."""
    if not len(high):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(high, x.astype("<u4")), len(high) - 1)
    begin, end = span[at].astype(np.int64), span[at + 1].astype(np.int64)
    return _find(low, begin, np.where(high[at] == x, end, begin), y.astype("<u4"))


def _split(pairs: np.ndarray) -> list[np.ndarray]:
    """Sorted pairs as the distinct first numbers, where each begins, and the second numbers."""
    high = pairs >> np.uint64(32)
    begin = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(pairs) else np.zeros(0, np.int64)
    return [high[begin], np.r_[begin, len(pairs)], pairs & LOW]


def _triple_sums(pairs: np.ndarray, left: np.ndarray, n: np.ndarray | None = None, part: np.ndarray | None = None) -> tuple:
    """(sorted distinct pairs, place of each triple's pair, left, n) of distinct triples, sorted by pair and left word.

    Without ``n`` each triple counts once; with the pairs' ``part``, the part of each distinct triple follows.
    """
    distinct, place = np.unique(pairs, return_inverse=True)
    keys = (place.astype(np.uint64) << np.uint64(32)) | left.astype(np.uint64)
    keys, n = np.unique(keys, return_counts=True) if n is None else _sums(keys, n)
    own = (keys >> np.uint64(32)).astype(np.int64)
    out = distinct, own, (keys & LOW).astype(np.int64), n
    if part is None:
        return out
    of_pair = np.empty(len(distinct), part.dtype)
    of_pair[place] = part
    return *out, of_pair[own]


def _pack_triples(pairs: np.ndarray, left: np.ndarray, n: np.ndarray) -> bytes:
    # both words of sorted pairs as differences modulo 2**32, which are small
    first, second = (np.diff(x.astype("<u4"), prepend=np.uint32(0)) for x in (pairs >> np.uint64(32), pairs & LOW))
    planes = [x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, i] for x in (first, second, left, n) for i in range(4)]
    return len(pairs).to_bytes(8, "little") + zlib.compress(np.concatenate(planes).tobytes(), 1)


def _unpack_triples(blob: bytes) -> tuple:
    n = int.from_bytes(blob[:8], "little")
    planes = np.frombuffer(zlib.decompress(blob[8:]), np.uint8).reshape(4, 4, n)
    first, second, left, count = (np.ascontiguousarray(p.T).view("<u4").ravel() for p in planes)
    first, second = (np.cumsum(x, dtype=np.uint32).astype(np.uint64) for x in (first, second))
    return (first << np.uint64(32)) | second, left.astype(np.int64), count.astype(np.int64)


def _neighbours(model: Model, tokens: np.ndarray, opens: np.ndarray):
    """(word before the last, last word, word, count of the last word) of each token.

    A text's first word has no word before the last, which is n_words + 1;
    its last word, the start, is n_words. Unknown words are -1.
    """
    ids, back, counts = model.encode(tokens)
    word = ids[back]
    last, n_last = np.r_[model.n_words, word[:-1]], np.r_[0, counts[back][:-1]]
    last[opens], n_last[opens] = model.n_words, model.n_texts
    before = np.r_[model.n_words, last[:-1]]
    before[opens] = model.n_words + 1
    return before, last, word, n_last


def _count_triples(docs: DataFrame, model: Model) -> DataFrame:
    """(part, triples): compressed sorted triples and their counts, by part.

    A text's first word has only a pair with the start; it is a triple whose
    left word is n_words + 1.
    """

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def flush():
            pairs, left, part = (np.concatenate(x) for x in zip(*held))
            distinct, place, left, n, part = _triple_sums(pairs, left, part=part)
            names, blobs = [], []
            for p, at in _by_part(part):
                names.append(int(p))
                blobs.append(_pack_triples(distinct[place[at]], left[at], n[at]))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["part", "triples"])

        for batch in batches:
            for _, offsets, raw in text_chunks(batch, max_bytes=SLICE):
                tokens, _, opens = sentences(offsets, raw)
                before, last, word, n_last = _neighbours(model, tokens, opens)
                part = model.part_of(last, word, n_last).astype(np.int32)
                held.append(((last.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64), before.astype("<u4"), part))
                size += len(tokens)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "part int, triples binary")


def _write_contexts(path: str, contexts: np.ndarray, sums: np.ndarray) -> None:
    """Sorted contexts (middle word, left word) with four sums each."""
    large = np.flatnonzero((sums > 255).any(1))
    small = sums.copy()
    small[large] = 0
    _write_arrays(path, [*_split(contexts), small, large, sums[large]], CONTEXTS)


def _store_triples(counted: DataFrame, model: Model) -> DataFrame:
    """Write each part's arrays; (kind, id, a, b, c, d) of what others need.

    Kinds 0, 1 and 2 as for pairs, by the pairs' continuation counts (the plain
    counts of pairs with a text's start); kind 3 a context, its middle word
    frequent, with its total and its triples seen once, twice and more often;
    kind 4 how many triples were seen once to four times; kind 5 a part that
    has files.
    """

    def store(part: int, pairs, place, left, n):
        import pyarrow as pa

        begin = np.searchsorted(place, np.arange(len(pairs) + 1))
        large = np.flatnonzero(n > 255)
        seen = n.copy()
        seen[large] = 0
        _write_arrays(f"{model.path}/triple-{part}", [*_split(pairs), begin, left, seen, large, n[large]], TRIPLES)
        first = (pairs >> np.uint64(32)).astype(np.int64)
        kinds = np.where(first == model.n_words, n[begin[:-1]], np.diff(begin))
        word = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        sums = [np.add.reduceat(x.astype(np.int64), word) for x in (kinds, kinds == 1, kinds == 2, kinds > 2)]
        second, types = np.unique((pairs & LOW).astype(np.int64), return_counts=True)
        real = np.flatnonzero(first[place] != model.n_words)
        n = n[real]
        keys = (first[place[real]].astype(np.uint64) << np.uint64(32)) | left[real].astype(np.uint64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        opens = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        contexts = keys[opens]
        of_context = np.stack([np.add.reduceat(x[order].astype(np.int64), opens) if len(opens) else opens for x in (n, n == 1, n == 2, n > 2)], 1)
        middle, at = np.unique((contexts >> np.uint64(32)).astype(np.int64), return_inverse=True)
        hot = (model.of_ids("count", "<i8", middle) >= model.hot)[at] if len(middle) else np.zeros(0, bool)
        _write_contexts(f"{model.path}/context-{part}", contexts[~hot], of_context[~hot])
        frequent = [contexts[hot].astype(np.int64), *of_context[hot].T]
        zero = np.zeros(len(second), np.int64)
        pairs_seen, triples_seen = ([int((x == k).sum()) for k in (1, 2, 3, 4)] for x in (kinds, n))
        columns = [
            np.repeat([0, 1, 3, 2, 4, 5], [len(word), len(second), len(frequent[0]), 1, 1, 1]).astype(np.int32),
            np.r_[first[word], second, frequent[0], 0, 0, part],
            *(np.r_[sums[i], zero if i else types, frequent[i + 1], pairs_seen[i], triples_seen[i], 0] for i in range(4)),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "id", "a", "b", "c", "d"])

    def merge(held):
        pairs, left, n = (np.concatenate(x) for x in zip(*held))
        return _triple_sums(pairs, left, n)

    def run(batches):
        part, held, size, kept = None, [], 0, 0
        for batch in batches:
            for p, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != part:
                    if held:
                        yield store(part, *merge(held))
                    part, held, size, kept = p, [], 0, 0
                held.append(_unpack_triples(b.as_py()))
                size += len(held[-1][0])
                if size > 2 * max(kept, FLUSH):
                    pairs, place, left, n = merge(held)
                    held, size, kept = [(pairs[place], left, n)], len(n), len(n)
        if held:
            yield store(part, *merge(held))

    dealt = counted.repartition(min(model.parts, MOST_TASKS), "part").sortWithinPartitions("part")
    schema = "kind int, id long, a long, b long, c long, d long"
    # kept before it is summed, so that the packed triples' shuffle is gone by then
    told = keep(dealt.mapInArrow(run, schema), "told")
    sums = keep(told.groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in "abcd"]), "triples")
    discard(told)
    return sums


def _store_frequent_contexts(stats: DataFrame, model: Model) -> None:
    """Write the contexts whose middle word is frequent, dealt by their number."""

    def run(batches):
        import pyarrow as pa

        part, held = None, []

        def store():
            rows = np.concatenate(held)
            _write_contexts(f"{model.path}/frequent-{part}", rows[:, 0].astype(np.uint64), rows[:, 1:])

        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy() for i in range(6)], 1)
            cuts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else ()
            for begin, end in zip(cuts, [*cuts[1:], len(rows)]):
                if rows[begin, 0] != part:
                    if held:
                        store()
                    part, held = int(rows[begin, 0]), []
                held.append(rows[begin:end, 1:])
        if held:
            store()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["n"])

    rows = stats.where("kind = 3").select((F.col("id") % model.parts).alias("part"), "id", *"abcd")
    rows.repartition(min(model.parts, MOST_TASKS), "part").sortWithinPartitions("part", "id").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _by_part(part: np.ndarray, key: np.ndarray | None = None):
    """(part, places of it) of each part that occurs, the places in order of a key if there is one."""
    if len(part) and part.max() < 1 << 16:
        part = part.astype("<u2")  # sorted by radix
    if key is None:
        by = np.argsort(part, kind="stable")
    else:
        by = np.argsort(key)
        by = by[np.argsort(part[by], kind="stable")]
    part = part[by]
    begin = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    for a, b in zip(begin, [*begin[1:], len(by)]):
        yield part[a], by[a:b]


def _seen_triples(model: Model, before: np.ndarray, last: np.ndarray, word: np.ndarray, n_last: np.ndarray):
    """(continuation count of the pair, count of the triple) of tokens whose last two words are known."""
    kinds, seen = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    # searches in order of what is sought touch neighbouring places
    for p, own in _by_part(model.part_of(last, word, n_last), (last.astype(np.int64) << 32) | word.astype(np.int64)):
        first, span, second, begin, left, small, large, often = _arrays(f"{model.path}/triple-{p}", TRIPLES)
        at = _find_pair(first, span, second, last[own], word[own])
        own, at = own[at >= 0], at[at >= 0]
        if not len(own):
            continue
        lo, hi = begin[at].astype(np.int64), begin[at + 1].astype(np.int64)
        place = _find(left, lo, hi, before[own].astype(np.int64))
        opens = last[own] == model.n_words
        got = np.where(place >= 0, small[place], 0).astype(np.int64)
        lots = np.flatnonzero((place >= 0) & (got == 0))
        got[lots] = often[np.searchsorted(large, place[lots])] if len(lots) else 0
        kinds[own] = np.where(opens, got, hi - lo)
        seen[own] = np.where(opens, 0, got)
    return kinds, seen


def _contexts(model: Model, before: np.ndarray, last: np.ndarray, n_last: np.ndarray) -> np.ndarray:
    """Total of each context (before, last) and its triples seen once, twice and more often."""
    out = np.zeros((len(last), 4), np.int64)
    hot = n_last >= model.hot
    keys = (last.astype(np.int64) << 32) | before.astype(np.int64)
    part = np.where(hot, keys % model.parts, model.part_of(last, last, np.zeros(len(last), np.int64)))
    for name, chosen in (("context", np.flatnonzero(~hot)), ("frequent", np.flatnonzero(hot))):
        for p, own in _by_part(part[chosen], keys[chosen]):
            own = chosen[own]
            first, span, second, small, large, sums = _arrays(f"{model.path}/{name}-{p}", CONTEXTS)
            at = _find_pair(first, span, second, last[own], before[own])
            own, at = own[at >= 0], at[at >= 0]
            if not len(own):
                continue
            got = small.reshape(-1, 4)[at].astype(np.int64)
            lots = np.flatnonzero(got[:, 0] == 0)
            if len(lots):
                got[lots] = sums.reshape(-1, 4)[np.searchsorted(large, at[lots])]
            out[own] = got
    return out


def _store_columns(rows: DataFrame, key: str, part, parts: int, path: str, columns: dict[str, tuple[str, str]]) -> dict[int, int]:
    """Write columns of rows, sorted by key in parts, as arrays; rows by part."""

    def run(batches):
        import pyarrow as pa

        held, sizes = {}, []

        def store():
            if held:
                p = held["part"]
                for name, (column, kind) in columns.items():
                    _write(f"{path}/{name}-{p}", np.concatenate(held[column]).astype(np.int64, copy=False).view(np.uint64).astype(kind) if kind == "<u8" else np.concatenate(held[column]).astype(kind))
                sizes.append((p, sum(map(len, held[key]))))

        for batch in batches:
            at = batch.column(batch.schema.get_field_index("_part")).to_numpy()
            for p in np.unique(at):
                if held.get("part") != p:
                    store()
                    held = {"part": int(p)}
                for c in {key, *(c for c, _ in columns.values())}:
                    held.setdefault(c, []).append(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[at == p])
        store()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in sizes], pa.int64()), pa.array([n for _, n in sizes], pa.int64())], ["part", "n"])

    dealt = rows.withColumn("_part", part).repartition(parts, "_part").sortWithinPartitions("_part", key)
    return {r.part: r.n for r in dealt.mapInArrow(run, "part long, n long").collect()}  # one row a part


def fit(docs: DataFrame, order: int = 2, hot: int = HOT) -> Model:
    """Count all words, pairs and, of order three, triples of ``docs`` (text) and store the model.

    Words seen ``hot`` times or more are frequent, and so is a text's start if
    there are as many texts. A null text is empty; its end token counts. An
    empty table gives a model without words, for which every token is unknown.
    Ids take 32 bits, so more distinct words than that are refused. A part of
    the model holds some PART_ROWS tokens' rows; there are as many parts as
    the corpus asks for, dealt over at most MOST_TASKS tasks.
    """
    if order not in (2, 3):
        raise ValueError(f"an order of two or three, not {order}")
    spark = docs.sparkSession
    with tidy(spark):
        return _fit(spark, docs.select(F.col("text").cast("string").alias("text")), order, hot)


def _qualified(spark, path: str) -> str:
    """A path with the scheme that Spark itself would read it by."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    named = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + named[5:] if named.startswith("file:/") and not named.startswith("file://") else named


def _write_rest(spark, model: Model, names: tuple, stored: DataFrame) -> None:
    """Empty files for the parts that no row has come to."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for p in batch.column(0).to_pylist():
                for name in names:
                    _write(f"{model.path}/{name}-{p}", np.zeros(0, "u1"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rest = spark.range(model.parts).withColumnRenamed("id", "part").join(stored, "part", "left_anti")
    rest.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _fit(spark, docs: DataFrame, order: int, hot: int) -> Model:
    model = Model(f"{shared_dir(spark)}/tidemark-lm-{uuid.uuid4().hex}", order=order, hot=hot)
    model.path = _qualified(spark, model.path)
    counted = keep(_count_words(docs), "words")
    model.n_words, tokens, texts = counted.agg(F.count("*"), F.sum("n"), F.sum(F.when(F.col("hash") == int(END.astype(np.int64)), F.col("n")))).first()
    if not model.n_words:
        return model
    if model.n_words + 2 > 2**32:
        raise ValueError(f"{model.n_words} distinct words do not fit into ids of 32 bits")
    model.n_tokens, model.n_texts = int(tokens), int(texts)
    model.bits = max(1, int(np.ceil(np.log2(model.n_words / PART_ROWS + 1))))
    model.parts = max(64, model.n_tokens // PART_ROWS)
    spark.createDataFrame([(0,)], "x int").write.mode("overwrite").parquet(f"{model.path}/_made")  # makes the folder
    sizes = _store_columns(counted, "hash", F.shiftrightunsigned("hash", 64 - model.bits).cast("int"), 2**model.bits, model.path, {"word": ("hash", "<u8"), "count": ("n", "<i8")})
    model.starts = [0, *np.cumsum([sizes.get(p, 0) for p in range(2**model.bits)])[:-1].tolist()]
    for p in range(2**model.bits):
        if p not in sizes:
            for name in ("word", "count"):
                _write(f"{model.path}/{name}-{p}", np.zeros(0, "u1"))
    discard(counted)
    if order == 3:
        stats = _store_triples(_count_triples(docs, model), model)
        high = stats.where("kind = 4").first()
        model.high_discounts = _discounts([high.a, high.b, high.c, high.d])
        _store_frequent_contexts(stats, model)
        _write_rest(spark, model, ("triple", "context"), stats.where("kind = 5").select(F.col("id").alias("part")))
        _write_rest(spark, model, ("frequent",), stats.where("kind = 3").select((F.col("id") % model.parts).alias("part")).distinct())
    else:
        stats = keep(_store_pairs(_count_pairs(docs, model), model), "pairs")
        _write_rest(spark, model, ("pair", "seen", "often"), stats.where("kind = 5").select(F.col("id").alias("part")))
    seen = stats.where("kind = 2").first()
    model.discounts = _discounts([seen.a, seen.b, seen.c, seen.d])
    types = F.col("a")
    low = stats.where("kind = 1").agg(F.sum("a").alias("pairs"), *[F.count(F.when(types == k, 1)).alias(f"t{k}") for k in (1, 2, 3, 4)], F.count(F.when(types > 2, 1)).alias("more")).first()
    model.pairs = int(low.pairs)
    model.low_discounts = _discounts([low.t1, low.t2, low.t3, low.t4])
    d = model.low_discounts
    model.low_rest = (d[0] * low.t1 + d[1] * low.t2 + d[2] * low.more) / model.pairs
    d = model.discounts
    both = (
        stats.where("kind < 2")
        .groupBy("id")
        .agg(*[F.sum(F.when(F.col("kind") == 0, F.col(c)).otherwise(0)).alias(c) for c in "abcd"], F.sum(F.when(F.col("kind") == 1, F.col("a")).otherwise(0)).alias("types"))
        .withColumn("rest", F.when(F.col("a") > 0, (d[0] * F.col("b") + d[1] * F.col("c") + d[2] * F.col("d")) / F.col("a")).otherwise(1.0))
    )
    # binary search for the last part that begins at the id or before: one step a bit of their number
    starts = F.array(*map(F.lit, model.starts))
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(model.bits))])
    part = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.col("id") >= F.get(starts, at + step), at + step).otherwise(at))
    part = F.when(F.col("id") >= model.n_words, len(model.starts)).otherwise(part)
    made = _store_columns(both, "id", part, len(model.starts) + 1, model.path, {"total": ("a", "<i8"), "rest": ("rest", "<f8"), "types": ("types", "<i8"), "of": ("id", "<i8")})
    assert sum(made.values()) == model.n_words + 1
    discard(stats)
    return model


def _log_probabilities(model: Model, tokens: np.ndarray, opens: np.ndarray):
    """(log10 of the model, log10 of the base, known) of each token."""
    if not model.n_words:
        return np.zeros(len(tokens)), np.full(len(tokens), 0.0), np.zeros(len(tokens), bool)
    ids, back, counts = model.encode(tokens)
    known = ids >= 0
    of_known = lambda name, kind, other: (lambda v: (v.__setitem__(known, model.of_ids(name, kind, ids[known])), v)[1])(np.full(len(ids), other, kind))
    types, total, rest = of_known("types", "<i8", 0), of_known("total", "<i8", 0), of_known("rest", "<f8", 1.0)
    d = model.low_discounts
    low = np.maximum(types - np.select([types == 0, types == 1, types == 2], [0, d[0], d[1]], d[2]), 0) / model.pairs + model.low_rest / (model.n_words + 1)
    second = ids[back]
    first = np.r_[-1, second[:-1]]
    n_first = np.r_[0, counts[back][:-1]]
    t_first, r_first = np.r_[0, total[back][:-1]], np.r_[1.0, rest[back][:-1]]
    begin = len(model.starts)
    first[opens], n_first[opens] = model.n_words, model.n_texts
    t_first[opens], r_first[opens] = mapped(f"{model.path}/total-{begin}", "<i8")[0], mapped(f"{model.path}/rest-{begin}", "<f8")[0]
    count = np.zeros(len(tokens), np.int64)
    real = np.flatnonzero((first >= 0) & (second >= 0))
    if model.order == 3:
        before = np.r_[-1, first[:-1]]
        before[opens] = model.n_words + 1
        triple = np.zeros(len(tokens), np.int64)
        count[real], triple[real] = _seen_triples(model, before[real], first[real], second[real], n_first[real])
    else:
        pairs, at, place = np.unique((first[real].astype(np.uint64) << np.uint64(32)) | second[real].astype(np.uint64), return_index=True, return_inverse=True)
        part = model.part_of(first[real][at], second[real][at], n_first[real][at])
        found = np.zeros(len(pairs), np.int64)
        for p, own in _by_part(part):
            found[own] = _seen(model, p, pairs[own])
        count[real] = found[place]
    d = model.discounts
    high = np.maximum(count - np.select([count == 0, count == 1, count == 2], [0, d[0], d[1]], d[2]), 0) / np.maximum(t_first, 1)
    p = high + r_first * low[back]
    if model.order == 3:
        of = np.flatnonzero(~opens & (first >= 0) & (before >= 0))
        sums = _contexts(model, before[of], first[of], n_first[of])
        of, sums = of[sums[:, 0] > 0], sums[sums[:, 0] > 0]
        d, n = model.high_discounts, triple[of]
        high = np.maximum(n - np.select([n == 0, n == 1, n == 2], [0, d[0], d[1]], d[2]), 0) / sums[:, 0]
        p[of] = high + sums[:, 1:] @ np.array(d) / sums[:, 0] * p[of]
    base = np.log10((counts + 0.1) / (model.n_tokens + 0.1 * (model.n_words + 1)))
    return np.log10(p), base[back], (counts > 0)[back]


def _seen(model: Model, part: int, pairs: np.ndarray) -> np.ndarray:
    stored = mapped(f"{model.path}/pair-{part}", "<u8")
    if not len(stored):
        return np.zeros(len(pairs), np.int64)
    at = np.minimum(np.searchsorted(stored, pairs), len(stored) - 1)
    hit = stored[at] == pairs
    n = np.where(hit, mapped(f"{model.path}/seen-{part}", "u1")[at], 0).astype(np.int64)
    lots = np.flatnonzero(hit & (n == 0))
    if len(lots):
        often = mapped(f"{model.path}/often-{part}", "<u8").reshape(2, -1)
        n[lots] = often[1][np.searchsorted(often[0], pairs[lots])]
    return n


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Add n_tokens, n_known, train_tokens, base_score and score to a table, without its text.

    ``score`` is the model's log10 probability of the text with its end token,
    ``base_score`` that of smoothed word counts. A null, empty or blank text
    is its end token; equal texts score equally; an empty table gives no rows;
    other columns stay, but for ones named as the five. Without training text
    all scores are zero.
    """
    added = [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    docs = docs.drop(*(f.name for f in added))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], []]
            for _, offsets, raw in text_chunks(batch, max_bytes=SLICE):
                tokens, owner, opens = sentences(offsets, raw)
                high, base, known = _log_probabilities(model, tokens, opens)
                n = len(offsets) - 1
                for column, weight in zip(out, (None, known, base, high)):
                    column.append(np.bincount(owner, weight, n))
            n_tokens, n_known, base, score = (np.concatenate(c) if c else np.zeros(0) for c in out)
            columns = [pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(np.full(len(score), model.n_tokens, np.int64)), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays([*(c for c, k in zip(batch.columns, batch.schema.names) if k != "text"), *columns], [*(k for k in batch.schema.names if k != "text"), "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(run, T.StructType([*(f for f in docs.schema.fields if f.name != "text"), *added]))


def held_out() -> Column:
    """Whether a document stays out of training."""
    return F.coalesce(crc_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False))
