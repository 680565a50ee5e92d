"""Best-fit packing: minimum bin slack over the lengths of all pieces.

Documents are tokenized in Arrow batches; only their piece lengths travel on.
The packing itself works on the histogram of lengths, which has at most one
row per length up to the capacity, whatever the corpus holds. For each bin a
bitset subset-sum finds the fullest combination of the lengths that are left;
the combination is taken as often as its lengths allow, so the plan stays
small. Pieces then find their bin by their rank among pieces of equal length.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, setting

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 150_000  # of each of two generations: some 60 MB of a worker
CACHE_BYTES = 64  # longer chunks are not kept
STALE = 8  # chunks that were not kept, as a multiple of those that were, until a new generation begins
BATCH_ROWS = 1_000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


# texts of Latin letters, digits, ASCII signs and blanks, in lower case and Latin-1; an apostrophe may begin an ending
_WORD = rb"[a-z\xdf-\xf6\xf8-\xff]+"
_PIECES = re.compile(_WORD + rb"|[0-9]|[!-&(-/:-@\[-`{-~]+")
_LETTERS = re.compile(_WORD)
_PLAIN = bytes(c for c in range(256) if chr(c) in " \t\n\r" or _PIECES.match(bytes([c])))


def plain_pieces(text: str) -> list[bytes] | None:
    """The words, digits and runs of signs of a text that has nothing else; else None."""
    try:
        raw = text.lower().encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if raw.translate(None, _PLAIN) else _PIECES.findall(raw)


def cuts_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer folds case and blanks, and cuts words, digits and signs, as ``_Ids`` takes for granted."""
    folds = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    blank = len(folds) == 3 and [f["type"] for f in folds] == ["NFC", "Replace", "Lowercase"] and folds[1]["pattern"] == {"Regex": r"\s+"} and folds[1]["content"] == " "
    split = len(cuts) == 2 and cuts[0]["type"] == "Split" and cuts[0]["invert"] and cuts[0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    special = all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))
    return blank and split and special and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"] and spec.get("post_processor") is None


class _Ids(dict):
    """Token ids of pieces of text (bytes) and of chunks without blanks (str), as little-endian bytes.

    A tokenizer that ``cuts_at_blanks`` gives a text of ``plain_pieces`` their
    ids in order. It never joins characters across a blank, so other texts
    have those of their chunks; other tokenizers are given whole texts. A word
    of Latin letters is one piece for the tokenizer's model, which is asked
    directly. Short pieces and chunks are kept until there are
    ``CACHE_WORDS``, which the frequent ones are among; when many others have
    been asked for since, a new generation begins, which takes over what is
    asked for again, so that memory is bounded.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunks = cuts_at_blanks(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(128, 256) if _LETTERS.match(bytes([c]))}
        self.old: dict[bytes | str, bytes] = {}
        self.missed = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: bytes | str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            if isinstance(chunk, str):
                pieces = plain_pieces(chunk)
                if pieces is not None:
                    return b"".join([self[p] for p in pieces])
                ids = self.whole(chunk)
            elif _LETTERS.match(chunk):
                word = chunk.decode("latin-1")
                found = [t.id for t in self.model.tokenize(word if chunk.isascii() else word.translate(self.letters))]
                ids = struct.pack(f"<{len(found)}I", *found)
            else:
                ids = self.whole(chunk.decode("latin-1"))
        if len(self) >= CACHE_WORDS:
            self.missed += 1
        elif len(chunk) <= CACHE_BYTES:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_chunks or "<|" in text:  # that may spell a special token, which is not folded
            return self.whole(text)
        if self.missed > STALE * CACHE_WORDS:
            self.old, self.missed = dict(self), 0
            self.clear()
        elif self.missed:
            self.old = {}
        pieces = plain_pieces(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ") if pieces is None else pieces))


_KNOWN: dict[str, _Ids] = {}  # of this worker, over its tasks


def _ids_of(path: str) -> _Ids:
    if path not in _KNOWN:
        _KNOWN[path] = _Ids(path)
    return _KNOWN[path]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids (null: none) and then one end id. Only a
    longer one is cut; its last piece may be shorter.
    """
    end = np.array([END_ID], "<u4").tobytes()

    def pieces(batches):
        import pyarrow as pa

        ids_of = _ids_of(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            out = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of.encode(text.as_py() or "") + end
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, value in zip(out, (doc_id, piece, start, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


def _fullest(lengths: list[int], left: list[int], room: int) -> list[tuple[int, int]]:
    """The (index, copies) whose lengths fill ``room`` best; ``lengths`` descend.

    Bit s of the set says that s tokens can be reached. Copies join by powers
    of two, so a length costs the logarithm of its copies; the search ends as
    soon as ``room`` itself is reached.
    """
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for i, (length, n) in enumerate(zip(lengths, left)):
        if length > room:
            continue
        n = min(n, room // length)
        size = 1
        while n:
            take = min(size, n)
            steps.append((i, take, reach))
            reach |= (reach << (take * length)) & full
            n -= take
            size *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for i, take, before in reversed(steps):
        if not before >> at & 1:
            used[i] = used.get(i, 0) + take
            at -= take * lengths[i]
    return sorted(used.items())


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over a histogram of lengths: (bins, [(length, copies)]).

    Each bin begins with the longest piece that is left; the rest of it is the
    fullest combination that the other lengths allow. The same combination is
    removed as often as the counts permit, as a repeated search would find it
    again.
    """
    lengths = sorted((k for k, n in histogram.items() if n), reverse=True)
    left = [histogram[k] for k in lengths]
    out = []
    while lengths:
        left[0] -= 1
        rest = _fullest(lengths, left, capacity - lengths[0])
        left[0] += 1
        need = dict(rest)
        need[0] = need.get(0, 0) + 1
        bins = min(left[i] // n for i, n in need.items())
        out.append((bins, [(lengths[i], n) for i, n in sorted(need.items())]))
        for i, n in need.items():
            left[i] -= bins * n
        if not all(left[i] for i in need):
            lengths, left = map(list, zip(*[x for x in zip(lengths, left) if x[1]])) if any(left) else ([], [])
    return out


def place(pieces: DataFrame, capacity: int = CAPACITY, rows_per_salt: int = 1_000_000) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, start, length, ...).

    Only the histogram of lengths, at most ``capacity`` rows, reaches the
    driver. Ranks among equal lengths are counted within salted groups, so a
    length of a third of all pieces is dealt over many tasks; a running sum of
    the groups' sizes turns them into ranks over all pieces of that length.
    """
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(64, sum(counts.values()) // rows_per_salt)
    slots, taken, base = {}, dict.fromkeys(counts, 0), 0
    for bins, parts in plan_bins(counts, capacity):
        at = 0
        for length, copies in parts:
            slots.setdefault(length, []).append((taken[length], copies, base, at))
            taken[length] += bins * copies
            at += length * copies
        base += bins
    plan = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in slots.items()})  # bounded by the capacity

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for k, at in length.groupby(length).indices.items():
            t, r = plan.value[k], rank.to_numpy()[at]
            row = np.searchsorted(t[:, 0], r, "right") - 1
            inside = r - t[row, 0]
            sequence[at] = t[row, 2] + inside // t[row, 1]
            offset[at] = t[row, 3] + inside % t[row, 1] * k
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    group = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("_rank", F.row_number().over(group) - 1)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    first = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    placed = ranked.join(first, ["length", "_salt"]).withColumn("_slot", slot("length", F.col("_rank") + F.col("_first")))
    return placed.select(*pieces.columns, "_slot.sequence_id", "_slot.offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, one
    row per piece. A null or empty text is one end id. Repeated documents are
    packed as often as they occur. An empty table gives no rows. Extra columns
    are left out.
    """
    # texts go to the workers in small batches, of which several copies are held at once
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS)):
        pieces = keep(tokenize(docs, tokenizer, capacity), "pieces")
    return place(pieces, capacity)
