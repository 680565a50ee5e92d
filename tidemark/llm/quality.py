"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of 64 words. Each passage is encoded by its
words, as shares of WORD_CELLS cells of a hash, by the shares of its
characters' classes and by how its words repeat. The first layer has learned
weights for each cell, so it is a table of hashed word vectors; what it makes
is the passage's representation, gated attention (tanh times sigmoid) its
weight, and the document is scored from the weighted representation. Only document labels
are needed: attention learns which passages tell.

The model is fitted on a bounded sample of the labelled documents and then
scores every document as a whole in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_bucket, mix, text_chunks, words

PASSAGE = 64
TRAIN_DOCS = 6000
TRAIN_PASSAGES = 64
WORD_CELLS = 128
FOLDS, HELD_OUT = 3, 1
MARKS = b".,!?|#$%&*:;-_=+/\\\"'()<>@"
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 4
_CLASS[[9, 11, 12, 13, 32]] = 5
_CLASS[10] = 6
for _i, _c in enumerate(MARKS):
    _CLASS[_c] = 7 + _i
N_CLASSES = 7 + len(MARKS)
N_PLAIN = N_CLASSES + 4
N_FEATURES = N_PLAIN + WORD_CELLS


def encode_passages(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, text of each passage) of a slice of texts, in order.

    A text without words has one passage of zeros.
    """
    h, row, start, end = words(offsets, raw, fold=False)
    texts = len(offsets) - 1
    first = np.searchsorted(row, np.arange(texts + 1))
    per = np.maximum(-(-np.diff(first) // PASSAGE), 1)
    begin = np.r_[0, np.cumsum(per)]
    owner = np.repeat(np.arange(texts), per)
    x = np.zeros((len(owner), N_FEATURES))
    if not len(h):
        return x, owner
    place = begin[row] + (np.arange(len(h)) - first[row]) // PASSAGE
    # a passage ends where the next one's first word starts
    opens = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    at = start[opens]
    of_byte = np.searchsorted(at, np.arange(int(end[-1])), "right") - 1
    known = of_byte >= 0
    code = place[opens][of_byte[known]] * N_CLASSES + _CLASS[raw[: int(end[-1])][known]]
    counts = np.bincount(code, minlength=len(owner) * N_CLASSES).reshape(len(owner), N_CLASSES)
    x[:, :N_CLASSES] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    n = np.bincount(place, minlength=len(owner))
    safe = np.maximum(n, 1)
    again = np.r_[False, (h[1:] == h[:-1]) & (place[1:] == place[:-1])]
    key = np.sort((place.astype(np.uint64) << np.uint64(40)) | (mix(h) >> np.uint64(24)))
    fresh = np.r_[True, key[1:] != key[:-1]]
    x[:, N_CLASSES] = np.log1p(np.bincount(place, end - start, len(owner)) / safe) / 3
    x[:, N_CLASSES + 1] = np.bincount(place, again, len(owner)) / safe
    x[:, N_CLASSES + 2] = np.bincount((key[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(owner)) / safe
    x[:, N_CLASSES + 3] = np.log1p(n) / 4
    folded = words(offsets, raw)[0]
    cells = np.bincount(place * WORD_CELLS + (folded % np.uint64(WORD_CELLS)).astype(np.int64), minlength=len(owner) * WORD_CELLS).reshape(len(owner), WORD_CELLS)
    x[:, N_PLAIN:] = np.sqrt(cells / safe[:, None])
    return x, owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of the network; ``prior`` alone scores if nothing was learned."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: dict[str, np.ndarray] | None = None

    def forward(self, x: np.ndarray, owner: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        """Passages of a bag lie together and every bag has one at least."""
        w, begin = self.w, np.searchsorted(owner, np.arange(bags))
        hidden = np.tanh(x @ w["enter"] + w["bias"])
        t, s = np.tanh(hidden @ w["tanh"]), _sigmoid(hidden @ w["gate"])
        raw = (t * s) @ w["weigh"]
        e = np.exp(raw - np.maximum.reduceat(raw, begin)[owner])
        a = e / np.add.reduceat(e, begin)[owner]
        z = np.add.reduceat(a[:, None] * hidden, begin)
        return {"hidden": hidden, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["out"] + w["out_bias"]), "begin": begin}

    def score(self, x: np.ndarray, owner: np.ndarray, bags: int) -> np.ndarray:
        if self.w is None:
            return np.full(bags, self.prior)
        return self.forward((x - self.mean) / self.scale, owner, bags)["p"]


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 250, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Fit by Adam on all bags at once; both labels weigh the same."""
    prior = float((y.sum() + 1) / (len(y) + 2))
    if len(y) == 0 or y.min() == y.max():
        return Model(prior)
    r = np.random.default_rng(7)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    draw = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"enter": draw(x.shape[1], hidden), "bias": np.zeros(hidden), "tanh": draw(hidden, gate), "gate": draw(hidden, gate), "weigh": draw(gate), "out": draw(hidden), "out_bias": np.zeros(1)}
    model = Model(prior, mean, scale, w)
    x = (x - mean) / scale
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(u) for k, u in w.items()}
    for step in range(1, steps + 1):
        grad = gradients(model, x, owner, y)
        for k in w:
            grad[k] += decay * w[k]
            m[k] += 0.1 * (grad[k] - m[k])
            v[k] += 0.001 * (grad[k] ** 2 - v[k])
            w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def gradients(model: Model, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the log loss, in which both labels weigh the same, by each weight; x is standardised."""
    w, f = model.w, model.forward(x, owner, len(y))
    d = (f["p"] - y) * np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    dz = (d[:, None] * w["out"])[owner]
    dh = f["a"][:, None] * dz
    da = (dz * f["hidden"]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["begin"])[owner])
    g = de[:, None] * w["weigh"]
    dt, ds = g * f["s"] * (1 - f["t"] ** 2), g * f["t"] * f["s"] * (1 - f["s"])
    dh += dt @ w["tanh"].T + ds @ w["gate"].T
    dx = dh * (1 - f["hidden"] ** 2)
    return {"enter": x.T @ dx, "bias": dx.sum(0), "tanh": f["hidden"].T @ dt, "gate": f["hidden"].T @ ds, "weigh": (f["t"] * f["s"]).T @ de, "out": f["z"].T @ d, "out_bias": np.array([d.sum()])}


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, passages: int = TRAIN_PASSAGES) -> Model:
    """Learn from at most ``most`` labelled documents outside the held-out fold.

    The sample is the labelled ids with the smallest hashes, so that it does
    not depend on the order of rows. Of a document with more than ``passages``
    passages as many, spread evenly from its first to its last one, are
    learned from, which bounds the bytes at the driver; scores take all
    passages. Only text is an input. An id whose labels disagree teaches
    nothing; of a repeated id each different text is learned from.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_bucket("doc_id", FOLDS) != HELD_OUT))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").select("doc_id", F.col("quality").cast("int").alias("quality")).limit(most)

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for row, offsets, raw in text_chunks(batch):
                x, owner = encode_passages(offsets, raw)
                ends = np.searchsorted(owner, np.arange(len(offsets)))
                some = lambda a, b: np.unique(np.linspace(a, b - 1, min(b - a, passages)).round().astype(int))
                bags = [x[some(a, b)].astype("<f4").tobytes() for a, b in zip(ends, ends[1:])]
                ids = batch.column(0).slice(row, len(bags))
                yield pa.RecordBatch.from_arrays([ids, pa.array(y[row : row + len(bags)], pa.int32()), pa.array(bags, pa.binary())], ["doc_id", "quality", "x"])

    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # at most ``most`` rows
    rows = picked.select("doc_id", "quality", "text").mapInArrow(encode, "doc_id long, quality int, x binary").toPandas()
    rows = rows.drop_duplicates(["doc_id", "quality", "x"])
    rows = rows[rows.groupby("doc_id")["quality"].transform("nunique") == 1].sort_values(["doc_id", "x"], kind="stable").reset_index(drop=True)
    bags = [np.frombuffer(b, "<f4").reshape(-1, N_FEATURES).astype(float) for b in rows["x"]]
    if not bags:
        return Model(0.5)
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return train(np.concatenate(bags), owner, (rows["quality"].to_numpy() == 1).astype(float))


def score_documents(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Add the score of each whole text to a table; its other columns stay, but for one of that name.

    Scores lie in 0 to 1 and are higher where label 1 is likelier. A null,
    empty or blank text is scored as one passage of zeros; equal texts get
    equal scores; an empty table gives no rows.
    """

    docs = docs.drop(name)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [model.score(*encode_passages(offsets, raw), len(offsets) - 1) for _, offsets, raw in text_chunks(batch)]
            score = pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)
