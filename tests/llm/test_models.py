"""Language model, Jaccard join and quality classifier against brute force."""

import math
import pathlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, jaccard_join, language_model, quality
from tidemark.llm.components import connected_components

from .util import ODD, docs, empty, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    return WORD.findall((text or "").encode().lower())


# --- language model -----------------------------------------------------------


def kneser_ney(train):
    pairs, words = Counter(), Counter()
    for t in train:
        w = [None, *split(t), "</s>"]
        words.update(w[1:])
        pairs.update(zip(w, w[1:]))
    total, kinds, types = Counter(), defaultdict(Counter), Counter()
    for (a, b), n in pairs.items():
        total[a] += n
        kinds[a][min(n, 3)] += 1
        types[b] += 1
    count = lambda c: [sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]

    def discounts(n):
        if min(n) <= 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k - 0.01) for k in (1, 2, 3))]

    d, e = discounts(count(pairs)), discounts(count(types))
    rest = sum(e[min(n, 3)] for n in types.values()) / len(pairs)

    def p(a, b):
        low = max(types[b] - e[min(types[b], 3)], 0) / len(pairs) + rest / (len(words) + 1)
        if not total[a]:
            return low
        n = pairs[a, b]
        return max(n - d[min(n, 3)], 0) / total[a] + sum(d[k] * m for k, m in kinds[a].items()) / total[a] * low

    return p, words


def test_model_files_are_plain_arrays_and_searches_find_what_is_there(tmp_path):
    r = np.random.default_rng(5)
    path = f"file://{tmp_path}/plain"
    language_model._write(path, np.arange(9, dtype="<u8"))
    assert type(language_model.mapped(path, "<u8")) is np.ndarray  # slices of a memmap took a fifth of a score's time
    cuts = np.r_[0, np.sort(r.integers(0, 900, 60)), 900, 900]
    values = np.concatenate([np.sort(r.choice(2000, b - a, replace=False)) for a, b in zip(cuts, cuts[1:])]).astype("<u4")
    at = r.integers(0, len(cuts) - 1, 3000)
    wanted = np.where(r.random(3000) < 0.5, values[np.minimum(cuts[at], 899)], r.integers(0, 2000, 3000)).astype("<u4")
    stretches = [values[a:b].tolist() for a, b in zip(cuts, cuts[1:])]
    expected = [cuts[k] + stretches[k].index(w) if w in stretches[k] else -1 for k, w in zip(at, wanted.tolist())]
    assert language_model._find(values, cuts[at], cuts[at + 1], wanted).tolist() == expected
    assert language_model._find(values, cuts[:0], cuts[:0], wanted[:0]).tolist() == []
    pairs, left = r.integers(0, 50, 4000).astype(np.uint64) << np.uint64(32), r.integers(0, 9, 4000)
    distinct, place, word, n, part = language_model._triple_sums(pairs, left, part=(pairs >> np.uint64(32)).astype(np.int32) % 7)
    counted = Counter(zip(pairs.tolist(), left.tolist()))
    assert [*zip(distinct[place].tolist(), word.tolist(), n.tolist())] == [(p, w, k) for (p, w), k in sorted(counted.items())]
    assert (part == (distinct[place] >> np.uint64(32)).astype(np.int32) % 7).all()


def test_language_model_against_brute_force(spark, tmp_path):
    texts = [*ODD, *[prose(30 + i, i % 25) for i in range(60)], "a a b a a c " * 40]
    docs(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in catalog.op3_language_model(spark, str(tmp_path)).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))}
    p, words = kneser_ney([t for i, t in enumerate(texts) if not out[i]])
    n, v = sum(words.values()), len(words)
    assert abs(sum(p(b"a", b) for b in words) + p(b"a", "unseen") - 1) < 1e-9
    for i, t in enumerate(texts):
        w = [None, *split(t), "</s>"]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (out[i], len(w) - 1, n)
        assert r.n_known == sum(words[x] > 0 for x in w[1:])
        assert r.base_score == pytest.approx(sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w[1:]))
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(w, w[1:])))


def test_language_model_hot_pairs_and_no_training(spark, monkeypatch):
    d = docs(spark, ["x y " * 700 + "z"] * 3 + ["x z"])
    one = [r.score for r in language_model.score_documents(d, language_model.fit(d)).orderBy("doc_id").collect()]
    p, _ = kneser_ney(["x y " * 700 + "z"] * 3 + ["x z"])
    assert one[3] == pytest.approx(math.log10(p(None, b"x")) + math.log10(p(b"x", b"z")) + math.log10(p(b"z", "</s>")))
    nothing = language_model.fit(empty(spark))
    assert [r.score for r in language_model.score_documents(d, nothing).collect()] == [0.0] * 4
    assert language_model.score_documents(empty(spark), nothing).count() == 0


def kneser_ney_three(train):
    """The same at order three: plain counts of triples, continuation counts below (a text's start has plain ones)."""
    triples, pairs, words = Counter(), Counter(), Counter()
    for t in train:
        w = [None, *split(t), "</s>"]
        words.update(w[1:])
        triples.update(zip(w, w[1:], w[2:]))
        pairs[None, w[1]] += 1
    for _, b, c in triples:
        pairs[b, c] += 1
    types = Counter(c for _, c in pairs)

    def level(counts):
        n = [sum(1 for x in counts.values() if x == k) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if min(n) > 0 else 0
        d = [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.01), k - 0.01) for k in (1, 2, 3))] if min(n) > 0 else [0, 0.5, 1.0, 1.5]
        total, rest = Counter(), Counter()
        for key, x in counts.items():
            total[key[:-1]] += x
            rest[key[:-1]] += d[min(x, 3)]
        return lambda key, low: (max(counts[key] - d[min(counts[key], 3)], 0) + rest[key[:-1]] * low) / total[key[:-1]] if total[key[:-1]] else low

    high, middle, low = level(triples), level(pairs), level(Counter({(c,): n for c, n in types.items()}))
    return (lambda a, b, c: high((a, b, c), middle((b, c), low((c,), 1 / (len(words) + 1))))), words


@pytest.mark.parametrize("hot", [language_model.HOT, 60])
def test_trigrams_against_brute_force(spark, tmp_path, hot):
    texts = [*ODD, *[prose(30 + i, i % 25) for i in range(60)], "a b a a c " * 40, "w a w " * 300 + "unseen words"]
    docs(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    p, words = kneser_ney_three(kept)
    assert abs(sum(p(b"a", b"b", c) for c in words) + p(b"a", b"b", "unseen") - 1) < 1e-9
    if hot == language_model.HOT:
        got = catalog.queries()["op3_language_model"](spark, str(tmp_path)).collect()
    else:
        d = spark.read.parquet(f"{tmp_path}/documents.parquet")
        got = language_model.score_documents(d, language_model.fit(d.where(~language_model.held_out()), 3, hot)).collect()
    assert len(got) == len(texts)
    for r in got:
        w = [None, *split(texts[r.doc_id]), "</s>"]
        want = [math.log10(p("no", None, w[1])), *(math.log10(p(*x)) for x in zip(w, w[1:], w[2:]))]
        assert r.score == pytest.approx(sum(want)), r.doc_id


def test_trigrams_without_training_and_other_orders(spark):
    nothing = language_model.fit(empty(spark), 3)
    assert [r.score for r in language_model.score_documents(docs(spark, ["x y"]), nothing).collect()] == [0.0]
    with pytest.raises(ValueError):
        language_model.fit(empty(spark), 4)


def test_held_out_text_is_likelier_than_by_words_alone(spark, sf):
    r = catalog.op3_language_model(spark, sf).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


# --- Jaccard join -------------------------------------------------------------


def brute_components(texts, k=4, percent=85):
    sets = {}
    for i, t in enumerate(texts):
        w = split(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def edited(text, share, seed):
    r = np.random.default_rng(seed)
    return " ".join(f"edit{r.integers(10**6)}" if r.random() < share else w for w in text.split(" "))


@pytest.mark.parametrize("leaf,block", [(64, 512), (1, 512), (2, 4)])
def test_join_against_brute_force(spark, leaf, block):
    texts = [*ODD]
    for i in range(12):
        t = prose(20 + 40 * i, i)
        texts += [t, t.upper(), *[edited(t, s, 100 * i + n) for n, s in enumerate((0.002, 0.01, 0.02, 0.03, 0.04, 0.06))]]
    common = prose(60, 77)
    texts += [common + " " + prose(8, 200 + i) for i in range(15)]
    chain = prose(100, 5).split(" ")
    for _ in range(8):
        chain = chain[3:] + prose(3, len(texts)).split(" ")
        texts.append(" ".join(chain))
    texts += [edited(prose(300, 6), 0.012, i) for i in range(30)]
    texts += [" ".join(f"w{j}" for j in range(n)) for n in range(1, 40)]
    got = jaccard_join.join_components(docs(spark, texts).repartition(3), leaf=leaf, block=block)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts)


def test_join_edge_cases(spark):
    assert jaccard_join.join_components(empty(spark)).count() == 0
    d = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (9, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in jaccard_join.join_components(d.withColumn("component_id", F.lit("x"))).collect() if r.doc_id)
    assert got == [(2, 2, 2), (2, 2, 2), (3, 2, 2), (9, 0, 9)]


def test_regions_meet_for_every_linked_pair():
    r = np.random.default_rng(5)
    rarity = r.integers(60, 64, 1 << jaccard_join.CELLS).astype(np.uint8)
    for percent in (80, 85):
        for _ in range(3000):
            n = int(r.integers(1, 160))
            x = r.integers(0, 2**63, n, dtype=np.uint64)
            few = max(int(0.12 * n), 1)
            y = np.r_[x[r.integers(0, few + 1) :], r.integers(0, 2**63, r.integers(0, few + 1), dtype=np.uint64)]
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y))
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                met = np.intersect1d(*(jaccard_join.first_shingles(s, rarity, percent) for s in (x, y))).size
                assert met >= jaccard_join.need(min(len(x), len(y)))


def test_a_line_that_many_documents_share(spark):
    line = prose(40, 5)
    texts = [f"{line} {prose(30, 100 + i)}" for i in range(1500)] + [f"{prose(60, 7)} {prose(3, 5000 + i)}" for i in range(300)]
    got = jaccard_join.join_components(docs(spark, texts).repartition(4), leaf=16, block=64)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i if i < 1500 else 1500 for i in range(1800)}


def test_regions_are_divided_until_they_are_small(spark, monkeypatch):
    """Documents made of common passages: large regions of several components."""
    rounds = []
    blocks = jaccard_join.compare_blocks
    monkeypatch.setattr(jaccard_join, "compare_blocks", lambda *a: rounds.append("blocks") or blocks(*a))
    measured = jaccard_join.measure
    monkeypatch.setattr(jaccard_join, "measure", lambda *a, **k: rounds.append("measure") or measured(*a, **k))
    r = np.random.default_rng(8)
    parts = [prose(25, 900 + i) for i in range(8)]
    texts = [" ".join(edited(parts[j], 0.01, 1000 * i + j) for j in sorted(r.choice(8, 5, replace=False))) for i in range(120)]
    got = jaccard_join.join_components(docs(spark, texts).repartition(3), leaf=4, block=8)
    assert {q.doc_id: (q.n_shingles, q.component_id) for q in got.collect()} == brute_components(texts)
    assert rounds.count("measure") > 4  # beyond the star, the closest ones and the rest


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(links.limit(0)).count() == 0


def test_a_model_of_more_than_64_parts(spark, monkeypatch):
    texts = [*ODD, *[prose(40 + i, i % 40) for i in range(120)]]
    d = docs(spark, texts).withColumn("score", F.lit("clash"))
    one = language_model.score_documents(d, language_model.fit(d, 3)).orderBy("doc_id").collect()
    monkeypatch.setattr(language_model, "PART_ROWS", 50)
    monkeypatch.setattr(language_model, "MOST_TASKS", 7)
    monkeypatch.setattr(language_model, "MOST_MAPPED", 20)
    model = language_model.fit(d, 3, hot=40)
    assert model.parts > 64 and model.n_texts == len(texts)
    two = language_model.score_documents(d, model).orderBy("doc_id").collect()
    assert [q.score for q in two] == pytest.approx([q.score for q in one]) and one[0].asDict().keys() == two[0].asDict().keys()


def test_a_model_of_a_thousand_word_parts(spark, monkeypatch):
    d = docs(spark, [prose(60, i) + f" only{i} once{i}" for i in range(300)])
    model = language_model.fit(d, 2)
    want = language_model.score_documents(d, model).orderBy("doc_id").collect()
    monkeypatch.setattr(language_model, "PART_ROWS", model.n_words / 1000)
    monkeypatch.setattr(language_model, "MOST_TASKS", 4)
    many = language_model.fit(d, 2)
    assert len(many.starts) == 1024
    got = language_model.score_documents(d, many).orderBy("doc_id").collect()
    assert [r.score for r in got] == pytest.approx([r.score for r in want])


@pytest.mark.parametrize("lost", ["triple", "context", "frequent", "total"])
def test_a_lost_file_is_an_error(spark, lost):
    texts = [prose(40 + i, i % 40) for i in range(80)]
    model = language_model.fit(docs(spark, texts), 3, hot=20)
    where = pathlib.Path(model.path.removeprefix("file://"))
    for p in where.glob(f"{lost}-*"):
        p.unlink()
    with pytest.raises(Exception, match="has lost its file"):
        language_model.score_documents(docs(spark, texts), model).collect()


def test_a_path_is_of_the_file_system_that_spark_reads(spark, tmp_path):
    assert language_model._qualified(spark, "/a/b") == "file:///a/b" == language_model._qualified(spark, "file:/a/b")
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.other.link./in", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://other/")
    try:
        assert language_model._qualified(spark, "/in/b") == "viewfs://other/in/b"
    finally:
        conf.set("fs.defaultFS", "file:///")


def test_a_file_is_written_once(tmp_path):
    path = f"file://{tmp_path}/word-0"
    for _ in range(2):
        language_model._write(path, np.arange(5))
    assert [p.name for p in tmp_path.iterdir()] == ["word-0"]


# --- quality ------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.op10_quality(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 50 and r.right > 0.95


def test_gradients_against_differences():
    r = np.random.default_rng(1)
    x, owner, y = r.normal(size=(12, quality.N_FEATURES)), np.repeat(np.arange(4), 3), np.array([0.0, 1, 1, 0])
    model = quality.train(x, owner, y, hidden=5, gate=3, steps=1, rate=0.0, decay=0.0)
    grad = quality.gradients(model, (x - model.mean) / model.scale, owner, y)
    weight = np.full(4, 0.25)
    loss = lambda: -(weight * np.log(np.where(y == 1, (p := model.score(x, owner, 4)), 1 - p))).sum()
    for name, w in model.w.items():
        for at in list(np.ndindex(w.shape))[:: max(w.size // 7, 1)]:
            kept = w[at]
            w[at] = kept + 1e-5
            up = loss()
            w[at] = kept - 1e-5
            assert grad[name][at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6), (name, at)
            w[at] = kept


def test_words_alone_tell_the_label(spark):
    r = np.random.default_rng(2)
    good, bad = ([f"{c}{''.join(r.choice(list('aeioulnrst'), 5))}" for _ in range(30)] for c in "bd")
    rows = [(i, " ".join(r.choice(good if i % 2 else bad, 90)), i % 2) for i in range(400)]
    d = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    got = {q.doc_id: q.score for q in quality.score_documents(d.withColumn("score", F.lit("x")), model).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 2 == 1) for i in out]) > 0.95


def test_scores_are_defined_for_any_text(spark):
    d = docs(spark, [*ODD, prose(500, 1)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(0, 0, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(d, labels)
    got = {r.doc_id: r.score for r in quality.score_documents(d.withColumn("quality", F.lit(1)), model).collect()}
    assert len(got) == 11 and all(0 <= s <= 1 for s in got.values())
    assert got[6] == got[7] and got[0] == got[1]
    assert quality.score_documents(empty(spark), model).count() == 0
    assert quality.fit(empty(spark), labels).prior == 0.5
    one = quality.fit(d, labels.where("quality = 1"))
    assert one.w is None and one.prior > 0.5


def test_gradient_of_the_network():
    r = np.random.default_rng(3)
    x, owner = r.normal(size=(60, quality.N_FEATURES)), np.repeat(np.arange(20), 3)
    x[owner % 2 == 0, 0] += 2
    y = (np.arange(20) % 2).astype(float)
    model = quality.train(x, owner, y, steps=150)
    assert ((model.score(x, owner, 20) > 0.5) == (y == 1)).mean() > 0.95


def test_bucket_counts_bound_the_difference():
    r = np.random.default_rng(3)
    for n, cut in ((1, 0), (40, 3), (900, 200), (5000, 100), (1025, 30)):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[cut:], r.integers(0, 2**63, cut // 2, dtype=np.uint64)])
        bound = jaccard_join.least_apart(jaccard_join.bucket_counts(a), jaccard_join.bucket_counts(b))
        assert bound <= len(np.setxor1d(a, b))
        assert bound > 0.5 * len(np.setxor1d(a, b)) or not cut
    assert jaccard_join.least_apart(b"", jaccard_join.bucket_counts(a)) == 0


def test_regions_of_one_set_are_dropped_before_they_are_joined(spark, monkeypatch):
    # a bitmap that is full says maybe of everything: the second pass then lists all regions
    from tidemark.llm import jaccard_join as J

    rows = [(i, " ".join(f"w{i // 2}x{j}" if j != 3 or i % 2 else "other" for j in range(30))) for i in range(40)] + [(100, rows_of := "a b c d e f g h"), (101, rows_of)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = J.shingle_sets(docs)
    vertices = sets.where("set_hash is not null").groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"))
    wide = {tuple(r) for r in J.shared_regions(docs, vertices, J.K_WORDS, J.PERCENT).collect()}
    monkeypatch.setattr(J, "REGION_BITS", (6, 6))
    names, joined, real = [], [], J.keep
    monkeypatch.setattr(J, "keep", lambda df, name: (names.append(name), joined.append(df), real(df, name))[-1])
    full = {tuple(r) for r in J.shared_regions(docs, vertices, J.K_WORDS, J.PERCENT).collect()}
    brute = {}
    for r in J.first_regions(docs, J.shingle_rarity(docs)).distinct().join(vertices, "set_hash").collect():
        brute.setdefault(r.region, set()).add((r.id, r.n))
    want = {(region, i, n, len(of)) for region, of in brute.items() for i, n in of if len(of) > 1}
    assert full == wide == want and want
    assert names == ["several", "cells"]  # regions of one set are not written
