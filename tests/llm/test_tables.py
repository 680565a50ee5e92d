"""Token counts, license scans and URL filters against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import catalog, licenses, token_counts, url_filter

from .util import ODD, docs, empty, prose


# --- token counts -------------------------------------------------------------


def rows_of(df):
    return {tuple(r) for r in df.select("source", "lang", "version", "docs", "tokens", "chars").collect()}


def test_batch_ids_of_any_characters(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", 5, 20)], "source string, lang string, old long, chars long")
    rollup = token_counts.Rollup(spark, f"{tmp_path}/r")
    ids = ["a/b", "a", "2024-01-01T00:00", "x%2Fy", "*?[é]{ }", ".."]
    for batch in ids:
        assert rollup.commit(batch, token_counts.inserted(rows, "old", "v1"))
        assert not rollup.commit(batch, token_counts.inserted(rows, "old", "v1"))
    assert rollup.committed() == sorted(ids)
    assert rows_of(rollup.totals()) == {("s", "en", "v1", 6, 30, 120)}
    rollup.compact()
    assert rollup.commit("b/c", token_counts.inserted(rows, "old", "v1"))
    assert rows_of(rollup.totals()) == {("s", "en", "v1", 7, 35, 140)}


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", 5, 20, 7), ("s", "en", 3, 9, 3), (None, "de", 0, 0, 0), ("t", None, 2, 4, 2)], "source string, lang string, old long, chars long, new long")
    rollup = token_counts.Rollup(spark, f"{tmp_path}/r")
    assert rollup.committed() == [] and rollup.totals().count() == 0
    assert rollup.commit("a", token_counts.inserted(rows, "old", "v1"))
    once = rows_of(rollup.totals())
    assert once == {("s", "en", "v1", 2, 8, 29), (None, "de", "v1", 1, 0, 0), ("t", None, "v1", 1, 2, 4)}
    assert not rollup.commit("a", token_counts.inserted(rows, "old", "v1"))
    assert rows_of(rollup.totals()) == once
    move = token_counts.revised(rows.where("source = 's'"), ("old", "v1"), ("new", "v2"))
    assert rollup.commit("b", move) and not rollup.commit("b", move)
    assert rows_of(rollup.totals()) == {("s", "en", "v2", 2, 10, 29), (None, "de", "v1", 1, 0, 0), ("t", None, "v1", 1, 2, 4)}
    assert rollup.commit("c", token_counts.deleted(rows.where("source is null"), "old", "v1"))
    assert rollup.commit("d", token_counts.inserted(rows.limit(0), "old", "v1"))
    assert rollup.committed() == ["a", "b", "c", "d"]
    assert len(rows_of(rollup.totals())) == 2
    whole = rows_of(rollup.totals())
    rollup.compact()
    assert rows_of(rollup.totals()) == whole and len(rollup.totals().inputFiles()) < 4
    assert rollup.commit("e", token_counts.inserted(rows, "old", "v1")) and not rollup.commit("a", move)
    assert rollup.commit("f", token_counts.deleted(rows, "old", "v1")) and rows_of(rollup.totals()) == whole
    for name in ("e", "f"):
        (tmp_path / f"r/batches/batch-{name}/_SUCCESS").unlink()
    # an attempt that broke off has no mark: it does not count, and is replaced
    import shutil

    shutil.rmtree(tmp_path / "r/snapshots")
    (tmp_path / "r/batches/batch-b/_SUCCESS").unlink()
    assert rollup.committed() == ["a", "c", "d"]
    assert rollup.commit("b", move)
    assert len(rows_of(rollup.totals())) == 2


def test_token_counts_query(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet").collect()
    seen, want = set(), Counter()
    for r in sorted(d, key=lambda r: r.doc_id):
        if r.text in seen:
            continue
        seen.add(r.text)
        v, p = ("words-1", r"[^\x20\x09-\x0D]+") if r.lang == "en" else ("pieces-1", r"[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]")
        want[r.source, r.lang, v, "docs"] += 1
        want[r.source, r.lang, v, "tokens"] += len(re.findall(p, r.text))
    got = rows_of(catalog.op4_token_counts(spark, sf))
    assert {(s, la, v): (n, t) for s, la, v, n, t, _ in got} == {k[:3]: (want[*k[:3], "docs"], want[*k[:3], "tokens"]) for k in want}
    docs(spark, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    assert sum(r[3] for r in rows_of(catalog.op4_token_counts(spark, str(tmp_path)))) == len(set(t or "" for t in ODD))


# --- licenses -----------------------------------------------------------------


def test_licenses_found_anywhere(spark):
    notices = [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts]
    texts, want = [*ODD, prose(300, 1)], set()
    for i, (name, notice) in enumerate(notices):
        for shift in range(0, 20, 3):
            want.add((len(texts), name, shift))
            texts.append(" ".join(x for x in (prose(shift, i), notice.upper() if i % 2 else notice, prose(30, i + 50)) if x))
    got = licenses.scan_licenses(docs(spark, texts).withColumn("license", F.lit("x"))).collect()
    assert {(r.doc_id, r.license, r.start) for r in got} == want
    assert all(r.containment == 1.0 for r in got)
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_license_with_a_replaced_word_and_twice(spark):
    long = licenses.TEMPLATES["BSD-3-Clause"][0]
    changed = long.replace("permitted", "allowed")
    broken = " ".join(long.split()[:8])
    mit = licenses.TEMPLATES["MIT"][0]
    got = licenses.scan_licenses(docs(spark, [changed, broken, mit + " " + prose(60, 3) + " " + mit])).collect()
    assert [(r.doc_id, r.license) for r in got if r.doc_id < 2] == [(0, "BSD-3-Clause")]
    assert sorted(r.start for r in got if r.doc_id == 2) == [0, 65]


@pytest.mark.parametrize("gap", [0, 1, 2, 3, 7])
def test_short_notices_close_together(spark, gap):
    mit, cc = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["CC-BY-NC-4.0"][0]
    between = [prose(gap, i) for i in range(20)]
    texts = [" ".join(x for g in between for x in (notice, g) if x) for notice in (mit, cc)]
    got = licenses.scan_licenses(docs(spark, texts)).collect()
    for i, notice in enumerate((mit, cc)):
        n = len("".join(c if c.isalnum() else " " for c in notice).split())
        assert [r.start for r in got if r.doc_id == i] == [j * (n + gap) for j in range(20)]


def test_license_query_against_lines(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {(r.doc_id, n) for r in d for n, ts in licenses.TEMPLATES.items() for t in ts if t in r.text}
    assert want and {(r.doc_id, r.license) for r in catalog.op5_licenses(spark, sf).collect()} == want


def test_bands_follow_from_containment():
    words = prose(1000, 9).split()
    notice = " ".join(words[:40])  # pieces of seven and eight shingles
    index = licenses.Index({"x": [notice]}, 0.999, 0.8)
    assert (1 - licenses.least_likeness(8, 0.8)) ** index.bands <= 0.001 < licenses.Index({"x": [notice]}, 0.9, 0.8).bands
    assert licenses.Index({"x": [notice]}, 0.999, 0.5).bands > index.bands
    found = 0
    for i in range(300):  # two replaced words take six of 38 shingles
        changed = list(words[:40])
        for j in np.random.default_rng(i).choice([3, 9, 15, 21, 27, 33], 2, replace=False):
            changed[j] = f"other{i}"
        text = " ".join([*prose(i % 17, i).split(), *changed, *prose(30, i + 900).split()]).encode()
        shingles = licenses.located_shingles(np.array([0, len(text)]), np.frombuffer(text, np.uint8))
        found += bool(index.matches(*shingles, 0.8))
    assert found >= 299


def test_a_match_put_out_puts_out_nothing():
    chain = [(0, "A", 0, 10, 1.0), (0, "B", 8, 10, 0.9), (0, "C", 16, 10, 0.85), (1, "B", 8, 10, 0.9), (2, "A", 0, 10, 0.9), (2, "B", 5, 10, 0.9), (2, "A", 9, 10, 0.8)]
    assert licenses._clearest(chain) == [chain[0], chain[2], chain[3], chain[4], chain[5]]
    rng = np.random.default_rng(4)
    rows = sorted({(0, "ABC"[rng.integers(3)], int(rng.integers(0, 300)), int(rng.integers(5, 30)), float(rng.integers(80, 90)) / 100) for _ in range(150)}, key=lambda x: (x[0], x[2], x[1]))
    kept = []
    for r in sorted(rows, key=lambda x: -x[4]):
        if not any(q[1] != r[1] and q[4] > r[4] and q[2] < r[2] + r[3] and r[2] < q[2] + q[3] for q in kept):
            kept.append(r)
    assert sorted(licenses._clearest(rows)) == sorted(kept)


def test_a_whole_license_text_in_a_long_document(spark):
    whole = prose(1200, 77)
    texts = [f"{prose(3000, 1)} {whole} {prose(20000, 2)}", f"{prose(50, 3)} {' '.join(whole.split()[:700])}", whole]
    got = licenses.scan_licenses(docs(spark, texts), {"own": [whole]}).collect()
    assert sorted((r.doc_id, r.start, r.n_words, r.containment) for r in got) == [(0, 3000, 1200, 1.0), (2, 0, 1200, 1.0)]


def test_nearly_equal_notices_give_the_clearest(spark):
    three = {n: licenses.TEMPLATES[n][-1] for n in ("AGPL-3.0", "GPL-3.0", "LGPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0")}
    got = licenses.scan_licenses(docs(spark, [f"{prose(9, 1)} {t} {prose(9, 2)}" for t in three.values()])).collect()
    assert [(r.doc_id, r.license, r.containment) for r in sorted(got)] == [(i, n, 1.0) for i, n in enumerate(three)]


# --- URL filter ---------------------------------------------------------------


def brute_rule(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for name, prefix, said in url_filter.RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(prefix):
            if best is None or len(name + prefix) > len(best[0]):
                best = (name + prefix, said)
    return host, path, *(best or (None, None))


URLS = [None, "", "no scheme", "http://", "HTTPS://A.Example.COM/en/71?x=1#y", "http://example.com/en/7", "http://notexample.com/en/7", "x://y://com/en/", "http://com/en/", "http://a.net/de/8", "http://b.example.net/de/8#", "http://ÄB.org/es/\nq", "http://a.org?q=/es/", "http://a.org/es", "http://u.info/" + "9" * 500]


def test_url_rules_and_verdicts(spark, sf):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    pages = pages.unionByName(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", F.lit("clash").alias("host")))
    got = url_filter.judge_urls(pages, trees=3).collect()
    assert len(got) == pages.count()
    by = defaultdict(set)
    for r in got:
        host, path, rule, said = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r
        assert r.verdict in ("allow", "block") and (said is None or r.verdict == said)
        by[r.url].add(r.verdict)
    assert all(len(v) == 1 for v in by.values())
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    one = url_filter.judge_urls(pages.where("url like '%com/en/1%'")).select("score").distinct().collect()
    assert len(one) == 1 and one[0].score > 0.5


def test_trees_learn_the_labels(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = url_filter.judge_urls(pages.select("page_id", "url")).where("rule is not null")
    right = got.agg(F.avg(((F.col("score") >= 0.5) == (F.col("verdict") == "block")).cast("double"))).first()[0]
    assert right > 0.9


def test_suffix_rates_leave_out_the_own_fold(spark):
    counts = spark.createDataFrame([("com", 0, 3.0, 4), ("com", 1, 1.0, 2), ("one", 2, 5.0, 5)], "suffix string, fold int, s double, n long")
    got = {(r.suffix, r.fold): r.suffix_rate for r in url_filter.suffix_rates_of_others(counts, 0.5).collect()}
    assert got == {("com", 0): (1 + 5) / (2 + 10), ("com", 1): (3 + 5) / (4 + 10), ("one", 2): 0.5}
    whole = {r.suffix: r.suffix_rate for r in url_filter.suffix_rates(counts, 0.5).collect()}
    assert whole == {"com": (4 + 5) / (6 + 10), "one": 10 / 15}


def test_copies_of_a_url_do_not_fill_the_sample(spark):
    rows = [(i, "http://com/en/1") for i in range(500)] + [(1000 + i, f"http://a{i}.net/de/{i}") for i in range(40)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), most=30, trees=3)
    assert got.select("score").distinct().count() > 1
    assert got.where("verdict = 'block'").count() == 500
