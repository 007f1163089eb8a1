"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, skew."""

import random
import time

import pytest

from closetlake.llm import crf, fingerprints, jaccard_join, langid, licenses, mixing, quality, sharding, tiling, toxicity, url_filter
from closetlake.llm.common import prepare
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label string, size string, key string, shard int, taken int, node string, component_id string, fingerprint string, rule string, labels string"
LONG = "Lorem ipsum dolor sit amet. " * 12_000


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None, 7.0, "x", "x", "x", 3, 4, "x", "x", "x", "x", "x")


ROWS = [
    row(None, "an orphan text of a few words"), row(1, None), row(2, ""), row(3, " \n\t "), row(4, "a"), row(5, LONG, "la"), row(6, "twice the same row here"),
    row(6, "twice the same row here"), row(7, "das ist ein deutscher Satz über nichts", "de", None), row(8, "12 34 !!", None, "b"), row(9, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return prepare(spark).createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return prepare(spark).createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language(docs, none):
    rows = by_id(langid.identify(docs))
    assert len(rows) == 10 and {rows[i]["lang_pred"] for i in (1, 2, 3, 8, 9)} == {"und"} and rows[1]["score"] == 0
    assert rows[5]["lang_pred"] == "la" and rows[7]["lang_pred"] == "de"
    assert sorted(r["doc_id"] or 0 for r in langid.keep_known(docs).collect()) == [0, 4, 5, 6, 6, 7]
    assert langid.keep_known(docs).columns == docs.columns
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}


def test_language_of_blocks_equals_whole(monkeypatch):
    text = "über Straße, naïve fiancée " * 50
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert (langid.gram_counts(text) == whole).all()


def test_many_languages_have_distinct_codes():
    code = langid.codewords(20)
    assert len({tuple(r) for r in code}) == 20 and (abs(code.sum(axis=0)) < 20).all()


def test_mixing(docs, none):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert sum(r["taken"] for r in rows) == int(1.5 * sum(r["size"] for r in rows))
    assert mixing.mix_rows(docs).columns == docs.columns
    assert mixing.mixed(none).count() == 0 and mixing.mix_rows(none).count() == 0


def test_targets_share_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got == {"a": 20.0, "b": 200.0, None: 1445.0}


def test_tiling(docs, none, spark, monkeypatch):
    words = [f"w{k}" for k in range(20)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, ""), (4, "tiny item"), (5, " ".join(words)), (5, " ".join(words))], "item_id long, text string")
    turned = " ".join(words[10:] + ["and"] + words[:10])
    mine = spark.createDataFrame([row(1, turned), row(2, "nothing of it"), row(3, "A TINY, item!"), row(4, " ".join(words[:11])), row(5, " ".join(words * 500)), row(6, None)], SCHEMA)
    found = {(r["doc_id"], r["item_id"]): r for r in tiling.matches(mine, bench).collect()}
    assert set(found) == {(1, 1), (1, 5), (3, 4), (5, 1), (5, 5)}
    assert found[1, 1]["reordered"] and found[1, 1]["n_tiles"] == 2 and found[1, 1]["coverage"] == 1.0
    assert [tuple(s) for s in found[1, 1]["spans"]] == [(0, 9), (11, 20)]
    assert sorted(r["doc_id"] for r in tiling.keep_clean(mine, bench).collect()) == [2, 4, 6]
    monkeypatch.setattr(tiling, "FILTER_WORDS", 1)  # nearly every seed passes
    assert {(r["doc_id"], r["item_id"]) for r in tiling.matches(mine, bench).collect()} == set(found)
    assert tiling.matches(none, bench).count() == 0
    assert tiling.keep_clean(docs, bench.limit(0)).count() == len(ROWS)


def test_tiling_of_other_scripts(spark):
    bench = spark.createDataFrame([(1, "один два три четыре пять шесть"), (2, "?!")], "item_id long, text string")
    mine = spark.createDataFrame([row(1, "Вот: один два три четыре пять шесть."), row(2, "?!"), row(3, "один два три")], SCHEMA)
    assert [r["doc_id"] for r in tiling.matches(mine, bench).collect()] == [1]


def test_tiles_of_long_texts():
    rng = random.Random(8)
    words = [rng.randint(1, 5000) for _ in range(20_000)]
    cut = [w for k in range(0, 20_000, 20) for w in (*words[k: k + 19], 9999)]
    begun = time.time()
    assert sum(n for _, _, n in tiling.tiles(words, cut)) == 19_000
    shuffled = [words[k: k + n] for k, n in ((k, 7 + k % 90) for k in range(0, 19_900, 100))]
    assert sum(n for _, _, n in tiling.tiles(words, [w for part in reversed(shuffled) for w in (*part, 0)])) >= sum(map(len, shuffled))
    assert tiling.tiles([1] * 20_000, [1] * 20_000) == [(0, 0, 20_000)]
    assert sum(n for _, _, n in tiling.tiles([1] * 20_000, ([1] * 150 + [0]) * 130)) == 130 * 150
    assert time.time() - begun < 30


def test_one_python_step_whatever_the_number_of_items(spark, docs):
    bench = spark.createDataFrame([(k, f"item {k} of many with words {k * 7} and {k * 11} more") for k in range(300)], "item_id long, text string")
    plan = tiling.keep_clean(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan  # the texts were judged once, before
    own = docs.withColumnRenamed("key", "item_words")
    assert tiling.keep_clean(docs, bench).columns == docs.columns and "their_key" not in tiling.matches(own, bench).columns
    kept = tiling.keep_clean(docs.withColumn("their_key", docs["key"]), bench).collect()
    assert len(kept) == len(ROWS) and all(r["key"] == r["their_key"] == "x" for r in kept)


def test_tiles_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        item, doc = ([rng.choice("abcd") for _ in range(rng.randint(1, 25))] for _ in range(2))
        number = {w: k + 1 for k, w in enumerate(sorted(set(item)))}
        got = sum(n for _, _, n in tiling.tiles([number[w] for w in item], [number.get(w, 0) for w in doc], 3))
        assert got == brute.tiled(item, doc, 3)


def labelled(spark):
    rng = random.Random(1)
    clean = ["house", "garden", "river", "stone", "walks", "over", "green", "light"]
    docs, labels = [], []
    for i in range(80):
        bad = i % 4 == 0
        lines = [" ".join(rng.choice(clean) for _ in range(8)) for _ in range(6)]
        if bad:
            lines = [x + " vileword " + x for x in lines] + ["BUY!! BUY!! BUY!! NOW!!"] * 5
        docs.append(row(100 + i, "\n".join(lines)))
        labels.append((100 + i, 0 if bad else 1, 1 if bad else 0))
    return spark.createDataFrame(docs + ROWS, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (1, None, None), (777, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_and_toxicity(spark, none):
    docs, labels = labelled(spark)
    for module, good in ((quality, lambda i: i % 4 != 0), (toxicity, lambda i: i % 4 == 0)):
        rows = module.scored(docs, module.fit(docs, labels)).collect()
        assert len(rows) == 80 + len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
        score = {r["doc_id"]: r["score"] for r in rows}
        assert all((score[100 + i] > 0.5) == good(i) for i in range(80))
        assert score[1] == score[2] == score[9]
        assert module.scored(none, module.fit(none, labels.limit(0))).count() == 0
        assert {r["score"] for r in module.scored(docs, module.fit(docs, labels.limit(0))).collect()} == {0.5}
    marked = [r for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect() if r["doc_id"] == 100][0]
    assert marked["spans"] and {w.strip("!") for s in marked["spans"] for w in marked["text"][s["start"]: s["end"]].split()} <= {"vileword", "BUY", "NOW"}


def test_spans_count_code_points():
    found = toxicity.read(["é ß\n\nwörter hier", None, "", "über"])
    assert [("é ß\n\nwörter hier")[a:b] for a, b in zip(found.first[:4], found.last[:4], strict=True)] == ["é", "ß", "wörter", "hier"]
    assert (found.first[4], found.last[4]) == (0, 4) and list(found.counts) == [4, 0, 0, 1]


def test_marginals_against_enumeration():
    import itertools
    import math

    import numpy as np
    evidence, trans, lengths = np.array([0.3, -1.0, 2.0, 0.7, -0.2]), np.array([[0.5, -0.4], [0.1, 0.9]]), np.array([3, 0, 2])
    one, pairs = crf.marginals(evidence, lengths, trans)
    want, count, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        total, p = 0.0, np.zeros(n)
        c = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = math.exp(sum(evidence[at + k] * y[k] for k in range(n)) + sum(trans[y[k], y[k + 1]] for k in range(n - 1)))
            total += w
            p += w * np.array(y, dtype=float)
            for k in range(n - 1):
                c[y[k], y[k + 1]] += w
        want.extend(p / total)
        count += c / total
        at += n
    assert np.allclose(one, want) and np.allclose(pairs, count)


def test_licenses(docs, none, spark):
    cases = {
        1: ("GNU General Public License or the Apache-License", 2, 0, 6, "apache,gpl", "apache,gpl"),
        2: ("x\nSPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause */", 0, None, None, "", "bsd,gpl,mit"),
        3: ("SPDX-License-Identifier: (MIT OR", 0, None, None, "", ""),
        4: ("cc by cc by MIT license", 3, 0, 4, "cc-by,mit", "cc-by,mit"),
        5: ("committed license", 0, None, None, "", ""),
        6: (None, 0, None, None, "", ""),
    }
    rows = by_id(licenses.scanned(spark.createDataFrame([row(i, c[0]) for i, c in cases.items()], SCHEMA)))
    for i, (_, n, first, last, base, labels) in cases.items():
        r = rows[i]
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == (n, first, last, base, labels), i
    assert rows[2]["permissive"] is True and rows[2]["expressions"] == ["MIT GPL-2.0-only Classpath-exception-2.0 WITH OR BSD-3-Clause AND"]
    assert rows[6]["n_words"] == 0 and rows[6]["score"] == 0
    assert licenses.scanned(docs).count() == len(ROWS) and licenses.scanned(none).count() == 0


def test_fingerprints(docs, none, spark, monkeypatch):
    rows = fingerprints.fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    twice = [r for r in rows if r["doc_id"] == 6]
    assert len({r["fingerprint"] for r in twice}) == 1
    empty = [r for r in rows if r["doc_id"] in (1, 2, 3, 9)]
    assert {r["fingerprint"] for r in empty} == {""}
    assert fingerprints.fingerprints(none).count() == 0
    monkeypatch.setattr(fingerprints, "BUCKET_CHARS", 1)
    again = fingerprints.fingerprints(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    alone = fingerprints.fingerprints(spark.createDataFrame([row(None, "one two three four five six")], SCHEMA)).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_sharding(docs, none):
    rows = sharding.assign(docs, 100).collect()
    assert len(rows) == len(ROWS) and all(not r["oversized"] for r in rows if r["doc_id"] not in (5,))
    assert by_id(sharding.assign(docs, 100))[5]["oversized"]
    assert set(sharding.assign(docs).columns) == set(docs.columns) | {"shard", "shard_bytes", "shard_rows", "oversized"}
    assert sharding.assign(none).count() == 0
    same = sharding.assign(docs.filter("doc_id = 6").unionAll(docs.filter("doc_id = 6")), 30).collect()
    assert len(same) == 4 and {r["oversized"] for r in same} == {True}  # equal rows cannot be told apart


def test_jaccard_cases(docs, none):
    rows = jaccard_join.groups(docs).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (1, 4) and got[6] == (3, 6)
    assert jaccard_join.groups(none).count() == 0 and jaccard_join.keep_one(none).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("size, times, words", [(3, 90, 60), (5, 80, 60), (3, 90, 900)])
def test_jaccard_group_of_near_copies(spark, size, times, words, monkeypatch):
    """A group far larger than RARE, edited in one to six places, some copies of copies, and unrelated texts."""
    rng = random.Random(words + size)
    vocabulary = [f"w{k}" for k in range(4000)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    texts = [base]
    for _ in range(70):
        copy = list(rng.choice(texts))
        for _ in range(rng.randint(1, max(1, words // 50))):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary[:50])
        texts.append(copy)
    texts += [[rng.choice(vocabulary) for _ in range(rng.randint(1, words))] for _ in range(60)] + [texts[3], texts[5]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "CHUNK", 500)
    monkeypatch.setattr(jaccard_join, "REMEMBERED", 3)
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.groups(docs, size, times, 100).collect()}
    prepare(spark)
    assert got == brute.connected({i: set(brute.shingles(" ".join(t), size)) for i, t in enumerate(texts)}, times, 100)


def test_a_token_of_all_sets_is_dealt_out(spark, monkeypatch):
    """One passage in every text: its tokens are known to be frequent, their rows spread evenly, and components are the same."""
    rng = random.Random(11)
    passage = " ".join(f"common{k}" for k in range(12))
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 300)) for _ in range(rng.randint(5, 40))) + " " + passage for _ in range(400)]
    texts += [t + " end" for t in texts[:60]] + texts[:5]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hot = jaccard_join.hot_tokens(prepare(spark).createDataFrame(docs.collect(), docs.schema), 3)
    assert hot.count() == 11  # the shingles within the passage, and the one at its end in some texts
    frame = spark.createDataFrame([(hot.first()["token"], k, 1) for k in range(2000)] + [(k, k, 1) for k in range(50)], "token long, node long, least int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = jaccard_join._spread(frame, hot).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in spread) == 2050 and max(r["count"] for r in spread) < 800
    want = brute.connected({i: set(brute.shingles(t, 3)) for i, t in enumerate(texts)}, 80, 100)
    for most in (100_000, 3, 0):
        monkeypatch.setattr(jaccard_join, "MOST_HOT", most)
        assert {r["doc_id"]: r["component_id"] for r in jaccard_join.groups(docs, 3, 80, 100).collect()} == want


def test_url_filter(spark):
    pages = [
        (1, "HTTP://A.Example.NET/en/x?q", "allow", "example.net/en/"), (2, "http://x.net", "allow", None), (3, "http://x.net/", "block", "net/"),
        (4, None, "allow", None), (5, "no scheme casino", "block", None), (6, "http://casinos.example.org/", "allow", None), (7, "http://free-bets.info/a", "block", None),
        (8, "http://free.free.info/free", "allow", None), (9, "http://b.org/fr/casino", "allow", "org/fr/"), (10, "", "allow", None), (3, "http://x.net/", "block", "net/"),
    ]
    frame = spark.createDataFrame([(i, u, "mine", "mine") for i, u, _, _ in pages], "page_id long, url string, verdict string, host string")
    rows = url_filter.judged(frame).collect()
    got = {r["page_id"]: (r["verdict"], r["rule"]) for r in rows}
    assert got == {i: (v, r) for i, _, v, r in pages} and len(rows) == len(pages)
    assert {r["page_id"]: (r["host"], r["path"]) for r in rows}[1] == ("a.example.net", "/en/x")
    assert url_filter.judged(frame.limit(0)).count() == 0
