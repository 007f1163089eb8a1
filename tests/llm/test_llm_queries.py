"""The registered queries on the driver's tables: against SQL where it exists, against brute force elsewhere."""

import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from closetlake.llm import fingerprints, jaccard_join, licenses, sharding, tiling
from closetlake.llm.registry import ORACLES, QUERIES
from tests.conftest import SF_DIR
from tests.llm import brute
from verification.compare import compare, connect


@pytest.fixture(scope="module")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    ok, message, _ = compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR)
    assert ok, message


def test_language_held_out(spark, documents):
    lang = {d["doc_id"]: d["lang"] for d in documents}
    rows = QUERIES["op2_language_id"](spark, SF_DIR).collect()
    assert len(rows) == len(documents)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_decontamination_finds_all_covered_items(spark, documents):
    items = {r["item_id"]: tiling.words_of(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    found = {(r["doc_id"], r["item_id"]): r["covered_words"] for r in QUERIES["op4_decontamination"](spark, SF_DIR).collect()}
    want = {}
    for d in documents:
        words = tiling.words_of(d["text"])
        grams = {tuple(words[k: k + 5]) for k in range(len(words) - 4)}
        for i, item in items.items():
            if any(tuple(item[k: k + 5]) in grams for k in range(len(item) - 4)):
                covered = brute.tiled(item, words)
                if covered >= tiling.THRESHOLD * len(item):
                    want[d["doc_id"], i] = covered
    assert found == want and found


@pytest.mark.parametrize("name, label, mod, fold", [("op5_quality", "quality", 4, 2), ("op6_toxicity", "toxic", 5, 0)])
def test_classifiers_held_out(spark, documents, name, label, mod, fold):
    big = SF_DIR.replace("0.001", "0.1")
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    rows = QUERIES[name](spark, big).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % mod == fold) == r["held_out"] for r in rows)
    assert np.mean([labels[r["doc_id"]] == r["predicted"] for r in held]) > 0.93
    # Of either label most are found, not only the frequent one.
    for value in (0, 1):
        own = [r["predicted"] == value for r in held if labels[r["doc_id"]] == value]
        assert len(own) > 10 and np.mean(own) > 0.9, (value, np.mean(own))
    again = {r["doc_id"]: r["score"] for r in QUERIES[name](spark, big).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)


def test_license_scan(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op7_license_scan"](spark, SF_DIR).collect()}
    for d in documents:
        n, places, labels = brute.license_places(d["text"])
        r = rows[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(places), ",".join(sorted(labels)))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))


def test_fingerprints(spark, documents, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_CHARS", 40_000)  # several buckets
    rows = {r["doc_id"]: r for r in QUERIES["op8_fingerprints"](spark, SF_DIR).collect()}
    ordered, errors = sorted(documents, key=lambda d: -d["doc_id"]), []
    for k, d in enumerate(ordered):
        text, after = d["text"], ordered[(k + 1) % len(ordered)]["text"]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[d["doc_id"]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == brute.fingerprint(text) and r["edited_fingerprint"] == brute.fingerprint(edited)
        own = set(brute.shingles(text, 5, False))
        for near, other in ((r["near_edited"], edited), (r["near_next"], after)):
            b = set(brute.shingles(other, 5, False))
            assert 0 <= near <= 1 and (text != other or near == 1 or not own)
            if min(len(own), len(b)) > 60:
                errors.append(near - len(own & b) / len(own | b))
    assert len(errors) > 200 and max(map(abs, errors)) < 0.25 and np.std(errors) < 0.06


def test_sharding(spark, documents):
    keyed = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", sharding.key_bits().alias("k"), sharding.text_bytes().alias("b")).collect()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for limit in (30_000, 5_000):
        got = {r["doc_id"]: r for r in sharding.assign(docs, limit).collect()}
        want = brute.extendible({r["doc_id"]: (r["k"], r["b"]) for r in keyed}, limit)
        assert {i: r["shard"] for i, r in got.items()} == want
        assert all(r["oversized"] == (r["shard_bytes"] > limit) and (not r["oversized"] or r["shard_rows"] == 1) for r in got.values())
    assert QUERIES["op9_sharding"](spark, SF_DIR).count() == len(documents)


def test_jaccard_join(spark, documents):
    rows = {r["doc_id"]: r for r in QUERIES["op10_jaccard_join"](spark, SF_DIR).collect()}
    sets = {d["doc_id"]: set(brute.shingles(d["text"], 3)) for d in documents}
    want = brute.connected(sets, 90, 100)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in rows.items()} == {i: (len(s), want[i]) for i, s in sets.items()}


def test_pipeline(spark, documents, tmp_path):
    docs, before = spark.read.parquet(f"{SF_DIR}/documents.parquet"), documents
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = [r.asDict() for r in docs.collect()]
        if name != "sharding":
            assert set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        if name == "language_id":
            assert all(any(c.isalpha() for c in r["text"]) for r in rows) and len(rows) > 0.98 * len(before)
        if name == "jaccard_join":
            want = brute.connected({d["doc_id"]: set(brute.shingles(d["text"], 5)) for d in before}, 80, 100)
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, c in want.items() if i == c)
        if name == "decontamination":
            items = [tiling.words_of(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
            leaks = {d["doc_id"] for d in before for i in items if brute.tiled(i, tiling.words_of(d["text"])) >= 0.6 * len(i)}
            assert {r["doc_id"] for r in rows} == {d["doc_id"] for d in before} - leaks
        if name == "source_mixing":
            want = brute.mixed_copies(before)
            assert {i: n for i, n in want.items() if n} == {r["doc_id"]: [x["doc_id"] for x in rows].count(r["doc_id"]) for r in rows}
        if name == "sharding":
            assert len(rows) == len(before) and all(r["shard"] == "" for r in rows)
        before = rows
    assert corpus_pipeline.run(spark, SF_DIR).count() == len(before)
