"""Language, quality and toxicity of every document against plain versions of decoding and of forward-backward."""

import functools

import numpy as np
import pytest

from closetlake.llm import langid, licenses, quality, toxicity
from closetlake.llm.common import in_training, prepare
from closetlake.llm.hashing import mix, word_hashes
from closetlake.llm.registry import QUERIES
from tests.conftest import SF_DIR
from tests.llm import brute


@pytest.fixture(scope="module")
def documents(spark):
    return prepare(spark).read.parquet(f"{SF_DIR}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_language(spark, documents):
    model = langid.fit(documents.filter(in_training("doc_id", 4, 2)))

    @functools.cache
    def bucket_of(gram):
        return int(mix(np.array([gram], dtype=np.uint64))[0] % np.uint64(langid.BUCKETS))

    got = by_id(QUERIES["op2_language_id"](spark, SF_DIR))
    for d in documents.collect():
        language, score = brute.language_of(d["text"], model, bucket_of)
        assert got[d["doc_id"]]["lang_pred"] == language and abs(got[d["doc_id"]]["score"] - score) < 1e-4


def test_toxicity(spark, documents):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").filter(in_training("doc_id", 5, 0))
    model = toxicity.fit(documents.select("doc_id", "text"), labels)

    @functools.cache
    def hash_of(token):
        return tuple(word_hashes([token], bytes(range(256)), toxicity.PREFIXES)[0][:, 0].astype(np.uint32))

    got = by_id(QUERIES["op6_toxicity"](spark, SF_DIR))
    for d in documents.collect():
        score, spans, tagged = brute.toxic_text(d["text"], model, hash_of, toxicity.BUCKETS, toxicity.SEQUENCE)
        assert abs(got[d["doc_id"]]["score"] - score) < 1e-6
        if min((abs(p - 0.5) for p in tagged), default=1) > 1e-6:
            assert [tuple(s) for s in got[d["doc_id"]]["spans"]] == spans


def test_quality(spark, documents):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").filter(in_training("doc_id", 4, 2))
    model = quality.fit(documents.select("doc_id", "text"), labels)
    got = by_id(QUERIES["op5_quality"](spark, SF_DIR))
    for d in documents.collect():
        score, lines, bad = brute.quality_text(d["text"], model, quality.STEPS)
        r = got[d["doc_id"]]
        assert abs(r["score"] - score) < 1e-6 and (r["n_lines"], r["bad_lines"]) == (lines, bad)


def test_license_labels_of_the_table(spark, documents):
    """The base labels stay, further ones are the method's; everything found in the table is one of ``scan``'s."""
    machine = licenses._automaton()
    got = by_id(QUERIES["op7_license_scan"](spark, SF_DIR))
    for d in documents.collect():
        r, base = got[d["doc_id"]], brute.license_places(d["text"])[2]
        labels = set(filter(None, r["labels"].split(",")))
        assert base <= labels and r["labels"] == ",".join(sorted(labels)) and 0 <= r["score"] <= 1
        assert dict(zip(licenses._NAMES, licenses.scan(d["text"], machine), strict=True))["labels"] == r["labels"]
