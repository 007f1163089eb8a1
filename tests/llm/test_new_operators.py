"""Embedding near-duplicates, spelling variants and the prefix trie against plain versions."""

import random

import numpy as np
import pytest

from closetlake.llm import embedding_dedup, prefix_trie, spelling
from closetlake.llm.common import prepare, shared_folder
from closetlake.llm.registry import QUERIES
from tests.conftest import SF_DIR
from tests.llm import brute

# ---- embeddings

VECTORS = "vec_id long, embedding array<float>, label int, node string, cell long, n int, links int"


def vector(vec_id, embedding, label=1):
    return (vec_id, embedding, label, "x", 5, 6, 7)


def found_links(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_vectors_of_all_kinds(spark):
    rows = [
        vector(1, [1.0, 0.0]), vector(2, [2.0, 0.1]), vector(3, [1.0, 0.0], 2), vector(4, [1.0, 0.0], None), vector(5, None), vector(6, []), vector(7, [0.0, 0.0]),
        vector(8, [1.0, None]), vector(9, [1.0, float("nan")]), vector(10, [float("inf"), 1.0]), vector(11, [1.0, 0.0, 0.0]), vector(12, [0.0, 1.0]),
        vector(13, [1.0, 0.0]), vector(13, [1.0, -0.0]), vector(None, [1.0, 0.001]), vector(14, [1e30, 1e28]), vector(15, [1e-30, 0.0]),
    ]
    out = embedding_dedup.groups(prepare(spark).createDataFrame(rows, VECTORS))
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect()), key=str)
    near = [1, 2, 13, 13, None, 14, 15]
    want = [(i, len(near) - 1, 1, i == 1) for i in near] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert got == sorted(want, key=str)
    none = embedding_dedup.groups(spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and none.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert embedding_dedup.groups(spark.createDataFrame([vector(None, None), vector(4, [0.0])], VECTORS)).count() == 2


def planted(seed, n=400, d=24):
    """Vectors around some centres, of two labels; a third of all around one."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, d))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    which = np.where(np.arange(n) % 3 == 0, 0, rng.integers(0, 30, n))
    out = centres[which] + rng.choice([0.0, 0.1, 0.14, 0.2], n)[:, None] * rng.standard_normal((n, d)) / np.sqrt(d)
    return [(k * 3, [float(x) for x in np.float32(v)], int(which[k] % 2)) for k, v in enumerate(out)]


@pytest.mark.parametrize("block", [2048, 40])
def test_planted_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rows = planted(1)
    got = found_links(embedding_dedup.groups(prepare(spark).createDataFrame([vector(*r) for r in rows], VECTORS)))
    want = brute.vector_links([(r[1], r[2]) for r in rows], 0.98)
    links, found = sum(w[0] for w in want.values()), sum(g[0] for g in got.values())
    assert links > 5_000 and 0.97 * links <= found <= links
    assert all(got[r[0]][0] <= want[k][0] for k, r in enumerate(rows))
    assert np.mean([got[r[0]][1] == rows[want[k][1]][0] for k, r in enumerate(rows)]) > 0.97


def test_recall_at_the_threshold():
    """Pairs just above the cosine: the windows of the calibrated count keep nearly all, those of far vectors nearly none."""
    rng = np.random.default_rng(4)
    for d in (2, 16, 64, 300):
        own = embedding_dedup.Model(d, 6, 0.98)
        x = rng.standard_normal((3000, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.standard_normal((3000, d))
        y -= (x * y).sum(axis=1)[:, None] * x
        y = 0.98001 * x + np.sqrt(1 - 0.98001**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        label = np.ones(len(x), dtype=np.int64)
        met = (own.cells(x, label) == own.cells(y, label)).any(axis=1)
        counted = [sum(len(i) for i, _ in embedding_dedup.candidates(own.sketch(x[k: k + 1]), own.sketch(y[k: k + 1]), own.half, own.least)) for k in range(1000)]
        assert met.mean() > 0.975 and np.mean(counted) > 0.975
        if d > 2:
            sketch = own.sketch(x[:1000])
            pairs = sum(len(i) for i, _ in embedding_dedup.candidates(sketch, sketch, own.half, own.least)) - 1000
            assert pairs < 1000 * 1000 * 0.001


def test_embeddings_of_the_table(spark):
    rows = {r["vec_id"]: r for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    got = found_links(QUERIES["op11_embedding_dedup"](spark, SF_DIR))
    ids = sorted(rows)
    want = brute.vector_links([(rows[i]["embedding"], rows[i]["label"]) for i in ids], 0.98)
    assert got == {i: (want[k][0], ids[want[k][1]], want[k][1] == k) for k, i in enumerate(ids)}


# ---- spelling

TEXTS = "doc_id long, text string, word string, n int, length int, leaf string, id string"


def text(doc_id, body):
    return (doc_id, body, "x", 1, 2, "x", "x")


def spelled(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def misspelt(seed, n=60):
    """Words over few letters, so that near ones and anagrams abound; one very frequent."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(7, 9))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "ÀÖØöøÿ×", "straße", "kilogram"]
    return [text(k, " ".join(rng.choice(stems) for _ in range(40)) + " Kilogram kilogrem. " * (k % 3) + " kilogram" * 30) for k in range(n)]


@pytest.mark.parametrize("sizes", [(20_000, 160, 100_000, 20_000), (10, 3, 30, 7)])
def test_spelling(spark, monkeypatch, sizes):
    for name, value in zip(("LEAF", "BUCKET", "SAMPLE", "CHUNK"), sizes, strict=True):
        monkeypatch.setattr(spelling, name, value)
    rows = misspelt(2) + [text(None, "orphaned orphaned"), text(None, "orphanid orphanid"), text(500, None), text(501, ""), text(502, "x" * 9000 + " " + "x" * 9000), text(502, "x" * 9001), text(502, "x" * 9001)]
    docs = prepare(spark).createDataFrame(rows, TEXTS)
    want = brute.spelling_variants(brute.spelling_words([r[:2] for r in rows]))
    got = spelled(spelling.variants(spelling.vocabulary(docs)))
    assert got == want and any(w[1] for w in want) and len(want) > 40


def test_forms_are_followed_to_the_end(spark):
    n = {"aaaaaaaa": 1000, "aaaaaaab": 100, "aaaaaabb": 10, "aaaaabbb": 2, "zzzzzzz": 2, "zzzzzzzz": 20, "zzzzzzy": 20}
    frame = spark.createDataFrame([(w, k, len(w)) for w, k in n.items()], "word string, n long, length int")
    got = spelled(spelling.variants(frame))
    assert got == brute.spelling_variants(n)
    assert ("aaaaabbb", "aaaaaabb", "aaaaaaaa", 2, 1, 10) not in got  # ten times is not reached
    assert ("aaaaaabb", "aaaaaaab", "aaaaaaaa", 10, 2, 100) in got and ("zzzzzzz", "zzzzzzy", "zzzzzzy", 2, 2, 20) in got
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([], TEXTS))).count() == 0


def test_spelling_of_the_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    assert spelled(QUERIES["op12_spelling_variants"](spark, SF_DIR)) == brute.spelling_variants(brute.spelling_words([tuple(r) for r in docs]))


# ---- conversations

TURNS = "conv_id long, turn long, role string, text string, n int, key string, turns string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def node_rows(df):
    rows = [tuple(r) for r in df.select(*NODE).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def turn_rows(own):
    return [(c, k, r, t, 1, "x", "x") for c, turns in own.items() for k, (r, t) in enumerate(turns)]


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_prefix_trie(spark, partitions):
    rng = random.Random(5)
    own = {c: [(rng.choice("ua"), rng.choice(["é", "yes"])) for _ in range(rng.choice([1, 2, 3, 5, 12]))] for c in range(-3, 90)}
    own |= {c: [("u", "hot"), ("a", "start")] * 6 for c in range(100, 140)}  # a third are copies
    spark = prepare(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = node_rows(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(spark.createDataFrame(turn_rows(own), TURNS)))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # Spark's and SQL's remainder of a negative number is negative.
    base = {c: own.get(c - int(np.fmod(c, 5)), []) for c in own}
    built = {c: base[c][:h] + turns[h:] for c, turns in own.items() for h in [brute.zlib.crc32(str(c).encode()) % 9]}
    assert got == brute.trie(built)


def test_conversations_of_all_kinds(spark):
    # crc32("7") % 9 and crc32("8") % 9 decide what is taken from conversation 5.
    rows = [
        (5, 2, "u", "b"), (5, None, None, "first"), (5, 1, "a", None), (5, 1, "a", None), (None, 1, "u", "orphan"), (7, 1, None, None), (8, 1, "u", "x"), (8, 1, "u", "y"),
        (21, 1, "u", "long" * 100_000), (23, None, "u", ""),
    ]
    frame = spark.createDataFrame([(*r, 1, "x", "x") for r in rows], TURNS)
    own = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in prefix_trie.sequences(prepare(spark)
           .createDataFrame([(*r, 1, "x", "x") for r in rows], TURNS)).collect()}
    assert [t[1] for t in own[5]] == [5, 0, 0, 1] and set(own) == {5, 7, 8, 21, 23}
    plain = {5: [("", "first"), ("a", ""), ("a", ""), ("u", "b")], 7: [("", "")], 21: [("u", "long" * 100_000)], 23: [("u", "")]}
    # Equal turns of 8 have a fixed order.
    first = own[8][0] == prefix_trie.sequences(spark.createDataFrame([(8, 1, "u", "x", 1, "x", "x")], TURNS)).first()["turns"][0]
    plain[8] = [("u", "x"), ("u", "y")] if first else [("u", "y"), ("u", "x")]
    assert node_rows(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(frame)))) == brute.trie(brute.rebuilt(plain))
    empty = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(empty))).count() == 0


def test_turnless_conversations(spark):
    frame = spark.createDataFrame([(1, []), (2, [])], "conv_id long, turns array<struct<digest: string, bytes: int>>")
    assert node_rows(prefix_trie.trie(frame)) == brute.trie({1: [], 2: []})
    one = spark.createDataFrame([(1, []), (2, [("0" * 32, 3)])], frame.schema)
    assert node_rows(prefix_trie.trie(one)) == brute.trie({1: [], 2: [("u", "abc")]})


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master, applicationId = "spark://host", "x"

    class Session:
        conf, sparkContext = spark.conf, Context

    before = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) and spark.conf.get("spark.checkpoint.dir", None) == before
    if not before:
        with pytest.raises(ValueError):
            shared_folder(Session)
