"""The stages of the pipeline and its whole run on rows of all kinds: none is lost or changed but by what the stage is for."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from closetlake.llm import jaccard_join, langid, mixing, sharding, tiling
from closetlake.llm.common import hidden, prepare
from tests.llm import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "_key", "_leaks", "_judged", "key", "node", "mark", "copies", "ambiguous", "Number"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` double" for c in COLUMNS[5:])
TEXTS = {
    "rain": "the rain in the valley falls on the fields and the rivers rise until the bridges close for the night",
    "wind": "a cold wind came over the hills and the people of the village stayed at home with their books",
    "bread": "das Brot vom Bäcker an der Ecke schmeckt am Morgen besser als das Brot aus dem großen Laden",
    "near": "the rain in the valley falls on the fields and the rivers rise until the bridges close for the day",
}


def row(doc_id, text, lang="en", source="a", mark=1.0):
    return (doc_id, text, lang, source, 5, *[mark + k for k in range(len(COLUMNS) - 5)])


ROWS = [
    row(1, TEXTS["rain"]), row(2, TEXTS["near"]), row(2, TEXTS["wind"]), row(3, TEXTS["wind"] + " again"), row(3, TEXTS["bread"], "de"), row(3, TEXTS["bread"], "de"),
    row(4, None), row(4, ""), row(None, TEXTS["rain"]), row(None, None), row(5, "12 34"), row(6, "zwei Wörter", "de", None), row(6, "zwei Wörter", "de", None, 2.0), row(7, "x" * 50_000, None, "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return prepare(spark).createDataFrame(ROWS, SCHEMA)


def rows_of(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


def test_names_are_hidden_in_any_case(spark, docs):
    assert hidden(docs, "key", "number", "other", "other") == ["_" * 2 + "key", "_number", "other", "_other"]


def test_language_keeps_values(docs):
    got = rows_of(langid.keep_known(docs))
    assert set(got) <= set(ROWS) and got[ROWS[0]] == 1 and got[ROWS[4]] == 2
    assert not any(r[1] is None or not any(c.isalpha() for c in r[1]) for r in got)


def test_one_of_each_group_by_id_and_text(docs):
    got = rows_of(jaccard_join.keep_one(docs, 3, 80, 100))
    # 1 and the near row of 2 are a group, the other row of 2 and that of 3 too; wordless rows of an id are one.
    assert {r[:2] for r in got} == {(1, TEXTS["rain"]), (2, TEXTS["wind"]), (3, TEXTS["bread"]), (None, TEXTS["rain"]), (None, None), (5, "12 34"), (6, "zwei Wörter"), (7, "x" * 50_000), *(r[:2] for r in got if r[0] == 4)}
    assert set(got) <= set(ROWS) and set(got.values()) == {1} and len(got) == 9
    assert rows_of(jaccard_join.keep_one(docs.union(docs), 3, 80, 100)).keys() == got.keys()


def test_thresholds_of_a_half_are_refused(docs):
    for times in (30, 50, 101):
        with pytest.raises(ValueError):
            jaccard_join.groups(docs, 3, times, 100)


def test_low_thresholds_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RARE", 2)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, times in ((1, 51), (1, 67), (2, 60)):
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.groups(frame, size, times, 100).collect()}
        assert got == brute.connected({i: set(brute.shingles(t, size)) for i, t in enumerate(texts)}, times, 100)


def test_clean_rows_keep_values(spark, docs):
    bench = spark.createDataFrame([(1, TEXTS["bread"]), (None, None), (2, "")], "item_id long, text string")
    assert rows_of(tiling.keep_clean(docs, bench)) == Counter(r for r in ROWS if r[1] != TEXTS["bread"])
    assert rows_of(tiling.keep_clean(docs, bench.limit(0))) == Counter(ROWS)


def test_mix_deals_copies_exactly(spark, docs):
    many = docs.union(docs.filter("doc_id = 3")).union(docs.filter("doc_id = 6"))
    taken = Counter()
    for r in mixing.mixed(many).collect():
        taken[r["key"], r["source"]] += int(r["taken"] / max(1, r["size"]) + 0.5)
    keys = {tuple(r[:-1]): r[-1] for r in many.select(*COLUMNS, mixing.shuffle_key()).collect()}
    got = rows_of(mixing.mix_rows(many))
    assert set(got) <= set(ROWS)
    per_key = Counter()
    for r, n in got.items():
        per_key[keys[r], r[3]] += n
    assert per_key == Counter({k: n for k, n in taken.items() if n})


def test_uneven_copies(spark, monkeypatch):
    rows = [(1, "a b c", "s", float(k // 2)) for k in range(7)] + [(2, "x " * 40, "s", 0.0)]
    docs = prepare(spark).createDataFrame(rows, "doc_id long, text string, source string, _key double")
    for share in (0.6, 0.9, 1.3):
        taken = sum(int(r["taken"] / r["size"] + 0.5) for r in mixing.mixed(docs, share=share).collect() if r["doc_id"] == 1)
        got = Counter(tuple(r) for r in mixing.mix_rows(docs, share=share).filter("doc_id = 1").collect())
        assert sum(got.values()) == taken
        each = [got[r] / n for r, n in Counter(rows[:7]).items()]
        assert not each or max(each) - min(each) <= 1


def test_shards_keep_values(docs):
    out = sharding.assign(docs, 60)
    assert Counter(tuple(r) for r in out.select(*COLUMNS).collect()) == Counter(ROWS)


def test_repeated_ids_do_not_crowd_out_a_language(spark):
    rows = [(7, "la pluie tombe sur les champs et la rivière monte", "fr")] * 3000 + [(k, "der Regen fällt auf die Felder und der Fluss steigt", "de") for k in range(2000)]
    model = langid.fit(prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "fr"]


def test_whole_run(spark, docs, tmp_path):
    bench = spark.createDataFrame([(1, TEXTS["bread"])], "item_id long, text string")
    docs.write.parquet(str(tmp_path / "a/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    for name in "ab":
        bench.write.parquet(str(tmp_path / f"{name}/benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a"))
    assert got.columns == [*COLUMNS, "shard", "shard_bytes", "shard_rows", "oversized"]
    rows = {tuple(r)[: len(COLUMNS)] for r in got.collect()}
    assert rows and rows <= set(ROWS) and all(r[1] and r[1] != TEXTS["bread"] for r in rows)
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
