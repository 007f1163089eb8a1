"""Reading, importing and writing."""

import json
import os

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from closetlake.operators import accounts, page_checks, writes
from closetlake.schemas import schema
from closetlake.sources import collections, sinks, wire
from tests.conftest import SF_DIR
from verification.registry import NOW, Tables


def test_missing_collection_is_empty(spark, tmp_path):
    df = collections.read_collection(spark, str(tmp_path / "none.parquet"), schema("coupons"))
    assert df.count() == 0 and df.schema == schema("coupons")


def test_json_collection_tolerates_missing_fields(spark, tmp_path):
    (tmp_path / "u.json").write_text('{"user_id":"a"}\n{"user_id":"b","subscription":{"plan":"premium"}}\n')
    df = accounts.flat_users(collections.read_collection(spark, str(tmp_path), schema("users"), "json"))
    assert {r["user_id"]: r["plan"] for r in df.collect()} == {"a": None, "b": "premium"}
    assert collections.owned_by(df, "b").count() == 1


def test_static_content(spark, tmp_path):
    path = tmp_path / "content.json"
    path.write_text(json.dumps({
        "occasions": ["Office", "Casual"], "demoGarments": [{"title": "Polo", "category": "Top", "image": "./p.svg"}]
    }, indent=1))
    assert [r["occasion"] for r in collections.occasions(spark, str(path)).orderBy("position").collect()] == ["Office", "Casual"]
    assert collections.demo_garments(spark, str(path)).first()["category"] == "Top"


def test_sitemap_anti_join(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://a/</loc></url><url><loc>https://a/b</loc></url></urlset>")
    pages = spark.createDataFrame([(1, "https://a/"), (2, "https://a/c")], "page_id int, url string")
    found = page_checks.missing_from_sitemap(pages, collections.sitemap(spark, str(tmp_path / "s.xml")))
    assert [r["page_id"] for r in found.collect()] == [2]


def test_passing_page(spark):
    html = ('<link rel="canonical" href="https://a/"><meta name="robots" content="index,follow">'
            '<meta property="og:image" content="https://a/i.png"><meta name="twitter:image" content="https://a/i.png">'
            '<h1>x</h1><script type="application/ld+json">{"a":1}</script>')
    df = spark.createDataFrame([(1, "https://a/", html), (2, "https://a/", html.replace('{"a":1}', "{").replace("<h1>", "<h1><h1 >"))],
                               "page_id int, url string, html string")
    rows = {r["page_id"]: r for r in page_checks.head_checks(df, "url", "https://a/i.png").collect()}
    assert all(rows[1].asDict().values())
    assert not rows[2]["json_ld_ok"] and not rows[2]["one_heading"] and rows[2]["canonical_ok"]


def test_wire_values(spark, tmp_path):
    doc = {"name": "projects/p/databases/d/documents/users/u7", "fields": {
        "name": {"stringValue": "A"}, "n": {"integerValue": "12"}, "x": {"integerValue": "3"}, "ok": {"booleanValue": False},
        "at": {"timestampValue": "2026-08-02T10:00:00Z"}, "none": {"nullValue": None}, "place": {"geoPointValue": {"latitude": 1}},
        "list": {"arrayValue": {"values": [{"stringValue": "p"}, {"nullValue": None}]}}, "empty": {"arrayValue": {}},
        "map": {"mapValue": {"fields": {"inner": {"mapValue": {"fields": {"k": {"doubleValue": 1.5}}}}}}}, "extra": {"stringValue": "z"},
    }}
    (tmp_path / "d.jsonl").write_text(json.dumps(doc) + "\n")
    wanted = StructType.fromDDL(
        "name string, n bigint, x double, ok boolean, at timestamp, none string, place string, list array<string>, "
        "empty array<string>, map struct<inner: struct<k: double>>, absent string"
    )
    row = wire.read_export(spark, str(tmp_path / "d.jsonl"), wanted, "user_id").first()
    assert (row["user_id"], row["name"], row["n"], row["x"], row["ok"]) == ("u7", "A", 12, 3.0, False)
    assert (row["none"], row["place"], row["list"], row["empty"], row["absent"]) == (None, None, ["p", None], [], None)
    assert row["map"]["inner"]["k"] == 1.5 and row["at"].hour == 10


def test_users_csv(spark, tmp_path):
    from verification.queries_admin import rollup

    rows = accounts.export_rows(rollup(Tables(spark, SF_DIR))).withColumn("Name", F.concat(F.lit('say "hi", '), F.col("Name")))
    path = str(tmp_path / "out")
    sinks.write_users_csv(rows.coalesce(1), path)
    part = next(f for f in os.listdir(path) if f.startswith("part-"))
    raw = open(os.path.join(path, part), newline="").read()
    lines = raw.split("\r\n")
    assert lines[0].startswith('"UID","Name","Email"') and lines[0].count('","') == 13
    assert '"say ""hi"", ' in raw and lines[1].count('","') == 13
    assert len(lines) - 2 == rows.count()


def test_call_log_is_appended_by_day(spark, tmp_path):
    from verification.queries_writes import CALLS

    rows = writes.call_log_rows(Tables(spark, SF_DIR).sql(CALLS))
    path = str(tmp_path / "log")
    sinks.append_call_log(rows, path)
    sinks.append_call_log(rows, path)
    back = spark.read.parquet(path)
    assert back.count() == 2 * rows.count()
    assert any(f.startswith("log_date=") for f in os.listdir(path))


def test_next_state_can_be_written(spark, tmp_path):
    t = Tables(spark, SF_DIR)
    path = str(tmp_path / "wear")
    new = writes.new_plans(t.v_plan_requests, t.v_looks, t.v_look_items, t.v_plans, NOW)
    sinks.replace_table(t.v_plans.unionByName(new.select(*t.v_plans.columns)), path)
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("record_id").distinct().count()
    assert writes.new_plans(t.v_plan_requests, t.v_looks, t.v_look_items, stored, NOW).count() == 0


def test_wire_values_are_never_lost_silently(spark):
    from closetlake.sources.wire import decode_documents
    from pyspark.sql.types import StructType

    docs = [
        '{"name": "x/1", "fields": {"a": {"mapValue": {"fields": {"n": {"stringValue": "five"}, "deep": {"mapValue": {"fields": {"k": {"arrayValue": {"values": [{"integerValue": "1"}, {"mapValue": {}}]}}, "more": {"nullValue": null}}}}}}}, "tags": {"stringValue": "one"}}}',
        '{"name": "x/2", "fields": {"a": {"arrayValue": {}}, "tags": {"arrayValue": {"values": [{"doubleValue": 1.5}, {"nullValue": null}, {"arrayValue": {}}]}}, "new": {"geoPointValue": {"latitude": 1}}}}',
        '{"name": "x/3", "fields": {"at": {"doubleValue": "much"}, "tags": {"arrayValue": {}}}}', "no document", None, '{"name": "x/4"}',
        '{"name": "x/5", "fields": {"at": {"referenceValue": "d/1"}, "tags": {"arrayValue": {"values": [{"referenceValue": "d/2"}]}}, "A": {"stringValue": "upper"}}}',
    ]
    wanted = StructType.fromDDL("a struct<n int, deep struct<k array<string>>>, tags array<string>, at timestamp")
    rows = decode_documents(spark.createDataFrame([(d,) for d in docs], "value string"), wanted, rejects="lost", rescue="rest")
    got = {r["id"]: r for r in rows.withColumn("rest", F.to_json("rest")).collect() if r["id"]}
    assert got["1"]["lost"] == ["a.n", "a.deep.k[1]", "tags"] and got["1"]["rest"] == '{"a.deep.more":{"nullValue":null}}' and got["1"]["a"]["deep"]["k"] == ["1", None]
    assert got["2"]["lost"] == ["a", "tags[2]"] and got["2"]["tags"] == ["1.5", None, None] and got["2"]["rest"] == '{"new":{"geoPointValue":{"latitude":1}}}'
    assert got["3"]["lost"] == ["at"] and got["3"]["tags"] == [] and got["3"]["rest"] is None
    assert got["4"]["lost"] == [] and got["4"]["a"] is None
    assert got["5"]["lost"] == ["at"] and got["5"]["tags"] == ["d/2"] and got["5"]["rest"] == '{"A":{"stringValue":"upper"}}'
    assert sorted(str(r["lost"]) for r in rows.select("id", "lost").collect() if r["id"] is None) == ["['$']", "[]"]


def _files(path):
    return {f"{os.path.basename(d)}/{n}": (os.path.getmtime(f"{d}/{n}"), os.path.getsize(f"{d}/{n}")) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_wire_fields_are_parsed_no_more_than_read(spark):
    """F16: without rejects the parser passes over tags that are not read; the values are those of a decode with rejects."""
    raw = spark.createDataFrame([
        (json.dumps({"name": "d/1", "fields": {"n": {"integerValue": "3"}, "day": {"stringValue": "1998-03-04"}, "ok": {"geoPointValue": {"a": 1}},
                                               "l": {"arrayValue": {"values": [{"doubleValue": 2.5}, {"stringValue": " 7 "}, {"bytesValue": "x"}]}}}}),),
        (json.dumps({"name": "d/2", "fields": {"n": {"stringValue": "1e2"}, "day": {"integerValue": "86400000"}, "ok": {"booleanValue": True}}}),),
    ], "value string")
    kind = StructType.fromDDL("n int, day date, ok boolean, l array<double>")
    plain, checked = wire.decode_documents(raw, kind), wire.decode_documents(raw, kind, rejects="unread")
    assert plain.collect() == checked.drop("unread").collect()
    assert "geoPointValue" not in plain._jdf.queryExecution().optimizedPlan().toString()


def test_texts_that_are_no_numbers_are_told_apart(spark):
    """a text goes to a cast only where it can be a number, and the undeclared fields are found once."""
    texts = ["1", " +2 ", "-3", "4.5", "1e3", "NaN", "-Infinity", "inf", "x", "", "L", "often", "1x", "\t5", None, "99999999999", "0x1", "1d", ".5"]
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    kinds = [f.dataType for f in StructType.fromDDL("a int, b bigint, c double, d decimal(8,2), e float, f tinyint").fields]
    rows = raw.select("i", *[c.cast("string") for k in kinds for c in (wire._number(F.col("t"), k), F.col("t").try_cast(k))]).collect()
    assert all(r[1 + 2 * j] == r[2 + 2 * j] for r in rows for j in range(len(kinds))), rows
    doc = spark.createDataFrame([('{"name": "d/1", "fields": {"a": {"stringValue": "x"}, "z": {"stringValue": "y"}}}',)], "value string")
    found = wire.decode_documents(doc, StructType.fromDDL("a int"), rejects="unread", rescue="rest")
    assert found.select("a", "unread", F.to_json("rest")).first()[:] == (None, ["a"], '{"z":{"stringValue":"y"}}')


def test_updates_rewrite_only_touched_partitions(spark, tmp_path):
    from datetime import date

    from closetlake.sources import partitions

    t = Tables(spark, SF_DIR)
    wear = t.v_wear.withColumn("part", partitions.spread_by("user_id", 8))
    path = str(tmp_path / "wear")
    stored = partitions.store_partitioned(wear, path, "part")
    some = wear.filter("part in (2, 5)").orderBy("record_id").limit(3)
    asked = some.select("user_id", "record_id").unionByName(wear.select("user_id", "record_id").limit(0))
    as_of, now = date(2030, 1, 1), NOW

    def worn(rows):
        return writes.marked_worn(rows, asked, as_of, now)

    wear = wear.withColumn("worn_at", F.lit(None).cast("timestamp")) if "worn_at" not in wear.columns else wear
    partitions.store_partitioned(wear, path, "part")
    want = sorted(map(str, worn(wear).select(*wear.columns).collect()))
    before = _files(path)
    changed = partitions.update_partitions(spark, path, wear.schema, asked, ["user_id", "record_id"], worn, "part")
    after = _files(path)
    assert set(changed) <= {2, 5} and changed
    untouched = {k for k in before if not any(k.startswith(f"part={p}/") for p in changed)}
    assert {k: before[k] for k in untouched} == {k: after[k] for k in after if k in untouched} and len(untouched) < len(before)
    assert sorted(map(str, partitions.read_partitioned(spark, path, wear.schema).collect())) == want
    # Again: nothing differs, so no file is written.
    assert partitions.update_partitions(spark, path, wear.schema, asked, ["user_id", "record_id"], worn, "part") == [] and _files(path) == after
    # Removal of all rows of a partition, of some, and a request for what is not there.
    gone = wear.filter("part = 1").select("user_id", "record_id").unionByName(some.select("user_id", "record_id"))
    strange = gone.union(spark.createDataFrame([(-5, -5)], "user_id long, record_id long"))
    changed = partitions.update_partitions(spark, path, wear.schema, strange, ["user_id", "record_id"], lambda rows: writes.without_plans(rows, strange), "part")
    left = partitions.read_partitioned(spark, path, wear.schema)
    assert 1 in changed and not os.path.exists(f"{path}/part=1") and left.count() == wear.join(gone, ["user_id", "record_id"], "left_anti").count()
    assert stored.schema["part"].dataType.simpleString() == "int"


def test_users_and_coupons_are_updated_in_place(spark, tmp_path):
    from closetlake.sources import partitions

    users = spark.createDataFrame([(k, False, None) for k in range(40)], "user_id long, login_blocked boolean, ai_daily_limit int").withColumn("part", partitions.spread_by("user_id", 4))
    updates = spark.createDataFrame([(1, 3, True, "7"), (2, 3, False, " 9 "), (1, 8, True, "bad")], "seq long, user_id long, login_blocked boolean, raw_limit string")
    path = str(tmp_path / "users")
    partitions.store_partitioned(users, path, "part")
    change = lambda rows: writes.secured_users(rows, updates)
    assert len(partitions.update_partitions(spark, path, users.schema, updates, ["user_id"], change, "part")) == 1
    got = {r["user_id"]: (r["login_blocked"], r["ai_daily_limit"]) for r in partitions.read_partitioned(spark, path, users.schema).collect()}
    assert got == {k: (False, 9 if k == 3 else None) for k in range(40)}
    coupons = spark.createDataFrame([("A", True, 1), ("B", None, 1), ("C", False, 2)], "code string, active boolean, month int")
    asked = spark.createDataFrame([("A", "toggle"), ("C", "delete")], "code string, action string")
    path = str(tmp_path / "coupons")
    partitions.store_partitioned(coupons, path, "month")
    assert partitions.update_partitions(spark, path, coupons.schema, asked, ["code"], lambda rows: writes.updated_coupons(rows, asked), "month") == [1, 2]
    assert sorted(tuple(r) for r in partitions.read_partitioned(spark, path, coupons.schema).collect()) == [("A", False, 1), ("B", None, 1)]


def test_stored_text_index(spark, tmp_path):
    import random

    from closetlake.sources import text_index

    rng = random.Random(4)
    texts = [(k, None if k % 40 == 0 else "".join(rng.choice("ab É") for _ in range(rng.randint(0, 60)))) for k in range(400)] + [(900, "needle\nin the Hay 😀 x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    path = str(tmp_path / "index")
    text_index.append_to_index(df.filter("doc_id < 200"), path, "doc_id", "text", 200)
    text_index.append_to_index(df.filter("doc_id >= 200"), path, "doc_id", "text", 200)
    index, stored = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/texts")
    for query in ("abab", " BÉA ", "é", "", "e\nin", "y 😀 x", "zzz", "aé bé"):
        wanted = query.strip().lower()
        got = sorted(r["doc_id"] for r in text_index.search(stored, index, "doc_id", "text", query).collect())
        assert got == sorted(k for k, x in texts if x is not None and wanted in x.lower()), query
    # Only the partitions of the trigrams and of the candidates are read.
    keys = text_index.candidates(index, "needle")
    assert [r["key"] for r in keys.collect()] == [900]
    plan = text_index.of_candidates(stored, keys, "doc_id")._jdf.queryExecution().executedPlan().toString()
    filters = [line.split("PartitionFilters: ")[1].split("PushedFilters")[0] for line in plan.splitlines() if "PartitionFilters" in line]
    assert len(filters) == 2 and "part#" in filters[0] and "bucket#" in filters[1] and "In(gram" in plan
    # A text that is appended again with new content is found by it; the old one stays a row of the store.
    text_index.append_to_index(spark.createDataFrame([(901, "a new needle")], df.schema), path, "doc_id", "text", 200)
    index, stored = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/texts")
    assert sorted(r["doc_id"] for r in text_index.search(stored, index, "doc_id", "text", "NEEDLE").collect()) == [900, 901]


def test_lists_of_frequent_trigrams_are_cut(spark, monkeypatch):
    from closetlake.sources import text_index

    monkeypatch.setattr(text_index, "LIST_KEYS", 50)
    df = spark.range(0, 1000).select("id", F.concat(F.lit("common "), F.col("id").cast("string")).alias("text"))
    index = text_index.postings(df, "id", "text", 1000)
    sizes = [r["n"] for r in index.filter("gram = 'com'").collect()]
    assert sum(sizes) == 1000 and max(sizes) < 120
    assert sorted(r["id"] for r in text_index.search(df, index, "id", "text", "common 77").collect()) == [77, *range(770, 780)]
