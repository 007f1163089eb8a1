"""Steps whose time or memory grew faster than their input."""

import re
from datetime import date

from pyspark.sql import functions as F

import __spark_entry__ as entry
from closetlake.functions.search import with_search_text
from closetlake.functions.text import search_key, search_keys
from closetlake.operators import increments, insights
from closetlake.operators.common import maybe_among
from closetlake.plans import settings
from closetlake.sources import text_index
from tests.conftest import SF_DIR

ODD = ["Tee & Co", "", "É-Blue\u0001Red", "a b c\nd", "&&", "T-Shirt", "shoes", "ẞ1", "x" * 300, "--", None]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_a_search_are_made_once(spark):
    """what a search reads of an index does not make the index again."""
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(["red tee", "blue tee", "red coat"])], "entry string, search_text string")
    index = text_index.postings(texts, "entry", "search_text", 3)
    found = text_index.candidates_of_all(index, [["tee", "tshirt"], ["red"]])
    assert "regexp_extract_all" not in plan(found)
    assert [r.key for r in found.collect()] == ["0"]


def test_search_keys_join_what_they_keep(spark):
    """the same keys as by replacing everything else, which was most of the time of a search."""
    rows = spark.createDataFrame([(x,) for x in ODD], "v string")
    old = F.regexp_replace(F.replace(F.lower(F.coalesce("v", F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", "")
    got = rows.select(search_key("v").alias("new"), old.alias("old"))
    assert all(r.new == r.old for r in got.collect())
    assert "regexp_replace" not in plan(rows.select(search_key("v")))
    whole = spark.createDataFrame([(ODD,)], "v array<string>").select(search_keys("v").alias("k")).first().k
    assert whole == [r.old for v, r in zip(ODD, got.collect()) if v]
    text = with_search_text(spark.createDataFrame([("Tee", "shoes", "Plain")], "title string, category string, brand string"))
    assert text.first().search_text.split(" ")[:3] == ["tee", "tshirt", "tshirts"]


def test_preference_texts_sort_after_the_shuffle(spark):
    """rows are not sorted in the task that makes 22 of each user."""
    shown = plan(entry.queries()["preference_texts"](spark, SF_DIR))
    dealt = shown.index("REPARTITION_BY_COL")
    assert "SortAggregate" in shown[:dealt] and "SortAggregate" not in shown[dealt:]


def test_a_batch_is_looked_at_once(spark):
    """the tables of a state do not read earlier batches again."""
    batch = spark.range(6).selectExpr("concat('e', id % 5) AS event_id", "concat('u', id % 2) AS user_id", "timestamp '2024-01-01' + make_dt_interval(int(id % 5)) AS time")
    state = increments.empty_state(spark)
    for part in (batch.filter("event_id < 'e3'"), batch):
        state = increments.advanced(state, part)
    for table in (state.ledger, state.days, state.months):
        assert "Range (" not in plan(table)
    assert state.ledger.count() == 5
    assert sorted((str(r.day), r.events) for r in state.days.collect()) == [(f"2024-01-0{k}", 1) for k in range(1, 6)]


def test_partitions_are_not_joined_to_one_per_core(spark):
    """Sorted and grouped rows of a task are bounded, whatever the number of cores."""
    settings.apply(spark)
    rows = spark.range(0, 4_000_000, 1, 4).selectExpr("xxhash64(id) AS k", "xxhash64(id, 1) AS v").repartition(64, "k")
    sized = spark.range(0, 4_000_000, 1, 4).selectExpr("xxhash64(id) AS k", "xxhash64(id, 1) AS v").groupBy("k").agg(F.max("v").alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert rows.rdd.getNumPartitions() == 64 and sized.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_only_pieces_of_selected_records_are_shuffled(spark):
    """records of the selected days are found once, and other pieces are dropped below the joins."""
    settings.apply(spark)
    days = "date_add(date '2024-01-01', int(id div 40)) AS wear_date"
    wear = spark.range(0, 400).selectExpr("id % 40 AS user_id", "id AS record_id", "id AS outfit_id", days, "'planned' AS status", "concat('w4321-', id) AS notes")
    lines = spark.range(0, 1203).selectExpr("id % 401 AS line_of", "id % 7 AS item_id", "id AS pos")
    saved = wear.join(lines, F.col("record_id") == F.col("line_of")).select("user_id", F.col("record_id").alias("look_id"), "pos", "item_id")
    own = saved.filter("look_id % 3 <> 0").withColumnRenamed("look_id", "record_id")
    items = spark.range(0, 280).selectExpr("id div 7 AS user_id", "id % 7 AS item_id", "concat('t', id % 7) AS title").filter("item_id <> 5")
    selected = spark.range(0, 40).selectExpr("id AS user_id", "date_add(date '2024-01-01', int(id % 12)) AS wear_date")
    frame = insights.selected_day_cards(selected, wear, own, saved, items, date(2024, 1, 5))
    shown = frame._jdf.queryExecution().optimizedPlan().toString()
    read = shown.count("Range (0, 1203")
    assert "w4321" not in shown and read == len(re.findall(r"Filter [^\n]*scalar-subquery[^\n]*% 401\) as string", shown)) >= 2
    want = {}
    for user in range(40):
        record = user + 40 * (user % 12)
        if record < 400:
            want[record] = [n % 7 for n in range(record, 1203, 401) if n % 7 != 5] or None
    assert {r.record_id: r.preview and [p.item_id for p in r.preview] for r in frame.collect()} == want
    keys = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r.k for r in maybe_among(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"), "k", keys, "k").collect()] == ["a"]
    assert maybe_among(lines, "pos", keys, "k") is lines and maybe_among(lines, "pos", lines.limit(0), "pos").isEmpty()
