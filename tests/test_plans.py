"""Dashboards build and run."""

import re

from pyspark.sql import functions as F

from closetlake.functions import taxonomy
from closetlake.functions.taxonomy import taxonomy_values, with_taxonomy
from closetlake.operators import purchase, report, writes
from closetlake.plans import dashboards, settings
from closetlake.sources import owner_tables
from tests.conftest import SF_DIR
from verification.registry import AS_OF, NOW, Tables


def tables(spark):
    t = Tables(spark, SF_DIR)
    return dashboards.Tables(
        t.v_accounts, t.v_items, t.v_looks, t.v_look_items, t.v_wear, t.v_wear_items, t.v_quest,
        t.v_ai_responses, t.v_outfit_history, t.v_api_logs,
    )


def test_user_dashboard(spark):
    settings.apply(spark)
    t = tables(spark).tagged().cached()
    users = t.users.count()
    panels = dashboards.user_dashboard(t, AS_OF)
    counts = {name: df.count() for name, df in panels.items()}
    t.release()
    assert counts["home_stats"] == counts["weekly_report"] == users
    assert counts["badges"] == 6 * users and counts["calendar"] == 30 * users


def test_weekly_report_reads_wear_pieces_once(spark):
    """Worn items, the most repeated one and the colors come from one pass over the pieces."""
    settings.apply(spark)
    t = tables(spark)
    probe = t.wear_items.withColumn("pos", F.col("pos") + F.lit(4321))
    plan = report.weekly_report(t.users, t.items, t.wear, probe, t.looks, t.look_items, AS_OF)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("4321") == 1


def test_admin_dashboard(spark):
    panels = dashboards.admin_dashboard(tables(spark), NOW)
    counts = {name: df.count() for name, df in panels.items()}
    assert counts["totals"] == counts["health"] == 1
    assert counts["users_page"] == 20 and counts["activity_page"] == 30 and counts["engagement"] == 6


def test_purchase_dashboard(spark):
    t = Tables(spark, SF_DIR)
    panels = dashboards.purchase_dashboard(t.v_candidates, t.v_items)
    assert panels["result"].count() == t.v_candidates.count()
    assert panels["similar"].count() > 0 and panels["combinations"].count() > 0


def test_patterns_run_once_for_each_value(spark):
    """The patterns of category and slot stand once in the plan of the purchase check, over different values."""
    t = Tables(settings.apply(spark), SF_DIR)
    frame = purchase.purchase_check(t.v_candidates, t.v_items)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"RLIKE", final)) <= 13 and "ReusedExchange" in final
    values = taxonomy_values(t.v_items, t.v_candidates)
    assert values.count() < t.v_items.count() / 2
    both = [with_taxonomy(t.v_items, v).select("user_id", "item_id", "norm_category", "slot") for v in (None, values)]
    assert both[0].exceptAll(both[1]).isEmpty() and both[1].exceptAll(both[0]).isEmpty()


def test_too_many_values_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(taxonomy, "MOST_VALUES", 3)
    df = spark.createDataFrame([(f"Denim {n}",) for n in range(5)] + [(None,)], "title string")
    assert taxonomy_values(df) is None and taxonomy_values(df.limit(2), df.limit(1)) is not None
    assert with_taxonomy(df, taxonomy_values(df)).filter("norm_category = 'Top'").count() == 6


def test_tables_by_owner_need_no_shuffle(spark):
    """With all tables bucketed by owner the weekly report has no exchange, and the same rows."""
    t = Tables(settings.apply(spark), SF_DIR)
    names = ["v_accounts", "v_items", "v_wear", "v_wear_items", "v_looks", "v_look_items"]
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "true"}
    before = {k: spark.conf.get(k) for k in changed}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = owner_tables.co_located(spark)
        stored = {n: owner_tables.store_by_owner(getattr(t, n), f"by_owner_{n}", 4) for n in names}
        frame = report.weekly_report(*[stored[n] for n in names], AS_OF)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") >= 6
        assert sorted(map(str, frame.collect())) == sorted(map(str, report.weekly_report(*[getattr(t, n) for n in names], AS_OF).collect()))
        assert "Exchange" in report.weekly_report(*[getattr(t, n) for n in names], AS_OF)._jdf.queryExecution().executedPlan().toString()
        again = owner_tables.store_by_owner(t.v_items.limit(5), "by_owner_v_items", 4)  # replaced, not appended
        assert again.count() == 5 and owner_tables.stored_by_owner(own, "by_owner_v_items").count() == 5
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS by_owner_{n}")
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bucket_sizes_show_a_large_owner(spark):
    df = spark.range(0, 900).select((F.when(F.col("id") < 300, 7).otherwise(F.col("id"))).alias("user_id"))
    rows = owner_tables.bucket_sizes(df, 8).collect()
    assert sum(r["rows"] for r in rows) == 900 and max(r["largest_owner"] for r in rows) == 300
    assert owner_tables.buckets_for(1) == 1 and owner_tables.buckets_for(100 * 2**40) == 524288 and owner_tables.buckets_for(5, 3) == 4


def test_only_doubtful_rows_of_a_deletion_are_shuffled(spark, monkeypatch):
    t = Tables(settings.apply(spark), SF_DIR)
    few = writes.without_deleted_users({"items": t.v_items}, t.v_deletions)["items"]
    monkeypatch.setattr(writes, "MOST_BROADCAST", 0)
    nobody = t.v_items.limit(3).withColumn("user_id", F.lit(None).cast("bigint"))
    many = writes.without_deleted_users({"items": t.v_items, "others": nobody}, t.v_deletions)
    assert few.exceptAll(many["items"]).isEmpty() and many["items"].exceptAll(few).isEmpty() and 0 < few.count() < t.v_items.count()
    assert many["others"].count() == 3
    # A filter that knows the users lets nearly none of the others through.
    bits = writes.user_filter(spark.range(0, 20_000).select(F.col("id").alias("user_id")))
    word, wanted = writes._filter_bits("user_id")
    met = spark.range(0, 100_000).select(F.col("id").alias("user_id")).crossJoin(bits).filter(F.get("_filter", word).bitwiseAND(wanted) == wanted)
    assert met.filter("user_id < 20000").count() == 20_000 and met.count() < 21_000
