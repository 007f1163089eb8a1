"""One owner with a third of all rows, against plain restatements of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from closetlake.functions.taxonomy import BASE_SLOTS, with_taxonomy
from closetlake.operators import purchase, report

WEIGHT = {"sub_category": 25, "primary_color": 15, "pattern": 10, "material": 10}


@pytest.fixture(scope="module")
def wardrobe(spark):
    rng = random.Random(7)
    items, candidates = [], []

    def attrs():
        return (rng.choice(["Top", "Bottom", "Watch", "Dress", "Coat", "Shoe"]), rng.choice(["a", "b", None]),
                rng.choice(["red", "Red", "blue", ""]), rng.choice(["plain", None]), rng.choice(["x", "y"]))

    for n in range(900):
        owner = "hot" if n < 300 else f"u{n % 40}"
        items.append((owner, f"i{n:04d}", *attrs(), rng.random() < 0.1, rng.choice(["Clean", "Laundry", None]), n % 50))
    for n in range(120):
        owner = "hot" if n < 40 else f"u{n % 40}"
        candidates.append((owner, f"c{n:03d}", *attrs(), 100.0 * n))
    fields = "category string, sub_category string, primary_color string, pattern string, material string"
    frame = spark.createDataFrame(items, f"user_id string, item_id string, {fields}, hidden_from_ai boolean, laundry_status string, age int")
    frame = frame.withColumn("created_at", F.timestamp_seconds(F.lit(1_000_000) + F.col("age")))
    return frame, spark.createDataFrame(candidates, f"user_id string, candidate_id string, {fields}, price double")


def plain(frame):
    return [r.asDict() for r in with_taxonomy(frame).collect()]


def usable(items, owner):
    kept = [i for i in items if i["user_id"] == owner and not i["hidden_from_ai"] and i["laundry_status"] != "Laundry"]
    return sorted(kept, key=lambda i: (-i["age"], i["item_id"]))


def score(c, i):
    total = 40 if c["norm_category"] == i["norm_category"] else 0
    return total + sum(w for n, w in WEIGHT.items() if (c[n] or "").lower() == (i[n] or "").lower())


def test_similar_garments_match_all_pairs(wardrobe):
    items, candidates = wardrobe
    owned, expected = plain(items), set()
    for c in plain(candidates):
        scored = [(score(c, i), i["item_id"]) for i in usable(owned, c["user_id"])]
        best = sorted((s for s in scored if s[0] >= 65), key=lambda s: -s[0])[:6]
        expected |= {(c["candidate_id"], rank + 1, i, s) for rank, (s, i) in enumerate(best)}
    got = purchase.similar_garments(candidates, items).collect()
    assert {(r["candidate_id"], r["rank"], r["item_id"], r["score"]) for r in got} == expected
    assert len(got) == len(expected)


def test_combinations_match_rotations(wardrobe):
    items, candidates = wardrobe
    owned, expected = plain(items), {}
    for c in plain(candidates):
        pools = {}
        for i in usable(owned, c["user_id"]):
            pools.setdefault(i["slot"], []).append(i["item_id"])
        seen = []
        for n in range(12):
            ids = [pools[s][n % len(pools[s])] for s in BASE_SLOTS.get(c["slot"], BASE_SLOTS["other"]) if s in pools]
            if len(ids) >= 2 and ids not in seen:
                seen.append(ids)
        expected[c["candidate_id"]] = seen
    got: dict = {}
    for r in purchase.combinations(candidates, items).collect():
        got.setdefault(r["candidate_id"], {}).setdefault(r["combination_no"], {})[r["pos"]] = r["item_id"]
    for cid, combos in expected.items():
        have = [[v for _, v in sorted(got.get(cid, {})[k].items())] for k in sorted(got.get(cid, {}))]
        assert have == combos, cid


def _shuffles_whole_groups(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return "Window" in text and "WindowGroupLimit" not in text


def test_top_k_is_cut_before_the_shuffle(wardrobe):
    items, _ = wardrobe
    extra = items.selectExpr("*", "'t' AS title", "CAST(NULL AS string) AS type", "CAST(NULL AS date) AS last_worn", "1 AS times_worn")
    assert not _shuffles_whole_groups(report.neglected_items(extra, "2026-01-01"))
    assert not _shuffles_whole_groups(purchase.slot_pools(items))


def test_doubling_users_leaves_each_user_as_it_was(spark):
    from tests.conftest import SF_DIR
    from verification.registry import AS_OF, Tables

    t = Tables(spark, SF_DIR)

    def twin(df):
        return df.unionByName(df.withColumn("user_id", F.col("user_id") + 1_000_000))

    once = report.weekly_usage(t.v_users, t.v_items, t.v_wear, t.v_wear_items, AS_OF)
    both = report.weekly_usage(twin(t.v_users), twin(t.v_items), twin(t.v_wear), twin(t.v_wear_items), AS_OF)
    first = sorted(map(tuple, once.collect()))
    rows = both.collect()
    assert sorted(tuple(r) for r in rows if r["user_id"] < 1_000_000) == first
    assert sorted((r[0] - 1_000_000, *r[1:]) for r in rows if r["user_id"] >= 1_000_000) == first


def test_row_order_does_not_matter(spark):
    from tests.conftest import SF_DIR
    from verification.registry import AS_OF, Tables

    t = Tables(spark, SF_DIR)

    def mixed(df):
        return df.repartition(7).orderBy(F.rand(3))

    args = [t.v_users, t.v_items, t.v_wear, t.v_wear_items, t.v_looks, t.v_look_items]
    one = report.weekly_report(*args, AS_OF).collect()
    two = report.weekly_report(*[mixed(a) for a in args], AS_OF).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
