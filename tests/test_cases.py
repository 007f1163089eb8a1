"""Small literal cases with worked-out results."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from closetlake.functions import calendar, hashing, search, text, values
from closetlake.functions.taxonomy import with_taxonomy
from closetlake.operators import accounts, grounding, insights, looks, purchase, quests, report, writes

GARMENT = "user_id string, item_id string, title string, category string, sub_category string, primary_color string, laundry_status string"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("title,zone,alone,slot", [
    ("Dress Shirt", "full_body", True, "top"), ("Bomber Jacket", None, None, "layer"),
    ("Silver Watch", None, None, "accessory"), ("Silk Saree", None, None, "hero"), ("Summer Dress", None, None, "hero"),
    ("short sleeve shirt", None, None, "bottom"), ("plain thing", "feet", None, "footwear"),
])
def test_slot(spark, title, zone, alone, slot):
    df = spark.createDataFrame([(title, zone, alone)], "title string, body_zone string, standalone_outfit boolean")
    assert with_taxonomy(df).first()["slot"] == slot


@pytest.mark.parametrize("category,sub,expected", [
    ("steel thing", None, "Top"), ("Kurta Set", None, "Top"), ("Lehenga", None, "Traditional set"),
    (None, None, "Top"), ("Denim", "Overshirt", "Outerwear"), ("co-ord", "", "One-piece"),
])
def test_category(spark, category, sub, expected):
    df = spark.createDataFrame([(category, sub)], "category string, sub_category string")
    assert with_taxonomy(df).first()["norm_category"] == expected


@pytest.mark.parametrize("row,query,found", [
    (("Cotton T-Shirt", "Top", "North", "Blue"), "tshirt", True),
    (("Cotton T-Shirt", "Top", "North", "Blue"), "tee blue", True),
    (("Running Sneakers", "Footwear", None, None), "shoes", True),
    (("Running Sneakers", "Footwear", None, None), "belt", False),
    (("Running Sneakers", "Footwear", None, None), "  ", True),
])
def test_search(spark, row, query, found):
    df = spark.createDataFrame([row], "title string, category string, brand string, primary_color string")
    got = search.with_search_text(df).filter(search.matches("search_text", query)).count()
    assert bool(got) is found


def test_month_shift(spark):
    shown = F.lit(date(2027, 1, 1))
    assert one(spark, calendar.shift_month(F.lit("2027-01-31"), shown, 1)) == date(2027, 2, 28)
    assert one(spark, calendar.shift_month(F.lit("2027-02-28"), shown, -2)) == date(2026, 12, 28)
    assert one(spark, calendar.shift_month(F.lit("?"), shown, -2)) == date(2026, 11, 1)
    assert one(spark, calendar.shift_month(F.lit("2027-02-31"), shown, 1)) == date(2027, 3, 31)
    assert one(spark, calendar.shifted_display(F.lit("2027-02-31"), shown, 1)) == date(2027, 3, 1)


def test_leap_february(spark):
    month = F.lit(date(2028, 2, 1))
    assert one(spark, F.size(calendar.month_days(month))) == 29
    assert one(spark, calendar.leading_blanks(month)) == 2


def test_prompt_hashes(spark):
    assert one(spark, hashing.prompt_stamp(F.lit("festival_stylist"))) == "zhpf5r"
    assert one(spark, hashing.prompt_hash(F.lit(""))) == "ztntfp"
    assert one(spark, hashing.prompt_version(F.lit("nope"))) == 1
    assert one(spark, hashing.release_tag(F.lit("nope"))) == "unclassified"
    assert one(spark, hashing.cache_key(F.lit("festival_stylist"), F.lit("user"))) == "zhpf5r:user"


def _fnv(units):
    h = 2166136261
    for u in units:
        h = ((h ^ u) * 16777619) % 2**32
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    while h:
        h, r = divmod(h, 36)
        out = digits[r] + out
    return out or "0"


@pytest.mark.parametrize("value", ["abc", "é\n\x00x", "a😀b", "日本"])
def test_hashes_beyond_the_first_plane(spark, value):
    raw = value.encode("utf-16-le")
    units = [raw[i] + 256 * raw[i + 1] for i in range(0, len(raw), 2)]
    firsts = []
    for ch in value:
        enc = ch.encode("utf-16-le")
        firsts.append(enc[0] + 256 * enc[1])
    assert one(spark, hashing.prompt_hash(F.lit(value))) == _fnv(units)
    assert one(spark, hashing.character_hash(F.lit(value))) == _fnv(firsts)


def test_text_helpers(spark):
    assert one(spark, text.pretty_label(F.lit("web_AI--élan x"))) == "Web_AI Élan X".replace("_", " ").replace("Élan", "éLan")
    assert one(spark, text.pretty(F.lit("a_b-c"))) == "A B-C"
    assert one(spark, text.clean(F.lit("  <b>x</b>﻿"), 3)) == "bx/"
    assert one(spark, text.clean_list(F.array(F.lit("<>"), F.lit("a"), F.lit("b")), 2, 5)) == ["a"]
    assert one(spark, text.list_text(F.array(F.lit("slim_fit"), F.lit("x")))) == "Slim Fit, X"
    assert one(spark, text.search_key(F.lit("Black & White T-Shirt"))) == "blackandwhitetshirt"
    assert one(spark, text.web_url(F.lit("HTTP://A.b/C?x"))) == "http://a.b/C?x"
    assert one(spark, text.web_url(F.lit("https://A.b"))) == "https://a.b/"
    assert one(spark, text.web_url(F.lit("javascript:1"))) == ""
    assert one(spark, text.local_asset(F.lit("./assets/a.png\n"))) == ""
    assert one(spark, text.admin_flag(F.lit('{"admin": true}'))) is True
    assert one(spark, text.admin_flag(F.lit('{"admin": 1}'))) is False
    assert one(spark, text.admin_flag(F.lit("{"))) is False
    assert one(spark, text.coupon_code(F.lit(" ab-1 ü!"))) == "AB-1"


def test_points_fall_through(spark):
    assert one(spark, values.points(F.lit(0), F.lit(40))) == 40
    assert one(spark, values.points(F.lit(None).cast("int"), F.lit(None).cast("int"))) == 0


def test_weekly_report_case(spark):
    users = spark.createDataFrame([("u",), ("empty",)], "user_id string")
    items = spark.createDataFrame(
        [("u", "a", "A", None, "Clean"), ("u", "b", "B", None, "Clean")],
        "user_id string, item_id string, title string, type string, laundry_status string",
    ).selectExpr("*", "false AS hidden_from_ai", "CAST(NULL AS double) AS purchase_price", "CAST(NULL AS int) AS times_worn",
                 "CAST(NULL AS date) AS last_worn", "CAST(NULL AS string) AS primary_color", "CAST(NULL AS timestamp) AS created_at")
    wear = spark.createDataFrame(
        [("u", "1", date(2026, 8, 2), "worn"), ("u", "2", date(2026, 7, 20), "worn")],
        "user_id string, record_id string, wear_date date, status string",
    )
    pieces = spark.createDataFrame([("u", "1", 0, "a"), ("u", "2", 0, "b")], "user_id string, record_id string, pos int, item_id string")
    none = spark.createDataFrame([], "user_id string, look_id string, created_at timestamp")
    no_pieces = spark.createDataFrame([], "user_id string, look_id string, pos int, item_id string")
    rows = {r["user_id"]: r for r in report.weekly_report(users, items, wear, pieces, none, no_pieces, date(2026, 8, 2)).collect()}
    got = rows["u"]
    assert (got["worn_items"], got["outfit_days"], got["total_items"], got["usage_percent"]) == (1, 1, 2, 50)
    assert (got["most_repeated_id"], got["best_value_id"], got["neglected"], got["colors"]) == ("a", None, 2, None)
    assert got["since"] == date(2026, 7, 27) and got["suggested_look_id"] is None
    assert rows["empty"]["usage_percent"] == 0


def test_purchase_case(spark):
    items = spark.createDataFrame(
        [("u", "top", None, "Top", "T-shirt", "Blue", "Clean"), ("u", "bottom", None, "Bottom", None, "Black", "Clean"),
         ("u", "shoe", None, "Footwear", None, "White", None)], GARMENT,
    ).selectExpr("*", "CAST(NULL AS boolean) AS hidden_from_ai", "CAST(NULL AS timestamp) AS created_at",
                 "CAST(NULL AS string) AS pattern", "CAST(NULL AS string) AS material")
    candidate = spark.createDataFrame(
        [("u", "c", "Top", "T-shirt", "Blue", None, None, 1000.0)],
        "user_id string, candidate_id string, category string, sub_category string, primary_color string, pattern string, material string, price double",
    )
    similar = purchase.similar_garments(candidate, items).collect()
    assert [(r["item_id"], r["score"]) for r in similar] == [("top", 100)]
    combos = purchase.combinations(candidate, items).collect()
    assert sorted((r["combination_no"], r["item_id"]) for r in combos) == [(0, "bottom"), (0, "shoe")]
    got = purchase.purchase_check(candidate, items).first()
    assert (got["possible_outfits"], got["compatible_pieces"], got["expected_wears"], got["cost_per_wear"], got["verdict"]) == (1, 2, 5, 200, "consider")


def test_only_garments_alike_to_a_candidate_are_indexed(spark):
    """garments that meet no candidate get no index entries; of those alike in every attribute six do, equal rows included."""
    kind = "user_id string, item_id int, norm_category string, k_sub_category string, k_primary_color string, k_pattern string, k_material string, newest long"
    rows = [("u", n, "Top", "tee", "blue", "plain", "cotton", n) for n in range(8)] + [("u", 0, "Top", "tee", "blue", "plain", "cotton", 0)]
    rows += [("u", 20, "Top", "polo", "blue", "", "cotton", 1), ("u", 21, "Top", "polo", "blue", "check", "linen", 1), ("u", 22, "Top", "polo", "red", "plain", "cotton", 1),
             ("u", 23, "Bottom", "tee", "blue", "plain", "cotton", 1), ("v", 24, "Top", "tee", "blue", "plain", "cotton", 1)]
    owned = spark.createDataFrame(rows, kind)
    candidates = owned.filter("item_id = 1")
    found = purchase._alike(owned, candidates, [F.col("newest"), F.col("item_id")])
    assert set(found.columns) == set(owned.columns)
    assert sorted(r["item_id"] for r in found.collect()) == [0, 0, 1, 2, 3, 4, 20]


def test_streaks(spark):
    rows = [("a", date(2026, 8, d)) for d in (1, 2, 2, 4, 5)] + [("b", date(2026, 8, 1)), ("c", date(2026, 8, 9))]
    df = spark.createDataFrame(rows, "user_id string, challenge_date date")
    got = {r["user_id"]: (r["streak"], r["longest_streak"]) for r in quests.streaks(df, date(2026, 8, 6)).collect()}
    assert got == {"a": (2, 2), "b": (0, 1), "c": (1, 1)}


def test_library_keeps_looks_without_a_source(spark):
    df = spark.createDataFrame([("x", None, None), ("y", True, "style_challenge")], "look_id string, lookbook boolean, source string")
    assert [r["look_id"] for r in df.filter(looks.in_library("ai")).collect()] == ["x"]
    assert [r["look_id"] for r in df.filter(looks.in_library("challenge")).collect()] == ["y"]


def test_empty_id_list_ends_the_chain(spark):
    df = spark.createDataFrame([([], ["a"]), (None, ["b"])], "own array<string>, outfit array<string>")
    assert [r[0] for r in df.select(looks.item_ids("own", "outfit")).collect()] == [[], ["b"]]


def test_records_borrow_the_saved_look(spark):
    wear = spark.createDataFrame([("u", "1", "L"), ("u", "2", "L"), ("u", "3", None)], "user_id string, record_id string, outfit_id string")
    own = spark.createDataFrame([("u", "1", 0, "z")], "user_id string, record_id string, pos int, item_id string")
    look = spark.createDataFrame([("u", "L", 0, "a"), ("u", "L", 1, "b")], "user_id string, look_id string, pos int, item_id string")
    got = sorted((r["record_id"], r["item_id"]) for r in looks.resolved_ids(wear, own, look).collect())
    assert got == [("1", "z"), ("2", "a"), ("2", "b")]


def test_day_thumbnails_cut_before_ownership(spark):
    wear = spark.createDataFrame([("u", "1", date(2026, 8, 2)), ("u", "2", date(2026, 8, 2))], "user_id string, record_id string, wear_date date")
    pieces = spark.createDataFrame([("u", "1", 0, "gone"), ("u", "1", 1, "a"), ("u", "2", 0, "b")], "user_id string, record_id string, pos int, item_id string")
    items = spark.createDataFrame([("u", "a", "A"), ("u", "b", "B")], "user_id string, item_id string, title string")
    got = insights.day_thumbnails(wear, pieces, items, date(2026, 8, 1)).collect()
    assert [r["item_id"] for r in got] == ["a"]
    assert insights.records_per_day(wear).first()["records"] == 2


@pytest.mark.parametrize("picks,expected", [
    (["top:1", "bottom:2", "hero:3"], {"hero:3"}), (["hero:1", "top:2"], {"top:2"}),
    (["top:1", "top:2", "footwear:3"], {"top:2", "footwear:3"}), (["hero:1", "layer:2", "hero:3", "accessory:4"], {"hero:3", "accessory:4"}),
])
def test_exclusive_picks(spark, picks, expected):
    rows = [("u", "l", i, *reversed(p.split(":"))) for i, p in enumerate(picks)]
    df = spark.createDataFrame(rows, "user_id string, look_id string, pos int, item_id string, slot string")
    assert {f"{r['slot']}:{r['item_id']}" for r in looks.exclusive_picks(df).collect()} == expected


def test_limits_and_premium(spark):
    df = spark.createDataFrame(
        [("a", None, "premium", datetime(2030, 1, 1)), ("b", 0, "premium", datetime(2000, 1, 1)), ("c", 3, None, None)],
        "user_id string, ai_daily_limit int, plan string, premium_until timestamp",
    )
    got = {r["user_id"]: (r["n"], r["p"]) for r in df.select(
        "user_id", accounts.effective_limit("ai_daily_limit", F.lit(-2)).alias("n"), accounts.premium(datetime(2026, 1, 1)).alias("p")
    ).collect()}
    assert got == {"a": (0, True), "b": (0, False), "c": (3, False)}


def test_page_past_the_end_shows_the_last(spark):
    from closetlake.operators.paging import page

    df = spark.range(45)
    got = page(df, [F.col("id")], 9, 20).collect()
    assert [r["id"] for r in got] == [40, 41, 42, 43, 44] and {r["page"] for r in got} == {3}
    assert page(df.filter("id < 0"), [F.col("id")], 1, 20).count() == 0


def test_model_output_is_bounded_and_grounded(spark):
    import json

    items = spark.createDataFrame([("u", f"i{n}") for n in range(20)], "user_id string, item_id string")
    raw = json.dumps({
        "verdict": "buy!", "summary": "<s>",
        "similarityMatches": [{"wardrobeItemId": f"i{n}", "score": 150 if n % 2 else "64.9"} for n in range(20)],
        "outfitExamples": [{"itemIds": [f"i{n}", "i0", f"i{n}", "no"]} for n in range(20)], "reasons": list("abcdefg"),
    })
    df = spark.createDataFrame([("u", "r", raw), ("u", "bad", "{")], "user_id string, result_id string, raw string")
    parsed = grounding.parsed_results(df)
    matches = grounding.grounded_matches(parsed, items).collect()
    assert sorted(r["item_id"] for r in matches) == sorted(["i1", "i3", "i5", "i7", "i9", "i11"])
    assert {r["score"] for r in matches} == {100.0}
    examples = grounding.grounded_examples(parsed, items)
    assert examples.select("example_no").distinct().count() == 12
    row = grounding.sanitized_results(parsed, examples).collect()
    assert len(row) == 1 and row[0]["verdict"] == "consider" and row[0]["reasons"] == list("abcde")
    assert (row[0]["possible_outfits"], row[0]["compatible_pieces"]) == (12, 13)


@pytest.mark.parametrize("raw,parsed,ids", [
    ('{"wardrobeItemIds": ["b", "x", "a", "b"]}', True, ["b", "a"]), ('```json\n{"wardrobeItemIds": ["a"]}\n```', True, ["a"]),
    ('{"wardrobeItemIds": "a", "title": 3}', True, []), ('{"wardrobeItemIds": ["a"', False, []),
    ("null", False, []), ("", False, []), (None, False, []),
])
def test_outfit_grounding(spark, raw, parsed, ids):
    items = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "x")], "user_id string, item_id string")
    df = spark.createDataFrame([("u", "r", "b", raw)], "user_id string, result_id string, anchor_item_id string, raw string")
    rows = grounding.parsed_outfits(df)
    pieces = grounding.outfit_pieces(rows, items)
    assert [r["item_id"] for r in pieces.orderBy("pos").collect()] == ids
    reason = "not JSON" if not parsed else "no usable garments" if not ids else None if "b" in ids else "selected garment not kept"
    found = grounding.outfit_verdicts(rows, pieces).first()
    assert (found["pieces"], found["reject_reason"]) == (len(ids), reason)


def test_previews_of_own_and_saved_pieces(spark):
    records = spark.createDataFrame([("u", "1", "L"), ("u", "2", "L"), ("u", "3", None)], "user_id string, record_id string, outfit_id string")
    own = spark.createDataFrame([("u", "1", n, f"i{n}") for n in range(6)], "user_id string, record_id string, pos int, item_id string")
    saved = spark.createDataFrame([("u", "L", 0, "gone"), ("u", "L", 1, "i5")], "user_id string, look_id string, pos int, item_id string")
    items = spark.createDataFrame([("u", f"i{n}", f"t{n}") for n in range(1, 7)], "user_id string, item_id string, title string")
    shown = {r["record_id"]: [p["item_id"] for p in r["preview"]] for r in looks.record_previews(records, own, saved, items).collect()}
    assert shown == {"1": ["i1", "i2", "i3", "i4"], "2": ["i5"]}


def test_today_without_an_outfit(spark):
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    today = spark.createDataFrame([("u", None, "", "Saved")], "user_id string, outfit_id string, outfit_title string, title string")
    none = spark.createDataFrame([], "user_id string, pos int, item_id string")
    saved = spark.createDataFrame([], "user_id string, look_id string, pos int, item_id string")
    items = spark.createDataFrame([], "user_id string, item_id string, title string")
    rows = {r["user_id"]: (r["title"], r["preview"]) for r in insights.today_cards(users, today, none, saved, items).collect()}
    assert rows == {"u": ("Saved", None), "v": ("No cached outfit for today", None)}


def test_request_reviews(spark):
    requests = spark.createDataFrame([("a", "pending"), ("b", "pending"), ("c", "approved"), ("d", "pending")], "user_id string, status string")
    reviews = spark.createDataFrame(
        [("a", 1, "approve", False), ("a", 2, "reject", False), ("b", 1, "approve", True), ("c", 1, "reject", True), ("d", 1, "wait", True)],
        "user_id string, seq int, action string, uploads_deleted boolean")
    now = datetime(2026, 8, 5)
    after = writes.reviewed_deletions(requests, reviews, now)
    assert dict(after.select("user_id", "status").collect()) == {"a": "rejected", "b": "approved", "c": "approved", "d": "pending"}
    assert {r["user_id"] for r in after.collect() if r["reviewed_at"]} == {"a", "b"}
    again = writes.reviewed_deletions(after, reviews, datetime(2026, 9, 1))
    assert sorted(again.collect()) == sorted(after.select(*again.columns).collect())


def test_week_of_an_untitled_garment(spark):
    """A garment without a title or color still is the most repeated one; colors come from others."""
    d = date(2026, 8, 5)
    users = spark.createDataFrame([("u",), ("w",)], "user_id string")
    items = spark.createDataFrame(
        [("u", "i1", None, None, "Clean"), ("u", "i2", "two", "red", "Clean"), ("u", "i3", "three", "", "Laundry")],
        "user_id string, item_id string, title string, primary_color string, laundry_status string"
    ).selectExpr("*", "CAST(NULL AS STRING) AS type", "false AS hidden_from_ai", "CAST(NULL AS DOUBLE) AS purchase_price",
                 "CAST(NULL AS INT) AS times_worn", "CAST(NULL AS DATE) AS last_worn", "CAST(NULL AS TIMESTAMP) AS created_at")
    wear = spark.createDataFrame([("u", "1", d, "worn"), ("u", "2", d, "worn")], "user_id string, record_id string, wear_date date, status string")
    pieces = spark.createDataFrame([("u", "1", 0, "i2"), ("u", "1", 1, "i1"), ("u", "2", 0, "i1"), ("u", "2", 1, "i3"), ("u", "2", 2, "gone")],
                                   "user_id string, record_id string, pos int, item_id string")
    saved = spark.createDataFrame([], "user_id string, look_id string, created_at timestamp")
    look_items = spark.createDataFrame([], "user_id string, look_id string, pos int, item_id string")
    rows = {r["user_id"]: r for r in report.weekly_report(users, items, wear, pieces, saved, look_items, d).collect()}
    assert (rows["u"]["most_repeated_id"], rows["u"]["most_repeated"], rows["u"]["colors"]) == ("i1", None, "red")
    assert (rows["u"]["worn_items"], rows["u"]["neglected"], rows["u"]["usage_percent"]) == (4, 2, 133)
    assert (rows["w"]["worn_items"], rows["w"]["neglected"], rows["w"]["colors"]) == (0, 0, None)


def test_updates_can_be_repeated(spark):
    wear = spark.createDataFrame([("u", "1", date(2026, 8, 1), "planned"), ("v", "2", date(2026, 9, 1), "planned")],
                                 "user_id string, record_id string, wear_date date, status string")
    asked = spark.createDataFrame([("u", "1"), ("u", "1"), ("u", "2"), ("v", "2")], "user_id string, record_id string")
    once = writes.marked_worn(wear, asked, date(2026, 8, 5), datetime(2026, 8, 5))
    twice = writes.marked_worn(once, asked, date(2026, 8, 5), datetime(2026, 8, 5))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert {r["record_id"]: r["status"] for r in once.collect()} == {"1": "worn", "2": "planned"}


def test_sums_keep_small_and_large_numbers(spark):
    from closetlake.functions.values import exact_sum

    def total(*xs):
        return spark.createDataFrame([(x,) for x in xs], "x double").agg(exact_sum("x")).first()[0]

    assert total(1e-7, 2e-7) == pytest.approx(3e-7) and total(1e19, 1.5) == pytest.approx(1e19)
    assert total(0.1, 0.2) == 0.3 and total(None) is None


def test_eligible_garment_without_title_is_still_most_repeated(spark):
    from closetlake.operators import report

    items = spark.createDataFrame([(1, "i1", None, None, None)], "user_id long, item_id string, title string, type string, hidden_from_ai boolean")
    worn = spark.createDataFrame([(1, "r1", 0, "i1", 3)], "user_id long, record_id string, pos int, item_id string, days_ago int")
    got = report.most_repeated(items, worn).collect()
    assert [(r["most_repeated_id"], r["most_repeated"]) for r in got] == [("i1", None)]


def test_forbidden_wording_is_plain_text(spark):
    from closetlake.operators.page_checks import forbidden_wording

    pages = spark.createDataFrame([(1, "x A+B y"), (2, "aab")], "page_id int, html string")
    assert [r["page_id"] for r in forbidden_wording(pages, ["a+b"]).collect()] == [1]


def test_deep_page_orders_few_rows(spark):
    from closetlake.operators.paging import page

    df = spark.range(0, 5000).select("id", (F.col("id") * 7_000_000_000).alias("at"))
    got = page(df, [F.col("at"), F.col("id")], 10**12, 30).collect()
    assert sorted(r["id"] for r in got) == list(range(4980, 5000)) and {r["page"] for r in got} == {167}
    assert sorted(r["row_no"] for r in got) == list(range(4981, 5001))


def test_one_instant_is_paged_in_small_parts(spark, monkeypatch):
    """100,000 rows of one instant and some beside it; order by a text or a number after it."""
    from closetlake.operators import paging

    monkeypatch.setattr(paging, "MOST_ROWS", 500)
    df = spark.range(0, 100_000).select(
        F.when(F.col("id") < 99_990, 5).otherwise(F.col("id") - 99_980).cast("long").alias("at"), F.concat(F.lit("wardrobe:"), F.col("id").cast("string")).alias("name"), (F.col("id") * 31).alias("id"))
    rows = df.collect()
    for column in ("name", "id"):
        ordered = sorted(rows, key=lambda r: (r["at"], r[column]))
        for number in (1, 777, 3333, 10**9):
            got = sorted(paging.page(df, [F.col("at"), F.col(column)], number, 30).collect(), key=lambda r: r["row_no"])
            at = min(number, 3334)
            assert [r["id"] for r in got] == [r["id"] for r in ordered[(at - 1) * 30: at * 30]]
            assert [r["row_no"] for r in got] == list(range((at - 1) * 30 + 1, min(at * 30, 100_000) + 1)) and {r["page_count"] for r in got} == {3334}
    kept, start = paging._from_start(df, [F.col("at"), F.col("name")], 50_000, 50_030)
    assert df.filter(kept).count() <= 500 + 30 and 50_000 - 500 <= start <= 50_000


def test_kept_counts_save_a_pass(spark):
    from closetlake.operators import activity

    feed = spark.range(0, 300).select(
        (F.timestamp_seconds(F.col("id") * 7000)).alias("time"), F.col("id").cast("string").alias("event_id"), F.lit("x").alias("label"), F.lit("ai").alias("type"))
    counts = spark.createDataFrame(activity.feed_counts(feed).collect(), activity.feed_counts(feed).schema)
    assert sorted(map(str, activity.feed_page(feed, 4, counts).collect())) == sorted(map(str, activity.feed_page(feed, 4).collect()))
    changed = counts.withColumn("n", F.col("n") * 2)
    assert activity.feed_page(feed, 4, changed).first()["page_count"] == 20


@pytest.mark.parametrize("given, want", [
    ("HTTPS://Me:Secret@EXAMPLE.com:443/A/./b/../C?Q=../x#F", "https://Me:Secret@example.com/A/C?Q=../x#F"), ("http://a.b:80", "http://a.b/"), ("http://a.b:0443/x/..", "http://a.b:443/"),
    ("https://a.b:80/x/.", "https://a.b:80/x/"), ("http://a.b/../../c", "http://a.b/c"), ("http://a.b/%2e%2E/c/%2e", "http://a.b/c/"), ("http://a.b:99999/", ""), ("ftp://a.b/", ""), ("http:///x", ""),
    ("  http://A.B?x  ", "http://a.b/?x"), ("http://a.b//x//", "http://a.b//x//"), (None, ""), ("http://[2001:DB8::1]:80/", "http://[2001:db8::1]/"), ("http://a.b:/", "http://a.b/"),
])
def test_addresses_are_normalised(spark, given, want):
    from closetlake.functions.text import web_url

    assert spark.createDataFrame([(given,)], "u string").select(web_url("u").alias("u")).first()["u"] == want


def test_instants_of_all_forms(spark):
    from closetlake.functions.calendar import instant

    rows = [(1, None, None), (None, "1970-01-01T00:00:02Z", None), (None, None, 3500), (1, "1970-01-01T00:00:02Z", 3500), (None, "1970-01-01T00:00:02Z", 3500), (None, "soon", None), (None, None, -1)]
    df = spark.createDataFrame(rows, "s long, iso string, ms long")
    got = [r[0] for r in df.select(F.unix_millis(instant("s", "iso", "ms"))).collect()]
    assert got == [1000, 2000, 3500, 1000, 3500, None, -1]


def test_runs_of_bitmaps_equal_runs_of_days(spark):
    import random
    from datetime import date, timedelta

    from closetlake.operators import increments, quests

    rng, rows = random.Random(9), []
    for user in range(60):
        at = date(2023, 11, 20) + timedelta(days=rng.randint(0, 40))
        for _ in range(rng.randint(1, 12)):
            n = rng.choice([1, 2, 5, 31, 70])
            rows += [(user, at + timedelta(days=k)) for k in range(n)] * rng.choice([1, 1, 2])
            at += timedelta(days=n + rng.choice([1, 2, 25, 61]))
    rows += [(100, date(2024, 2, 29)), (100, date(2024, 3, 1)), (100, date(2024, 2, 28)), (101, None), (None, date(2024, 3, 5))]
    df = spark.createDataFrame(rows, "user_id long, challenge_date date")
    parts = [df.sample(0.6, seed=k) for k in (1, 2)] + [df]
    merged = increments.merged_bitmaps(*[increments.month_bitmaps(p, "challenge_date") for p in parts])
    for as_of in (date(2024, 3, 2), date(2024, 3, 5), date(2023, 12, 31)):
        want = {(r["user_id"], r["streak"], r["longest_streak"]) for r in quests.streaks(df, as_of).collect()}
        assert {(r["user_id"], r["streak"], r["longest_streak"]) for r in increments.streaks_of(merged, as_of).collect()} == want
    for start, end in ((None, None), (date(2024, 1, 31), date(2024, 3, 1)), (date(2030, 1, 1), None), (date(2024, 2, 10), date(2024, 2, 5))):
        inside = {(u, d) for u, d in rows if d and (not start or d >= start) and (not end or d <= end)}
        got = {r["user_id"]: r["active_days"] for r in increments.active_days(merged, start, end).collect()}
        assert got == {u: sum(1 for x, _ in inside if x == u) for u, _ in inside}


def test_late_and_repeated_events_change_nothing_twice(spark):
    from datetime import datetime

    from closetlake.operators import activity, increments

    rows = [("a", "1", datetime(2024, 1, 31, 10), 1), ("b", "1", datetime(2024, 2, 1, 1), 2), ("c", None, datetime(2024, 2, 1, 2), 2), ("a", "1", datetime(2024, 1, 31, 10), 3), ("d", "2", datetime(2023, 5, 5), 3)]
    feed = spark.createDataFrame(rows, "event_id string, user_id string, time timestamp, arrived int")
    users = spark.createDataFrame([("1",), ("3",)], "user_id string")
    state = increments.empty_state(spark)
    assert tuple(increments.summary_of(state, users).first()) == (0, 0, 0)
    for mark in (None, 1, 2):
        state = increments.advanced(state, increments.arrived_after(feed, "arrived", mark))
    whole = activity.feed_summary(feed.dropDuplicates(["event_id"]), users).first()
    assert increments.summary_of(state, users).first() == whole and state.ledger.count() == 4
    plan = increments.summary_of(state, users)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_results_in_one_pass_equal_those_of_examples(spark):
    import json

    rows = []
    for k in range(40):
        examples = [{"itemIds": [f"i{(k + n * m) % 23}" for n in range(m % 5)] + ["no", None][: k % 3], "explanation": "x"} for m in range(k)]
        body = {"verdict": ["strong_buy", "odd", None][k % 3], "summary": "<s>" * k, "reasons": ["a", "", "b"] * k, "outfitExamples": examples if k % 7 else None}
        rows.append((f"u{k % 2}", f"r{k}", json.dumps(body) if k % 9 else "not json"))
    df = spark.createDataFrame(rows, "user_id string, result_id string, raw string")
    items = spark.createDataFrame([(u, f"i{n}") for u in ("u0", "u1") for n in range(12)], "user_id string, item_id string")
    parsed = grounding.parsed_results(df)
    one = grounding.checked_results(parsed, items)
    two = grounding.sanitized_results(parsed, grounding.grounded_examples(parsed, items))
    assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
