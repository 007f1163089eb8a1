"""Dashboard figures, calendar and quests."""

from datetime import date

from pyspark.sql import functions as F

from closetlake.functions.calendar import leading_blanks, shift_month
from closetlake.functions.values import cost_per_wear, points
from closetlake.operators import increments, insights, quests
from verification.registry import AS_OF, query

D = "DATE '1998-06-30'"
E = "DATE '2024-01-30'"
MONTH = date(1998, 6, 1)
POINTS = "CASE WHEN coalesce(points_earned, 0) <> 0 THEN points_earned ELSE coalesce(score_total, 0) END"


@query("home_stats", "D19", f"""
SELECT u.user_id, coalesce(i.garments, 0) AS garments, coalesce(i.favorites, 0) AS favorites,
       coalesce(i.lb, 0) + coalesce(l.n, 0) AS lookbook, coalesce(w.planned, 0) AS planned,
       coalesce(w.wears, 0) AS wears, coalesce(q.points, 0) AS points
FROM {{v_users}} u
LEFT JOIN (SELECT user_id, count(*) AS garments, count(*) FILTER (favorite) AS favorites,
             count(*) FILTER (coalesce(in_lookbook, type = 'lookbook', false)) AS lb FROM {{v_items}} GROUP BY user_id) i USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n FROM {{v_looks}} GROUP BY user_id) l USING (user_id)
LEFT JOIN (SELECT user_id, count(*) FILTER (status = 'planned' AND wear_date >= {D}) AS planned,
             count(*) FILTER (status = 'worn') AS wears FROM {{v_wear}} GROUP BY user_id) w USING (user_id)
LEFT JOIN (SELECT user_id, CAST(sum({POINTS}) AS BIGINT) AS points FROM {{v_quest}} GROUP BY user_id) q USING (user_id)""")
def _(t):
    return insights.home_stats(t.v_users, t.v_items, t.v_looks, t.v_wear, t.v_quest, AS_OF)


@query("quest_points", "D22", f"SELECT submission_id, {POINTS} AS points FROM {{v_quest}}")
def _(t):
    return t.v_quest.select("submission_id", points("points_earned", "score_total").alias("points"))


@query("insight_summary", "D20", """
SELECT u.user_id, coalesce(i.v, 0.0) AS tracked_value, coalesce(i.w, 0) AS garment_wears,
       coalesce(w.worn, 0) AS worn_outfits, coalesce(w.planned, 0) AS planned_looks
FROM {v_users} u
LEFT JOIN (SELECT user_id, CAST(sum(CAST(purchase_price AS DECIMAL(24,6))) FILTER (purchase_price > 0) AS DOUBLE) AS v,
             CAST(sum(coalesce(times_worn, 0)) AS BIGINT) AS w FROM {v_items} GROUP BY user_id) i USING (user_id)
LEFT JOIN (SELECT user_id, count(*) FILTER (status = 'worn') AS worn, count(*) FILTER (status = 'planned') AS planned
           FROM {v_wear} GROUP BY user_id) w USING (user_id)""")
def _(t):
    return insights.insight_summary(t.v_users, t.v_items, t.v_wear)


@query("wear_value", "M3", """
SELECT user_id, CAST(sum(CAST(purchase_price AS DECIMAL(24,6))) FILTER (purchase_price > 0 AND times_worn > 0) AS DOUBLE)
                / sum(times_worn) FILTER (purchase_price > 0 AND times_worn > 0) AS average_cost_per_wear,
       count(*) FILTER (purchase_price > 0 AND coalesce(times_worn, 0) = 0) AS never_worn_priced
FROM {v_items} GROUP BY user_id""")
def _(t):
    return insights.wear_value(t.v_items)


@query("wear_extremes", "M3", """
SELECT user_id, item_id, times_worn, rank, list FROM (
  SELECT user_id, item_id, coalesce(times_worn, 0) AS times_worn, 'most_worn' AS list,
         row_number() OVER (PARTITION BY user_id ORDER BY coalesce(times_worn, 0) DESC, item_id) AS rank FROM {v_items}
  UNION ALL
  SELECT user_id, item_id, coalesce(times_worn, 0), 'least_worn',
         row_number() OVER (PARTITION BY user_id ORDER BY coalesce(times_worn, 0), item_id) FROM {v_items})
WHERE rank <= 5""")
def _(t):
    return insights.wear_extremes(t.v_items, 5)


NEXT = f"""
SELECT user_id, record_id AS next_record_id, wear_date AS next_date FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY wear_date, record_id) AS rn
  FROM {{v_wear}} WHERE status = 'planned' AND wear_date >= {D}) WHERE rn = 1"""


@query("next_plan", "F15", NEXT)
def _(t):
    return insights.next_plan(t.v_wear, AS_OF)


@query("home_cards", "D23", f"""
SELECT u.user_id, coalesce(i.underused, 0) AS underused, coalesce(i.clean, 0) AS clean,
       coalesce(h.n, 0) AS analyses, n.next_record_id, n.next_date
FROM {{v_users}} u
LEFT JOIN (SELECT user_id, count(*) FILTER (coalesce(times_worn, 0) = 0) AS underused,
             count(*) FILTER (laundry_status = 'Clean') AS clean FROM {{v_items}} GROUP BY user_id) i USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n FROM {{v_outfit_history}} GROUP BY user_id) h USING (user_id)
LEFT JOIN ({NEXT}) n USING (user_id)""")
def _(t):
    return insights.home_cards(t.v_users, t.v_items, t.v_wear, t.v_outfit_history, AS_OF)


@query("upcoming_plans", "B9", f"SELECT user_id, record_id FROM {{v_wear}} WHERE status = 'planned' AND wear_date >= {D}")
def _(t):
    return t.v_wear.filter(insights.upcoming(AS_OF)).select("user_id", "record_id")


@query("wear_history", "F2", """
SELECT user_id, rank, record_id, wear_date, status FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY wear_date DESC, record_id) AS rank FROM {v_wear}) WHERE rank <= 30""")
def _(t):
    return insights.wear_history(t.v_wear)


@query("month_plan_count", "D21", """
SELECT user_id, CAST(date_trunc('month', wear_date) AS DATE) AS month, count(DISTINCT wear_date) AS planned_days
FROM {v_wear} WHERE status = 'planned' GROUP BY ALL""")
def _(t):
    return insights.month_plan_count(t.v_wear)


@query("records_per_day", "D26", "SELECT user_id, wear_date, count(*) AS records FROM {v_wear} GROUP BY ALL")
def _(t):
    return insights.records_per_day(t.v_wear)


@query("calendar_grid", "C12,H10", """
SELECT u.user_id, d.day, CAST(dayofweek(DATE '1998-06-01') + dayofmonth(d.day) - 1 AS INT) AS cell, coalesce(w.n, 0) AS records
FROM {v_users} u
CROSS JOIN (SELECT CAST(unnest(range(DATE '1998-06-01', DATE '1998-07-01', INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN (SELECT user_id, wear_date, count(*) AS n FROM {v_wear} GROUP BY ALL) w
  ON w.user_id = u.user_id AND w.wear_date = d.day""")
def _(t):
    return insights.calendar_grid(t.v_users, t.v_wear, MONTH)


@query("day_thumbnails", "F9", """
SELECT x.user_id, x.wear_date AS day, x.thumb_no, x.item_id, i.title FROM (
  SELECT user_id, wear_date, item_id, row_number() OVER (PARTITION BY user_id, wear_date ORDER BY ord) AS thumb_no
  FROM (SELECT user_id, wear_date, item_id, min(ord) AS ord FROM (SELECT w.user_id, w.wear_date, p.item_id,
          row_number() OVER (PARTITION BY w.user_id, w.wear_date ORDER BY w.record_id, p.pos) AS ord
        FROM {v_wear} w JOIN {v_wear_items} p ON w.user_id = p.user_id AND w.record_id = p.record_id
        WHERE w.wear_date BETWEEN DATE '1998-06-01' AND DATE '1998-06-30') GROUP BY ALL)) x
JOIN {v_items} i ON x.user_id = i.user_id AND x.item_id = i.item_id WHERE x.thumb_no <= 2""")
def _(t):
    return insights.day_thumbnails(t.v_wear, t.v_wear_items, t.v_items, MONTH)


@query("shifted_months", "H9,H10", """
SELECT record_id, CAST(wear_date + INTERVAL 1 MONTH AS DATE) AS next_month, CAST(wear_date - INTERVAL 2 MONTH AS DATE) AS two_back,
       CAST(date_trunc('month', created_at) + INTERVAL 1 MONTH AS DATE) AS from_display,
       CAST(dayofweek(date_trunc('month', wear_date)) AS INT) AS blanks
FROM {v_wear}""")
def _(t):
    picked = F.date_format("wear_date", "yyyy-MM-dd")
    return t.v_wear.select(
        "record_id", shift_month(picked, "created_at", 1).alias("next_month"),
        shift_month(picked, "created_at", -2).alias("two_back"),
        shift_month(F.lit("none"), "created_at", 1).alias("from_display"),
        leading_blanks("wear_date").alias("blanks"),
    )


ISLANDS = """days AS (SELECT DISTINCT user_id, challenge_date AS d FROM {v_quest}),
runs AS (SELECT user_id, count(*) AS n, max(d) AS ends FROM (
  SELECT user_id, d, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INT) AS g FROM days) GROUP BY user_id, g),
streaks AS (SELECT user_id, max(n) AS longest_streak,
  CASE WHEN date_diff('day', max(ends), DATE '2024-01-30') <= 1 THEN arg_max(n, ends) ELSE 0 END AS streak FROM runs GROUP BY user_id)"""
SUMMARY = f"""summary AS (
  SELECT u.user_id, coalesce(q.points, 0) AS points, coalesce(q.quests, 0) AS quests, coalesce(q.best, 0) AS best_score,
         coalesce(s.streak, 0) AS streak
  FROM {{v_users}} u LEFT JOIN (
    SELECT user_id, CAST(sum({POINTS}) AS BIGINT) AS points, count(*) AS quests, greatest(0, max(score_total)) AS best
    FROM {{v_quest}} GROUP BY user_id) q USING (user_id) LEFT JOIN streaks s USING (user_id))"""


@query("quest_streaks", "E1,M5", f"WITH {ISLANDS} SELECT user_id, streak, longest_streak FROM streaks")
def _(t):
    return quests.streaks(t.v_quest, date(2024, 1, 30))


@query("quest_streaks_of_bitmaps", "E1,D22", f"WITH {ISLANDS} SELECT user_id, streak, longest_streak FROM streaks")
def _(t):
    """Bitmaps of overlapping parts of the quests, merged in another order than they came."""
    days = t.v_quest.select("user_id", F.col("challenge_date").alias("day"), F.expr("submission_id % 4").alias("part"))
    parts = [increments.month_bitmaps(days.filter(f"part {x}")) for x in ("= 3", "< 2", "> 0")]
    return increments.streaks_of(increments.merged_bitmaps(*parts), date(2024, 1, 30))


@query("quest_summary", "D22", f"WITH {ISLANDS}, {SUMMARY} SELECT * FROM summary")
def _(t):
    return quests.quest_summary(t.v_users, t.v_quest, date(2024, 1, 30))


@query("quest_badges", "D22", f"""
WITH {ISLANDS}, {SUMMARY}
SELECT user_id, 'First Quest' AS badge, 1 AS goal, quests >= 1 AS earned, least(quests, 1) AS progress FROM summary
UNION ALL SELECT user_id, 'Style Spark', 250, points >= 250, least(points, 250) FROM summary
UNION ALL SELECT user_id, 'On Fire', 3, streak >= 3, least(streak, 3) FROM summary
UNION ALL SELECT user_id, 'Perfect Week', 7, streak >= 7, least(streak, 7) FROM summary
UNION ALL SELECT user_id, 'Style Master', 90, best_score >= 90, least(best_score, 90) FROM summary
UNION ALL SELECT user_id, 'Quest Legend', 25, quests >= 25, least(quests, 25) FROM summary""")
def _(t):
    return quests.badges(quests.quest_summary(t.v_users, t.v_quest, date(2024, 1, 30)))


@query("quest_week_activity", "M5", f"""
SELECT u.user_id, d.challenge_date, q.user_id IS NOT NULL AS done
FROM (SELECT DISTINCT user_id FROM {{v_quest}}) u
CROSS JOIN (SELECT CAST(unnest(range({E} - 6, {E} + 1, INTERVAL 1 DAY)) AS DATE) AS challenge_date) d
LEFT JOIN (SELECT DISTINCT user_id, challenge_date FROM {{v_quest}}) q
  ON q.user_id = u.user_id AND q.challenge_date = d.challenge_date""")
def _(t):
    return quests.week_activity(t.v_quest, date(2024, 1, 30))


@query("quest_eligible_users", "M6", "SELECT user_id, count(*) AS garments FROM {v_items} GROUP BY user_id HAVING count(*) >= 10")
def _(t):
    return quests.quest_eligible(t.v_items)


@query("garment_cost_per_wear", "H26", """
SELECT user_id, item_id, CASE WHEN purchase_price > 0 AND times_worn > 0 THEN purchase_price / times_worn END AS cost
FROM {v_items}""")
def _(t):
    return t.v_items.select("user_id", "item_id", cost_per_wear("purchase_price", "times_worn").alias("cost"))


# Pieces of records, own or of the saved look, and the first owned ones of each as one text.
PREVIEW = """pieces AS (
  SELECT user_id, record_id, pos, item_id FROM own
  UNION ALL
  SELECT r.user_id, r.record_id, l.pos, l.item_id FROM records r JOIN {{v_look_items}} l ON l.user_id = r.user_id AND l.look_id = r.outfit_id
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = r.user_id AND o.record_id = r.record_id)),
previews AS (
  SELECT user_id, record_id, string_agg(item_id || ' ' || title, '|' ORDER BY n) AS preview FROM (
    SELECT p.user_id, p.record_id, i.item_id, i.title, row_number() OVER (PARTITION BY p.user_id, p.record_id ORDER BY p.pos, p.item_id) AS n
    FROM pieces p JOIN records r ON r.user_id = p.user_id AND r.record_id = p.record_id
    JOIN {{v_items}} i ON i.user_id = p.user_id AND i.item_id = p.item_id) WHERE n <= {n} GROUP BY user_id, record_id)"""


def preview_text(rows):
    shown = F.transform("preview", lambda x: F.concat_ws(" ", x["item_id"].cast("string"), x["title"]))
    return rows.withColumn("preview", F.when(F.col("preview").isNotNull(), F.array_join(shown, "|")))


DAY_WEAR = """
SELECT user_id, record_id, outfit_id, wear_date, CASE WHEN outfit_id % 8 <> 0 THEN status END AS status,
  CASE outfit_id % 3 WHEN 0 THEN 'Office' WHEN 1 THEN '' END AS occasion,
  CASE WHEN outfit_id % 5 = 0 THEN 'Look ' || CAST(outfit_id AS STRING) END AS outfit_title,
  CASE WHEN outfit_id % 4 = 0 THEN 'rainy' END AS notes
FROM {v_wear}"""
SELECTED = "SELECT user_id, max(wear_date) AS wear_date FROM {v_wear} GROUP BY user_id"


@query("selected_day_cards", "C1,C2", f"""
WITH records AS (SELECT w.* FROM ({DAY_WEAR}) w JOIN ({SELECTED}) s ON s.user_id = w.user_id AND s.wear_date = w.wear_date),
own AS (SELECT user_id, record_id, pos, item_id FROM {{v_wear_items}}),
{PREVIEW.format(n=4)}
SELECT r.user_id, r.record_id, r.wear_date, coalesce(r.status, 'planned') AS status,
  coalesce(r.outfit_title, nullif(r.occasion, ''), 'Planned look') AS title, coalesce(nullif(r.occasion, ''), 'General') AS occasion,
  r.notes, coalesce(r.status, 'planned') <> 'worn' AND r.wear_date <= {D} AS can_mark_worn, p.preview
FROM records r LEFT JOIN previews p USING (user_id, record_id)""")
def _(t):
    return preview_text(insights.selected_day_cards(
        t.sql(SELECTED), t.sql(DAY_WEAR), t.v_wear_items, t.v_look_items, t.v_items, AS_OF))


QUESTS = """
SELECT q.*, CASE WHEN q.submission_id % 2 = 0 THEN l.outfit_id END AS outfit_id,
  CASE q.submission_id % 5 WHEN 0 THEN 'Blue day' WHEN 1 THEN '' END AS challenge_title,
  CASE WHEN q.submission_id % 3 = 0 THEN 'Layers' END AS snapshot_title,
  CASE WHEN q.submission_id % 4 = 0 THEN 'Party' END AS snapshot_occasion
FROM {v_quest} q LEFT JOIN (SELECT user_id, max(look_id) AS outfit_id FROM {v_looks} GROUP BY user_id) l ON l.user_id = q.user_id"""
QUEST_ITEMS = """
SELECT q.user_id, q.submission_id, i.item_id AS pos, i.item_id FROM {v_quest} q JOIN {v_items} i ON i.user_id = q.user_id
WHERE q.submission_id % 3 = 0 AND i.item_id % 6 = q.submission_id % 6"""


@query("quest_history", "D22,C2", f"""
WITH records AS (SELECT *, submission_id AS record_id FROM ({QUESTS})),
own AS (SELECT user_id, submission_id AS record_id, pos, item_id FROM ({QUEST_ITEMS})),
{PREVIEW.format(n=4)}
SELECT r.user_id, r.submission_id, r.created_at, r.challenge_date,
  coalesce(nullif(r.challenge_title, ''), r.snapshot_title, 'Closet Quest') AS title, coalesce(r.snapshot_occasion, '') AS occasion,
  coalesce(r.score_total, 0) AS score, coalesce(r.points_earned, 0) AS points, p.preview
FROM records r LEFT JOIN previews p USING (user_id, record_id)""")
def _(t):
    return preview_text(quests.quest_history(t.sql(QUESTS), t.sql(QUEST_ITEMS), t.v_look_items, t.v_items))


TODAY = """
SELECT user_id, max(look_id) AS outfit_id, CASE WHEN user_id % 4 = 0 THEN 'Today ' || CAST(user_id AS STRING) END AS outfit_title,
  CASE WHEN user_id % 4 = 1 THEN 'Cached look' WHEN user_id % 4 = 2 THEN '' END AS title
FROM {v_looks} GROUP BY user_id"""
TODAY_ITEMS = "SELECT user_id, 0 AS pos, min(item_id) AS item_id FROM {v_items} GROUP BY user_id HAVING min(item_id) % 2 = 0"


@query("today_cards", "A5,D23", f"""
WITH records AS (SELECT *, 'today' AS record_id FROM ({TODAY})),
own AS (SELECT user_id, 'today' AS record_id, pos, item_id FROM ({TODAY_ITEMS})),
{PREVIEW.format(n=3)}
SELECT u.user_id, coalesce(r.outfit_title, nullif(r.title, ''), 'No cached outfit for today') AS title, p.preview
FROM {{v_users}} u LEFT JOIN records r USING (user_id) LEFT JOIN previews p USING (user_id)""")
def _(t):
    return preview_text(insights.today_cards(t.v_users, t.sql(TODAY), t.sql(TODAY_ITEMS), t.v_look_items, t.v_items))
