"""Looks and the weekly report."""

from pyspark.sql import functions as F

from closetlake.functions.taxonomy import with_taxonomy
from closetlake.operators import looks, report
from verification.queries_garments import TAXONOMY
from verification.registry import AS_OF, query

D = "DATE '1998-06-30'"
ELIGIBLE = "coalesce(type, '') <> 'lookbook' AND NOT coalesce(hidden_from_ai, false)"
NEGLECT = f"laundry_status = 'Clean' AND (last_worn IS NULL OR last_worn < {D} - 45)"

# Common table expressions the oracles below are composed of.
WORN = f"""worn AS (
  SELECT w.user_id, w.record_id, w.wear_date, i.pos, i.item_id
  FROM {{v_wear}} w JOIN {{v_wear_items}} i ON w.user_id = i.user_id AND w.record_id = i.record_id
  WHERE w.status = 'worn' AND w.wear_date BETWEEN {D} - 6 AND {D})"""
SEEN = """seen AS (
  SELECT user_id, item_id, count(*) AS wears FROM worn GROUP BY user_id, item_id),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id
    ORDER BY wear_date DESC, record_id, pos) AS rn FROM worn) WHERE rn = 1)"""
NEGLECTED = f"""neg AS (
  SELECT user_id, item_id, title, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(times_worn, 0), created_at DESC, item_id) AS rank
    FROM {{v_items}} WHERE {ELIGIBLE} AND {NEGLECT}) WHERE rank <= 6)"""
MOST = f"""most AS (
  SELECT t.user_id, e.item_id AS most_repeated_id, e.title AS most_repeated FROM (
    SELECT s.user_id, s.item_id, row_number() OVER (PARTITION BY s.user_id
      ORDER BY s.wears DESC, f.wear_date DESC, f.record_id, f.pos) AS rn
    FROM seen s JOIN firsts f ON s.user_id = f.user_id AND s.item_id = f.item_id) t
  LEFT JOIN (SELECT * FROM {{v_items}} WHERE {ELIGIBLE}) e ON t.user_id = e.user_id AND t.item_id = e.item_id
  WHERE t.rn = 1)"""
BEST = f"""best AS (
  SELECT user_id, item_id AS best_value_id, title AS best_value,
         CAST(round(purchase_price / times_worn) AS BIGINT) AS best_value_cost FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY purchase_price / times_worn, created_at DESC, item_id) AS rn
    FROM {{v_items}} WHERE {ELIGIBLE} AND purchase_price > 0 AND times_worn > 0) WHERE rn = 1)"""
COLORS = f"""colors AS (
  SELECT user_id, rank, primary_color, wears FROM (
    SELECT user_id, primary_color, count(*) AS wears,
           row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(ord)) AS rank
    FROM (SELECT w.user_id, e.primary_color,
            row_number() OVER (PARTITION BY w.user_id ORDER BY w.wear_date DESC, w.record_id, w.pos) AS ord
          FROM worn w JOIN (SELECT * FROM {{v_items}} WHERE {ELIGIBLE} AND primary_color <> '') e
            ON w.user_id = e.user_id AND w.item_id = e.item_id) GROUP BY user_id, primary_color) WHERE rank <= 4)"""
SUGGESTED = """hits AS (
  SELECT DISTINCT l.user_id, l.look_id FROM {v_look_items} l JOIN neg ON l.user_id = neg.user_id AND l.item_id = neg.item_id),
suggested AS (
  SELECT user_id, look_id AS suggested_look_id, has_neglected FROM (
    SELECT l.user_id, l.look_id, h.look_id IS NOT NULL AS has_neglected, row_number() OVER (
      PARTITION BY l.user_id ORDER BY h.look_id IS NOT NULL DESC, l.created_at DESC, l.look_id) AS rn
    FROM {v_looks} l LEFT JOIN hits h ON l.user_id = h.user_id AND l.look_id = h.look_id) WHERE rn = 1)"""
USAGE = f"""usage AS (
  SELECT u.user_id, coalesce(t.n, 0) AS total_items, coalesce(d.n, 0) AS outfit_days, coalesce(x.n, 0) AS worn_items,
         CAST(CASE WHEN t.n > 0 THEN round(coalesce(x.n, 0) / t.n * 100) ELSE 0 END AS BIGINT) AS usage_percent
  FROM {{v_users}} u
  LEFT JOIN (SELECT user_id, count(*) AS n FROM {{v_items}} WHERE {ELIGIBLE} GROUP BY user_id) t ON u.user_id = t.user_id
  LEFT JOIN (SELECT user_id, count(DISTINCT wear_date) AS n FROM {{v_wear}}
             WHERE status = 'worn' AND wear_date BETWEEN {D} - 6 AND {D} GROUP BY user_id) d ON u.user_id = d.user_id
  LEFT JOIN (SELECT user_id, count(DISTINCT item_id) AS n FROM worn GROUP BY user_id) x ON u.user_id = x.user_id)"""


@query("look_garments", "C1", """
SELECT l.user_id, l.look_id, l.pos, l.item_id, i.title, i.primary_color
FROM {v_look_items} l JOIN {v_items} i ON l.user_id = i.user_id AND l.item_id = i.item_id""")
def _(t):
    return looks.look_garments(t.v_look_items, t.v_items, ["title", "primary_color"])


@query("resolved_wear_ids", "C2", """
SELECT user_id, record_id, pos, item_id FROM {v_wear_items}
UNION ALL
SELECT w.user_id, w.record_id, l.pos, l.item_id
FROM {v_wear} w JOIN {v_look_items} l ON w.user_id = l.user_id AND w.outfit_id = l.look_id
WHERE NOT EXISTS (SELECT 1 FROM {v_wear_items} i WHERE i.user_id = w.user_id AND i.record_id = w.record_id)""")
def _(t):
    return looks.resolved_ids(t.v_wear, t.v_wear_items, t.v_look_items)


@query("look_cards", "B4", """
SELECT l.user_id, l.look_id,
       CASE WHEN l.lookbook THEN 'Created look' WHEN l.source = 'style_challenge' THEN 'Closet Quest'
            ELSE 'AI recommendation' END AS label, coalesce(p.n, 0) AS pieces
FROM {v_looks} l LEFT JOIN (
  SELECT x.user_id, x.look_id, count(*) AS n FROM {v_look_items} x
  JOIN {v_items} i ON x.user_id = i.user_id AND x.item_id = i.item_id GROUP BY x.user_id, x.look_id) p
ON l.user_id = p.user_id AND l.look_id = p.look_id""")
def _(t):
    return looks.look_cards(t.v_looks, t.v_look_items, t.v_items)


THUMBS = """
SELECT user_id, look_id, thumb_no, item_id, title FROM (
  SELECT l.user_id, l.look_id, l.item_id, i.title,
         row_number() OVER (PARTITION BY l.user_id, l.look_id ORDER BY l.pos, l.item_id) AS thumb_no
  FROM {{v_look_items}} l JOIN {{v_items}} i ON l.user_id = i.user_id AND l.item_id = i.item_id)
WHERE thumb_no <= {n}"""


@query("look_card_thumbnails", "F10", THUMBS.format(n=4))
def _(t):
    return looks.thumbnails(t.v_look_items, t.v_items, 4)


@query("home_look_thumbnails", "F10", THUMBS.format(n=3))
def _(t):
    return looks.thumbnails(t.v_look_items, t.v_items, 3)


@query("outfit_library", "B3", """
SELECT 'all' AS library, user_id, look_id FROM {v_looks}
UNION ALL SELECT 'lookbook', user_id, look_id FROM {v_looks} WHERE lookbook
UNION ALL SELECT 'ai', user_id, look_id FROM {v_looks} WHERE NOT lookbook AND coalesce(source, '') <> 'style_challenge'
UNION ALL SELECT 'challenge', user_id, look_id FROM {v_looks} WHERE source = 'style_challenge'""")
def _(t):
    views = ["all", "lookbook", "ai", "challenge"]
    shown = F.array_compact(F.array(*[F.when(looks.in_library(v), v) for v in views]))
    return t.v_looks.select(F.explode(shown).alias("library"), "user_id", "look_id")


@query("unknown_look_ids", "C13", """
SELECT l.user_id, count(i.item_id) = count(*) AS all_known, count(*) - count(i.item_id) AS missing_refs
FROM {v_look_items} l LEFT JOIN {v_items} i ON l.user_id = i.user_id AND l.item_id = i.item_id
GROUP BY l.user_id""")
def _(t):
    return looks.owners_all_known(t.v_look_items, t.v_items)


@query("grounded_look_ids", "C14,G5", """
SELECT l.user_id, l.look_id, min(l.pos) AS pos, l.item_id
FROM {v_look_items} l JOIN {v_items} i ON l.user_id = i.user_id AND l.item_id = i.item_id
GROUP BY l.user_id, l.look_id, l.item_id""")
def _(t):
    return looks.grounded_ids(t.v_look_items, t.v_items, "look_id")


@query("weekly_usage", "B8,D9,D10,D11,D12", f"WITH {WORN}, {USAGE} SELECT * FROM usage")
def _(t):
    return report.weekly_usage(t.v_users, t.v_items, t.v_wear, t.v_wear_items, AS_OF)


@query("weekly_item_wears", "D13", f"WITH {WORN} SELECT user_id, item_id, count(*) AS wears FROM worn GROUP BY user_id, item_id")
def _(t):
    worn = report.weekly_worn_items(t.v_wear, t.v_wear_items, AS_OF)
    return report.weekly_item_wears(worn).drop("first_seen")


@query("weekly_most_repeated", "D14", f"WITH {WORN}, {SEEN}, {MOST} SELECT * FROM most")
def _(t):
    return report.most_repeated(t.v_items, report.weekly_worn_items(t.v_wear, t.v_wear_items, AS_OF))


@query("weekly_best_value", "D15", f"WITH {BEST} SELECT * FROM best")
def _(t):
    return report.best_value(t.v_items)


@query("weekly_useful_colors", "C9,D16,F7", f"WITH {WORN}, {COLORS} SELECT * FROM colors")
def _(t):
    return report.useful_colors(t.v_items, report.weekly_worn_items(t.v_wear, t.v_wear_items, AS_OF))


@query("neglected_garments", "B7,F5,E2", f"WITH {NEGLECTED} SELECT * FROM neg")
def _(t):
    return report.neglected_items(t.v_items, AS_OF)


@query("looks_with_neglected", "C10,G4", f"WITH {NEGLECTED}, {SUGGESTED} SELECT * FROM hits")
def _(t):
    return report.looks_with_neglected(t.v_look_items, report.neglected_items(t.v_items, AS_OF))


@query("weekly_suggested_look", "D17", f"WITH {NEGLECTED}, {SUGGESTED} SELECT * FROM suggested")
def _(t):
    return report.suggested_look(t.v_looks, t.v_look_items, t.v_items, AS_OF)


@query("weekly_report", "D9-D17", f"""
WITH {WORN}, {SEEN}, {USAGE}, {MOST}, {BEST}, {NEGLECTED}, {COLORS}, {SUGGESTED}
SELECT usage.*, most_repeated_id, most_repeated, best_value_id, best_value, best_value_cost,
       coalesce(n.n, 0) AS neglected, c.colors, suggested_look_id, has_neglected, {D} - 6 AS since, {D} AS until
FROM usage LEFT JOIN most USING (user_id) LEFT JOIN best USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n FROM neg GROUP BY user_id) n USING (user_id)
LEFT JOIN (SELECT user_id, string_agg(primary_color, ', ' ORDER BY rank) AS colors FROM colors GROUP BY user_id) c USING (user_id)
LEFT JOIN suggested USING (user_id)""")
def _(t):
    return report.weekly_report(
        t.v_users, t.v_items, t.v_wear, t.v_wear_items, t.v_looks, t.v_look_items, AS_OF
    )


@query("exclusive_look_picks", "H27", f"""
WITH {TAXONOMY},
picks AS (SELECT l.user_id, l.look_id, l.pos, l.item_id, t.slot FROM {{v_look_items}} l
  JOIN tax t ON l.user_id = t.user_id AND l.item_id = t.item_id),
newest AS (SELECT user_id, look_id, max(pos) FILTER (slot = 'hero') AS hero,
  max(pos) FILTER (slot IN ('top', 'bottom', 'layer')) AS parts FROM picks GROUP BY user_id, look_id),
last AS (SELECT user_id, look_id, slot, max(pos) AS pos, arg_max(item_id, pos) AS item_id FROM picks GROUP BY user_id, look_id, slot)
SELECT l.user_id, l.look_id, l.slot, l.item_id FROM last l JOIN newest n ON l.user_id = n.user_id AND l.look_id = n.look_id
WHERE slot IN ('footwear', 'accessory') OR (slot = 'hero' AND n.hero > coalesce(n.parts, -1))
  OR (slot IN ('top', 'bottom', 'layer') AND l.pos > coalesce(n.hero, -1))""")
def _(t):
    slots = with_taxonomy(t.v_garments).select("user_id", "item_id", "slot")
    return looks.exclusive_picks(t.v_look_items.join(slots, ["user_id", "item_id"]))
