"""Garment taxonomy, search, listings and the purchase check."""

from pyspark.sql import functions as F

from closetlake.functions.search import SYNONYM_GROUPS, matches, query_words, with_search_text
from closetlake.functions.taxonomy import CATEGORY_PATTERNS, SLOT_PATTERNS, taxonomy_values, with_taxonomy
from closetlake.operators import garments, purchase
from closetlake.operators.report import report_eligible
from closetlake.sources import text_index
from verification.registry import query


def category_sql(category="category", sub="sub_category"):
    value = f"lower(concat_ws(' ', coalesce({category}, ''), coalesce({sub}, '')))"
    whens = " ".join(f"WHEN regexp_matches({value}, '{p}') THEN '{c}'" for c, p in CATEGORY_PATTERNS)
    return f"CASE {whens} ELSE 'Top' END"


def slot_sql(words, zone="body_zone", role="layer_role", alone="standalone_outfit"):
    whens = []
    for slot, implied, pattern in SLOT_PATTERNS:
        test = f"regexp_matches({words}, '\\b(?:{pattern})\\b')"
        if implied:
            listed = ", ".join(f"'{c}'" for c in implied)
            test = f"(norm_category IN ({listed}) OR {test})"
        whens.append(f"WHEN {test} THEN '{slot}'")
    return f"""CASE {' '.join(whens)} WHEN {zone} = 'feet' THEN 'footwear'
      WHEN {zone} = 'accessory' OR {role} = 'accessory' THEN 'accessory' WHEN {role} = 'outer' THEN 'layer'
      WHEN {zone} = 'lower_body' THEN 'bottom'
      WHEN {zone} = 'full_body' OR {alone} OR {role} = 'standalone' THEN 'hero' ELSE 'top' END"""


def key_sql(x):
    return f"regexp_replace(replace(lower(coalesce({x}, '')), '&', ' and '), '[^a-z0-9]+', '', 'g')"


def alias_sql(x):
    whens = []
    for group in SYNONYM_GROUPS:
        listed = ", ".join(f"'{w}'" for w in group)
        whens.append(f"WHEN {x} IN ({listed}) THEN [{listed}]")
    return f"(CASE {' '.join(whens)} ELSE [{x}] END)"


TAXONOMY = f"""tax AS (
  SELECT *, {slot_sql('words')} AS slot FROM (
    SELECT *, {category_sql()} AS norm_category,
      lower(concat_ws(' ', category, sub_category, category_role, title, array_to_string(tags, ' '))) AS words
    FROM {{v_garments}}))"""

SEARCH = f"""found AS (
  SELECT *, list_distinct(flatten(list_transform(keys, lambda k: list_concat([k], {alias_sql('k')})))) AS hay FROM (
    SELECT *, list_transform(list_filter(list_concat(
        [title, {category_sql()}, category, sub_category, primary_color, pattern, brand], coalesce(tags, [])),
        lambda v: v <> ''), lambda v: {key_sql('v')}) AS keys FROM {{v_garments}}))"""


def has_sql(words):
    """Every word or one of its synonyms inside one of the search values."""
    tests = []
    for word in words:
        group = next((g for g in SYNONYM_GROUPS if word in g), [word])
        tests.append("(" + " OR ".join(f"array_to_string(hay, ' ') LIKE '%{a}%'" for a in {*group, word}) + ")")
    return " AND ".join(tests)


@query("garment_taxonomy", "H1,H2", f"WITH {TAXONOMY} SELECT user_id, item_id, norm_category, slot FROM tax")
def _(t):
    """Found once for each different value, and looked up for every garment."""
    return with_taxonomy(t.v_garments, taxonomy_values(t.v_garments)).select("user_id", "item_id", "norm_category", "slot")


@query("garment_search_text", "H3,H4,H5", f"""
WITH {SEARCH} SELECT user_id, item_id, array_to_string(list_sort(hay), ' ') AS words FROM found""")
def _(t):
    words = F.array_join(F.array_sort(F.split("search_text", " ")), " ")
    return with_search_text(t.v_garments).select("user_id", "item_id", words.alias("words"))


@query("garment_search", "H6,B1", f"""
WITH {SEARCH}
SELECT 'all' AS shown, user_id, item_id FROM found WHERE {has_sql(['shoes'])}
UNION ALL SELECT 'favorite', user_id, item_id FROM found WHERE favorite AND {has_sql(['tee', 'red'])}
UNION ALL SELECT 'clean', user_id, item_id FROM found WHERE laundry_status = 'Clean' AND {has_sql(['coats', 'brand2'])}""")
def _(t):
    wanted = {"all": "shoes", "favorite": " Tee  RED", "clean": "coats Brand#2"}
    return garments.search_views(t.v_garments, wanted).select("shown", "user_id", "item_id")


@query("lookbook_garments", "B2", """
SELECT user_id, item_id FROM {v_items} WHERE coalesce(in_lookbook, type = 'lookbook', false)""")
def _(t):
    return t.v_items.filter(garments.in_lookbook()).select("user_id", "item_id")


@query("lookbook_search", "B2,H6", f"""
WITH {SEARCH} SELECT user_id, item_id FROM found
WHERE coalesce(in_lookbook, type = 'lookbook', false) AND {has_sql(['coat'])}""")
def _(t):
    return garments.search_garments(t.v_garments.filter(garments.in_lookbook()), "coat").select("user_id", "item_id")


@query("report_eligible_garments", "B5", """
SELECT user_id, item_id FROM {v_items} WHERE coalesce(type, '') <> 'lookbook' AND NOT coalesce(hidden_from_ai, false)""")
def _(t):
    return t.v_items.filter(report_eligible()).select("user_id", "item_id")


@query("purchase_usable_garments", "B6", """
SELECT user_id, item_id FROM {v_items} WHERE NOT coalesce(hidden_from_ai, false) AND coalesce(laundry_status, '') <> 'Laundry'""")
def _(t):
    return t.v_items.filter(garments.purchase_usable()).select("user_id", "item_id")


# Closets shared by all customers of a nation, so that owners have more garments than one read returns.
SHARED = """
SELECT c.c_nationkey AS user_id, i.user_id * 1000000000 + i.item_id AS item_id
FROM {v_items} i JOIN {customer} c ON c.c_custkey = i.user_id"""


@query("owner_capped_read", "A4", f"""
SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS n FROM ({SHARED}))
WHERE n <= 150""")
def _(t):
    return garments.owner_read(t.sql(SHARED)).select("user_id", "item_id")


@query("recent_garments", "F1,F3", """
SELECT user_id, item_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC NULLS LAST, item_id) AS rank FROM {v_items})
WHERE rank <= 4""")
def _(t):
    return garments.recent_garments(t.v_items).select("user_id", "item_id", "rank")


@query("cost_per_wear_list", "F4,H26", """
SELECT user_id, item_id, title, purchase_price, created_at, coalesce(times_worn, 0) AS times_worn,
       purchase_price / greatest(coalesce(times_worn, 0), 1) AS sort_cost,
       CASE WHEN times_worn > 0 THEN purchase_price / times_worn END AS cost_per_wear
FROM {v_items} WHERE purchase_price > 0""")
def _(t):
    return garments.cost_per_wear_list(t.v_items)


DETAILED = """
SELECT g.*, split(CASE item_id % 3 WHEN 0 THEN 'red blue' WHEN 1 THEN '' END, ' ') AS secondary_colors,
  CASE WHEN item_id % 2 = 0 THEN 'Slim' END AS fit, CASE WHEN item_id % 5 <> 0 THEN 'Half' END AS sleeve_type,
  CASE WHEN item_id % 5 = 1 THEN 'Round' END AS neckline, split(CASE WHEN item_id % 4 = 0 THEN 'summer winter' END, ' ') AS season,
  split(CASE WHEN item_id % 7 = 0 THEN 'office' END, ' ') AS user_occasions, split(CASE WHEN item_id % 2 = 1 THEN 'party' END, ' ') AS occasion,
  CASE WHEN item_id % 6 = 0 THEN 'Casual' END AS formality, CASE WHEN item_id % 3 = 1 THEN 2020 END AS purchase_year,
  CASE item_id % 4 WHEN 0 THEN 4.0 WHEN 1 THEN 3.5 WHEN 2 THEN 0.0 END AS rating,
  CASE item_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS bg_removed
FROM {v_garments} g"""


@query("garment_detail_rows", "B17,H15", """
SELECT * FROM (
  SELECT user_id, item_id, 'Secondary colors' AS label, CASE WHEN item_id % 3 = 0 THEN 'Red, Blue' END AS value FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Fit', CASE WHEN item_id % 2 = 0 THEN 'Slim' END FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Sleeves', CASE WHEN item_id % 5 <> 0 THEN 'Half' END FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Neckline', CASE WHEN item_id % 5 = 1 THEN 'Round' END FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Season', CASE WHEN item_id % 4 = 0 THEN 'Summer, Winter' END FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Occasions', CASE WHEN item_id % 7 = 0 THEN 'Office' WHEN item_id % 2 = 1 THEN 'Party' END FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Formality', CASE WHEN item_id % 6 = 0 THEN 'Casual' END FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Purchase year', CASE WHEN item_id % 3 = 1 THEN '2020' END FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Rating', CASE item_id % 4 WHEN 0 THEN '4/5' WHEN 1 THEN '3.5/5' END FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Background prepared', CASE item_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END FROM {v_garments}
  UNION ALL
  SELECT user_id, item_id, 'Category', category FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Subcategory', sub_category FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Brand', brand FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Primary color', primary_color FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Pattern', pattern FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Material', material FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Laundry', laundry_status FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Times worn', CAST(coalesce(times_worn, 0) AS VARCHAR) FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Last worn', coalesce(CAST(last_worn AS VARCHAR), 'Never') FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Purchase price', CAST(CAST(round(purchase_price) AS BIGINT) AS VARCHAR) FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'AI visibility', CASE WHEN hidden_from_ai THEN 'Hidden' ELSE 'Available' END FROM {v_garments}
  UNION ALL SELECT user_id, item_id, 'Tags', array_to_string(list_transform(tags,
      lambda w: upper(w[1]) || w[2:]), ', ') FROM {v_garments})
WHERE value <> ''""")
def _(t):
    return garments.detail_rows(t.sql(DETAILED))


@query("category_totals", "M1", f"""
WITH {TAXONOMY} SELECT user_id, norm_category, count(*) AS garments FROM tax GROUP BY user_id, norm_category""")
def _(t):
    return garments.category_totals(with_taxonomy(t.v_garments))


@query("attribute_filters", "M2", f"""
WITH {TAXONOMY} SELECT user_id, item_id FROM tax
WHERE primary_color = 'red' AND norm_category = 'Top' AND laundry_status = 'Clean'
UNION ALL SELECT user_id, item_id FROM tax WHERE item_id % 4 = 1 AND (item_id % 3 = 0 OR item_id % 7 = 0)""")
def _(t):
    keep = garments.attribute_filter(color="red", category="Top", laundry="Clean")
    tagged = with_taxonomy(t.v_garments).filter(keep).select("user_id", "item_id")
    seasons = F.expr("split(CASE item_id % 4 WHEN 1 THEN 'Summer Autumn' WHEN 2 THEN 'Winter' END, ' ')")
    occasions = F.expr("CASE WHEN item_id % 3 = 0 THEN array('Office', 'Party') WHEN item_id % 7 = 0 THEN array('Party') ELSE array('Home') END")
    worn_at = t.v_garments.withColumns({"season": seasons, "occasion": occasions})
    both = worn_at.filter(garments.attribute_filter(season="Summer", occasion="Party")).select("user_id", "item_id")
    return tagged.unionByName(both)


USABLE = "NOT coalesce(hidden_from_ai, false) AND coalesce(laundry_status, '') <> 'Laundry'"
SCORED = f"""owned AS (
  SELECT user_id, item_id, title, created_at, {category_sql()} AS norm_category, {key_sql('sub_category')} AS k1,
         {key_sql('primary_color')} AS k2, {key_sql('pattern')} AS k3, {key_sql('material')} AS k4,
         lower(concat_ws(' ', category, sub_category, title)) AS words
  FROM {{v_items}} WHERE {USABLE}),
cand AS (
  SELECT user_id, candidate_id, price, {category_sql()} AS norm_category, {key_sql('sub_category')} AS k1,
         {key_sql('primary_color')} AS k2, {key_sql('pattern')} AS k3, {key_sql('material')} AS k4,
         lower(concat_ws(' ', category, sub_category, title)) AS words
  FROM {{v_candidates}}),
similar_rows AS (
  SELECT user_id, candidate_id, rank, item_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, candidate_id ORDER BY score DESC, created_at DESC, item_id) AS rank
    FROM (SELECT c.user_id, c.candidate_id, o.item_id, o.created_at,
            CASE WHEN c.norm_category = o.norm_category THEN 40 ELSE 0 END + CASE WHEN c.k1 = o.k1 THEN 25 ELSE 0 END
            + CASE WHEN c.k2 = o.k2 THEN 15 ELSE 0 END + CASE WHEN c.k3 = o.k3 THEN 10 ELSE 0 END
            + CASE WHEN c.k4 = o.k4 THEN 10 ELSE 0 END AS score
          FROM cand c JOIN owned o ON c.user_id = o.user_id) WHERE score >= 65) WHERE rank <= 6)"""
NO_ROLE = {"zone": "''", "role": "''", "alone": "false"}
COMBOS = f"""pool AS (
  SELECT user_id, slot, item_id, row_number() OVER (PARTITION BY user_id, slot ORDER BY created_at DESC, item_id) - 1 AS at,
         count(*) OVER (PARTITION BY user_id, slot) AS n
  FROM (SELECT *, {slot_sql('words', **NO_ROLE)} AS slot FROM owned)),
cslot AS (SELECT user_id, candidate_id, {slot_sql('words', **NO_ROLE)} AS slot FROM cand),
base AS (SELECT * FROM (VALUES ('hero', 'footwear', 3), ('hero', 'accessory', 4),
  ('top', 'bottom', 1), ('top', 'layer', 2), ('top', 'footwear', 3), ('top', 'accessory', 4),
  ('bottom', 'top', 1), ('bottom', 'layer', 2), ('bottom', 'footwear', 3), ('bottom', 'accessory', 4),
  ('other', 'top', 1), ('other', 'bottom', 2), ('other', 'footwear', 3), ('other', 'accessory', 4)) v(kind, slot, ord)),
picks AS (
  SELECT c.user_id, c.candidate_id, r.i, b.ord, p.item_id
  FROM cslot c JOIN base b ON b.kind = CASE WHEN c.slot IN ('hero', 'top', 'bottom') THEN c.slot ELSE 'other' END
  CROSS JOIN (SELECT unnest(range(12)) AS i) r
  JOIN pool p ON p.user_id = c.user_id AND p.slot = b.slot AND p.at = r.i % p.n),
rotations AS (
  SELECT user_id, candidate_id, i, list(item_id ORDER BY ord) AS ids, list_sort(list(DISTINCT item_id)) AS key
  FROM picks GROUP BY user_id, candidate_id, i HAVING count(*) >= 2),
combos AS (
  SELECT user_id, candidate_id, ids, row_number() OVER (PARTITION BY user_id, candidate_id ORDER BY i) - 1 AS combination_no
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, candidate_id, key ORDER BY i) AS again FROM rotations)
  WHERE again = 1)"""


@query("similar_owned_garments", "C7,H7,F6", f"WITH {SCORED} SELECT * FROM similar_rows")
def _(t):
    return purchase.similar_garments(t.v_candidates, t.v_items)


@query("purchase_combinations", "C8,E3,F8", f"""
WITH {SCORED}, {COMBOS}
SELECT user_id, candidate_id, combination_no, unnest(range(len(ids))) AS pos, unnest(ids) AS item_id FROM combos""")
def _(t):
    return purchase.combinations(t.v_candidates, t.v_items)


@query("purchase_check", "D18,G3", f"""
WITH {SCORED}, {COMBOS}
SELECT user_id, candidate_id, similar_items, possible_outfits, compatible_pieces, expected_wears,
       CASE WHEN price > 0 THEN CAST(round(price / expected_wears) AS BIGINT) END AS cost_per_wear,
       CASE WHEN similar_items >= 2 THEN 'duplicate' WHEN possible_outfits >= 4 THEN 'strong_buy' ELSE 'consider' END AS verdict
FROM (SELECT c.user_id, c.candidate_id, c.price, coalesce(s.n, 0) AS similar_items, coalesce(k.n, 0) AS possible_outfits,
        coalesce(k.pieces, 0) AS compatible_pieces,
        greatest(5, least(30, CASE WHEN coalesce(k.n, 0) = 0 THEN 5 ELSE k.n * 2 END)) AS expected_wears
      FROM cand c
      LEFT JOIN (SELECT user_id, candidate_id, count(*) AS n FROM similar_rows GROUP BY ALL) s USING (user_id, candidate_id)
      LEFT JOIN (SELECT user_id, candidate_id, count(DISTINCT combination_no) AS n, count(DISTINCT item_id) AS pieces
                 FROM (SELECT user_id, candidate_id, combination_no, unnest(ids) AS item_id FROM combos) GROUP BY ALL) k
        USING (user_id, candidate_id))""")
def _(t):
    return purchase.purchase_check(t.v_candidates, t.v_items)


@query("garment_search_of_index", "H6,B1", f"""
WITH {SEARCH} SELECT user_id, item_id FROM found WHERE {has_sql(['tee', 'red'])}""")
def _(t):
    """Candidates of both words and their synonyms, then the search itself."""
    tagged = with_search_text(t.v_garments).withColumn("entry", F.concat_ws("/", "user_id", "item_id"))
    index = text_index.postings(tagged, "entry", "search_text", t.v_garments.count())
    wanted = " Tee  RED"
    keys = text_index.candidates_of_all(index, query_words(wanted))
    return text_index.of_candidates(tagged, keys, "entry").filter(matches("search_text", wanted)).select("user_id", "item_id")
