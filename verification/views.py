"""Views that give the driver's tables the shape of the library's tables.

The text of each view runs in Spark and in DuckDB. ``{name}`` stands for a table
or an earlier view. The remainders of keys in them only spread values over
rows (for example which garment is in the laundry). Every view covers its whole
source table, but for those that are one kind of rows of it: quests, shares,
model responses and style checks are event types, one customer in five asks for
deletion, one wear record in three has no pieces of its own, and one page in nine
is missing from the site map. Pieces whose part key divides by 17 have no garment
on purpose: they are the dangling ids that several operators must notice.
"""

from __future__ import annotations

import re

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
VIEWS: dict[str, str] = {}

VIEWS["v_users"] = """
SELECT c.c_custkey AS user_id, c.c_name AS full_name,
       CASE WHEN c.c_acctbal > 5000 THEN 'premium' ELSE 'free' END AS plan,
       c.c_mktsegment AS city, c.c_custkey % 40 = 0 AS login_blocked,
       CASE WHEN c.c_custkey % 7 = 0 THEN c.c_custkey % 4 END AS ai_daily_limit,
       o.created_at AS created_at
FROM {customer} c LEFT JOIN
     (SELECT o_custkey, min(o_orderdate) AS created_at FROM {orders} GROUP BY o_custkey) o
  ON c.c_custkey = o.o_custkey
"""

VIEWS["v_items"] = """
SELECT g.user_id, g.part_id AS item_id, p.p_name AS title,
       CASE WHEN p.p_partkey % 13 = 0 THEN 'lookbook' END AS type,
       CASE p.p_partkey % 12
         WHEN 0 THEN 'Bomber Jacket' WHEN 1 THEN 'T-Shirt' WHEN 2 THEN 'Chinos'
         WHEN 3 THEN 'Sneakers' WHEN 4 THEN 'Watch' WHEN 5 THEN 'Silk Saree'
         WHEN 6 THEN 'Summer Dress' WHEN 7 THEN 'Kurta Set' WHEN 8 THEN 'Jeans'
         WHEN 9 THEN 'Loafers' WHEN 10 THEN 'Polo' END AS category,
       p.p_type AS sub_category, p.p_brand AS brand,
       split_part(p.p_name, ' ', 1) AS primary_color,
       CASE WHEN p.p_size % 3 = 0 THEN 'plain' WHEN p.p_size % 3 = 1 THEN 'check' END AS pattern,
       CASE WHEN p.p_size % 2 = 0 THEN 'cotton' ELSE 'linen' END AS material,
       p.p_partkey % 4 = 0 AS favorite,
       CASE WHEN p.p_partkey % 6 = 0 THEN true WHEN p.p_partkey % 6 = 1 THEN false END AS in_lookbook,
       CASE WHEN p.p_partkey % 5 = 0 THEN 'Laundry' ELSE 'Clean' END AS laundry_status,
       p.p_partkey % 11 = 0 AS hidden_from_ai,
       CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE p.p_retailprice END AS purchase_price,
       CASE WHEN p.p_partkey % 9 = 0 THEN 0 ELSE g.n END AS times_worn,
       CASE WHEN p.p_partkey % 9 = 0 THEN NULL ELSE g.last_worn END AS last_worn,
       g.created_at
FROM (SELECT o.o_custkey AS user_id, l.l_partkey AS part_id, count(*) AS n,
             max(CAST(o.o_orderdate AS DATE)) AS last_worn, min(o.o_orderdate) AS created_at
      FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey
      WHERE l.l_partkey % 17 <> 0
      GROUP BY o.o_custkey, l.l_partkey) g
JOIN {part} p ON p.p_partkey = g.part_id
"""

VIEWS["v_looks"] = """
SELECT o_custkey AS user_id, o_orderkey AS look_id, o_orderdate AS created_at,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'style_challenge' WHEN '2-HIGH' THEN 'user_created'
            WHEN '3-MEDIUM' THEN 'ai_recommendation' END AS source,
       o_orderpriority = '2-HIGH' AS lookbook
FROM {orders}
"""

# Positions order the pieces of a look and need not be dense; built from the row
# itself, so that no look has to be gathered in one place to number its pieces.
VIEWS["v_look_items"] = """
SELECT o.o_custkey AS user_id, o.o_orderkey AS look_id,
       CAST(l.l_linenumber AS BIGINT) * 1000000000000 + l.l_partkey AS pos, l.l_partkey AS item_id
FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey
"""

VIEWS["v_wear"] = """
SELECT o_custkey AS user_id, o_orderkey AS record_id, o_orderkey AS outfit_id,
       CAST(o_orderdate AS DATE) AS wear_date,
       CASE WHEN o_orderstatus = 'O' THEN 'planned' ELSE 'worn' END AS status,
       o_orderdate AS created_at
FROM {orders}
"""

VIEWS["v_quest"] = """
SELECT user_id, event_id AS submission_id, CAST(ts AS DATE) AS challenge_date, ts AS created_at,
       CAST(floor(least(value, 100)) AS INT) AS score_total,
       CASE WHEN event_id % 4 = 0 THEN 0 ELSE CAST(floor(value) AS INT) END AS points_earned
FROM {events} WHERE event_type = 'purchase'
"""

VIEWS["v_api_logs"] = """
SELECT event_id AS log_id, user_id, ts,
       CASE event_type WHEN 'error' THEN 'failure' WHEN 'view' THEN NULL ELSE 'success' END AS status,
       CASE event_id % 4 WHEN 0 THEN 'groq' WHEN 1 THEN 'gemini' WHEN 2 THEN '' END AS provider,
       CASE event_id % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' END AS model,
       event_type AS type,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'feature_' || CAST(event_id % 6 AS STRING) END AS feature,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS response_time,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS duration_ms
FROM {events}
"""

VIEWS["v_coupons"] = """
SELECT s_name AS code, s_acctbal > 1000 AS active, s_suppkey % 30 AS redeemed_count,
       CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 20 END AS max_redemptions,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN DATE '2023-01-01'
            ELSE DATE '2030-01-01' END AS expires_at
FROM {supplier}
"""

VIEWS["v_deletions"] = """
SELECT c_custkey + CASE WHEN c_custkey % 100 = 0 THEN 1000000 ELSE 0 END AS user_id,
       CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS status,
       CAST(c_custkey % 365 AS INT) AS requested_day
FROM {customer} WHERE c_custkey % 5 = 0
"""

VIEWS["v_share"] = """
SELECT event_id AS id, event_type = 'signup' AS is_link, event_type = 'click' AS is_attribution,
       CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(floor(value) AS INT) END AS click_count,
       CASE WHEN event_id % 2 = 0 THEN 3 END AS clicks,
       event_id % 7 = 0 AS activated
FROM {events} WHERE event_type IN ('signup', 'click')
"""

VIEWS["v_activity"] = """
SELECT 'account' AS type, user_id, created_at AS ts, 'User joined' AS label FROM {v_users}
UNION ALL SELECT 'wardrobe', user_id, created_at, 'Added ' || title FROM {v_items}
UNION ALL SELECT 'outfit', user_id, created_at, 'Saved an outfit' FROM {v_looks}
UNION ALL SELECT 'outfit', user_id, created_at, 'Logged an outfit wear' FROM {v_wear}
UNION ALL SELECT 'outfit', user_id, created_at, 'Completed a Closet Quest' FROM {v_quest}
UNION ALL SELECT 'ai', user_id, ts, type || ' request ' || coalesce(status, 'logged') FROM {v_api_logs}
"""

# Purchase candidates: the pieces of a user's looks that the user does not own.
VIEWS["v_candidates"] = """
SELECT c.user_id, p.p_partkey AS candidate_id, p.p_name AS title,
       CASE p.p_partkey % 4 WHEN 0 THEN 'T-Shirt' WHEN 1 THEN 'Chinos'
            WHEN 2 THEN 'Summer Dress' ELSE 'Sneakers' END AS category,
       p.p_type AS sub_category, split_part(p.p_name, ' ', 1) AS primary_color,
       CASE WHEN p.p_size % 3 = 0 THEN 'plain' END AS pattern,
       'cotton' AS material, p.p_retailprice AS price
FROM (SELECT DISTINCT o.o_custkey AS user_id, l.l_partkey AS part_id
      FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey
      WHERE l.l_partkey % 17 = 0) c
JOIN {part} p ON p.p_partkey = c.part_id
"""

# Two of three wear records hold their own pieces; the others point to the look.
VIEWS["v_wear_items"] = """
SELECT user_id, look_id AS record_id, pos, item_id FROM {v_look_items} WHERE look_id % 3 <> 0
"""

# Garments with the optional descriptive fields and a list column.
VIEWS["v_garments"] = """
SELECT i.user_id, i.item_id, i.title, i.category,
       CASE WHEN p.p_partkey % 2 = 0 THEN p.p_type END AS sub_category,
       CASE WHEN p.p_partkey % 10 = 0 THEN 'belt' END AS category_role,
       CASE p.p_partkey % 7 WHEN 0 THEN 'accessory' WHEN 1 THEN 'outer' WHEN 2 THEN 'standalone' END AS layer_role,
       CASE p.p_partkey % 8 WHEN 0 THEN 'feet' WHEN 1 THEN 'accessory' WHEN 2 THEN 'lower_body'
            WHEN 3 THEN 'full_body' END AS body_zone,
       p.p_partkey % 3 = 0 AS standalone_outfit,
       CASE WHEN p.p_partkey % 4 <> 0 THEN split(p.p_name, ' ') END AS tags,
       i.brand, i.primary_color, i.pattern, i.material, i.favorite, i.laundry_status,
       i.type, i.in_lookbook, i.hidden_from_ai, i.purchase_price, i.times_worn, i.last_worn, i.created_at
FROM {v_items} i JOIN {part} p ON p.p_partkey = i.item_id
"""

VIEWS["v_ai_responses"] = """
SELECT log_id AS id, user_id, feature, type, ts AS created_at FROM {v_api_logs} WHERE type = 'click'
"""

VIEWS["v_outfit_history"] = """
SELECT log_id AS id, user_id, feature, type, ts AS created_at FROM {v_api_logs} WHERE type = 'view'
"""

# Users with the account fields that the listings show.
VIEWS["v_accounts"] = """
SELECT u.user_id, CASE WHEN u.user_id % 10 = 0 THEN '' ELSE u.full_name END AS full_name,
       CASE WHEN u.user_id % 20 <> 0 THEN 'user ' || CAST(u.user_id AS STRING) END AS display_name,
       CASE WHEN u.user_id % 9 <> 0 THEN lower(c.c_mktsegment) || CAST(u.user_id AS STRING) || '@example.com' END AS email,
       CASE u.user_id % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender,
       CASE WHEN u.user_id % 4 <> 0 THEN u.city END AS city,
       CASE WHEN u.user_id % 5 = 1 THEN n.n_name END AS profession,
       CASE WHEN u.user_id % 6 = 0 THEN c.c_nationkey + 150 END AS height,
       u.plan, CASE WHEN u.user_id % 8 = 0 THEN 'MONTH-' || CAST(u.user_id AS STRING) END AS last_coupon,
       CASE u.user_id % 3 WHEN 0 THEN TIMESTAMP '2024-06-01 00:00:00' WHEN 1 THEN TIMESTAMP '2023-06-01 00:00:00' END AS premium_until,
       u.login_blocked, u.user_id % 50 = 1 AS account_blocked, u.ai_daily_limit, u.created_at
FROM {v_users} u JOIN {customer} c ON c.c_custkey = u.user_id LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""

# Requests to plan a look: some repeat a plan that exists, some repeat each other.
VIEWS["v_plan_requests"] = """
SELECT user_id, look_id, CAST(created_at AS DATE) + CAST(look_id % 2 AS INT) AS wear_date FROM {v_looks}
UNION ALL
SELECT user_id, look_id, CAST(created_at AS DATE) + CAST(look_id % 3 AS INT) FROM {v_looks}
"""

VIEWS["v_plans"] = """
SELECT 'web_' || CAST(user_id AS STRING) || '_' || CAST(wear_date AS STRING) || '_' || CAST(outfit_id AS STRING)
         AS record_id,
       user_id, outfit_id, wear_date, status
FROM {v_wear}
"""

# Raw prompts of calls, one registry id in three unknown.
VIEWS["v_prompts"] = """
SELECT event_id AS log_id, user_id,
       CASE event_id % 6 WHEN 0 THEN 'outfit_stylist' WHEN 1 THEN 'style_this' WHEN 2 THEN 'festival_stylist'
            WHEN 3 THEN 'weekly_report' WHEN 4 THEN 'other_prompt' END AS prompt_id,
       CASE WHEN event_id % 4 <> 0 THEN event_type || ' ' || props END AS request
FROM {events}
"""

# Pages with head tags: some lack one, some hold a wrong or broken one.
VIEWS["v_pages"] = """
SELECT page_id, url,
       CASE WHEN page_id % 5 <> 0 THEN '<link rel="canonical" href="' || url || '">' ELSE '' END
       || CASE WHEN page_id % 3 <> 0 THEN '<meta name="robots" content="index,follow,max-snippet:-1">'
               ELSE '<meta name="robots" content="noindex">' END
       || CASE WHEN page_id % 4 <> 0 THEN '<meta property="og:image" content="https://img.example/social.png">' ELSE '' END
       || CASE WHEN page_id % 6 <> 0 THEN '<meta name="twitter:image" content="https://img.example/social.png">' ELSE '' END
       || CASE WHEN page_id % 7 = 0 THEN '<script type="application/ld+json">{{"broken": </script>'
               WHEN page_id % 2 = 0 THEN '<script type="application/ld+json">{{"@type": "WebPage"}}</script>' ELSE '' END
       || html AS html
FROM {pages}
"""

VIEWS["v_sitemap"] = """
SELECT url AS loc FROM {pages} WHERE page_id % 9 <> 0
"""


_NAME = re.compile(r"\{(\w+)\}")


def needed(text: str) -> list[str]:
    """Names of the views a text uses, directly or through other views, in order."""
    found: set[str] = set()
    todo = [text]
    while todo:
        for name in _NAME.findall(todo.pop()):
            if name in VIEWS and name not in found:
                found.add(name)
                todo.append(VIEWS[name])
    return [name for name in VIEWS if name in found]


def standalone_sql(text: str) -> str:
    """One SQL string for DuckDB with the views it needs in front."""
    names = {n: n for n in [*TABLES, *VIEWS]}
    parts = [f"{v} AS ({VIEWS[v].format(**names).strip()})" for v in needed(text)]
    body = text.format(**names).strip()
    if not parts:
        return body
    joiner = ",\n" if body.upper().startswith("WITH ") else "\n"
    if joiner == ",\n":
        body = body[5:]
    return "WITH " + ",\n".join(parts) + joiner + body
