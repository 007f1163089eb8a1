"""Platform, accounts and activity."""

from datetime import date

from pyspark.sql import functions as F

from closetlake.functions.calendar import age_label, day, day_label, instant
from closetlake.functions.hashing import cache_key, character_hash, known_prompt, prompt_stamp, prompt_version, request_hash
from closetlake.functions.hashing import PROMPT_REGISTRY
from closetlake.functions.text import event_detail, pretty_label
from closetlake.operators import accounts, activity, increments, platform
from closetlake.sources.collections import owned_by
from verification.registry import NOW, query

N = "TIMESTAMP '2024-01-30 12:00:00'"
NAME = "coalesce(nullif(full_name, ''), nullif(display_name, ''), {d})"

FEED = """feed AS (
  SELECT 'account' AS type, 'User joined' AS label, CAST(user_id AS VARCHAR) AS user_id, created_at AS time, '' AS detail,
         'users:' || user_id AS event_id FROM {v_accounts}
  UNION ALL SELECT 'wardrobe', 'Added ' || title, CAST(user_id AS VARCHAR), created_at, '', 'wardrobe:' || user_id || '/' || item_id FROM {v_items}
  UNION ALL SELECT 'outfit', 'Saved an outfit', CAST(user_id AS VARCHAR), created_at, '', 'looks:' || look_id FROM {v_looks}
  UNION ALL SELECT 'ai', 'Completed a style check', CAST(user_id AS VARCHAR), created_at, coalesce(feature, ''), 'history:' || id FROM {v_outfit_history}
  UNION ALL SELECT 'outfit', 'Logged an outfit wear', CAST(user_id AS VARCHAR), created_at, '', 'wear:' || record_id FROM {v_wear}
  UNION ALL SELECT 'outfit', 'Completed a Closet Quest', CAST(user_id AS VARCHAR), created_at, '', 'quests:' || submission_id FROM {v_quest}
  UNION ALL SELECT 'ai', 'Generated ' || coalesce(feature, type), CAST(user_id AS VARCHAR), created_at, coalesce(feature, ''), 'responses:' || id FROM {v_ai_responses}
  UNION ALL SELECT 'ai', type || ' request ' || coalesce(status, 'logged'), CAST(user_id AS VARCHAR), ts,
    concat_ws(' · ', feature, model, nullif(provider, ''), CASE WHEN status = 'failure' THEN 'Failed request' END),
    'logs:' || log_id FROM {v_api_logs}),
timed AS (SELECT * FROM feed WHERE time IS NOT NULL)"""


def feed(t):
    return activity.activity_feed(
        t.v_accounts, t.v_items, t.v_looks, t.v_outfit_history, t.v_wear, t.v_quest, t.v_ai_responses, t.v_api_logs
    )


def rollup(t):
    return accounts.user_rollup(
        t.v_accounts, t.v_items, t.v_looks, t.v_outfit_history, t.v_wear, t.v_quest, t.v_ai_responses, t.v_api_logs
    )


ROLLUP = f"""rollup AS (
  SELECT u.*, {NAME.format(d="'Unnamed user'")} AS name, coalesce(i.n, 0) AS garments, coalesce(l.n, 0) AS outfits,
         coalesce(r.n, 0) + coalesce(h.n, 0) AS ai_actions,
         CASE WHEN u.created_at IS NULL THEN s.seen WHEN s.seen IS NULL THEN u.created_at
              ELSE greatest(s.seen, u.created_at) END AS last_activity
  FROM {{v_accounts}} u
  LEFT JOIN (SELECT user_id, count(*) AS n FROM {{v_items}} GROUP BY user_id) i USING (user_id)
  LEFT JOIN (SELECT user_id, count(*) AS n FROM {{v_looks}} GROUP BY user_id) l USING (user_id)
  LEFT JOIN (SELECT user_id, count(*) AS n FROM {{v_ai_responses}} GROUP BY user_id) r USING (user_id)
  LEFT JOIN (SELECT user_id, count(*) AS n FROM {{v_outfit_history}} GROUP BY user_id) h USING (user_id)
  LEFT JOIN (SELECT user_id, max(t) AS seen FROM (
    SELECT user_id, created_at AS t FROM {{v_items}} UNION ALL SELECT user_id, created_at FROM {{v_looks}}
    UNION ALL SELECT user_id, created_at FROM {{v_outfit_history}} UNION ALL SELECT user_id, created_at FROM {{v_wear}}
    UNION ALL SELECT user_id, created_at FROM {{v_quest}} UNION ALL SELECT user_id, created_at FROM {{v_ai_responses}}
    UNION ALL SELECT user_id, ts FROM {{v_api_logs}}) GROUP BY user_id) s USING (user_id))"""


@query("user_rollup", "C5,D5,G2,A5", f"""
WITH {ROLLUP} SELECT user_id, name, garments, outfits, ai_actions, last_activity FROM rollup""")
def _(t):
    return rollup(t).select("user_id", "name", "garments", "outfits", "ai_actions", "last_activity")


@query("users_page", "F11,E5", f"""
WITH {ROLLUP} SELECT user_id, name, row_no, CAST(ceil(row_no / 20) AS BIGINT) AS page, CAST(ceil(n / 20) AS BIGINT) AS page_count FROM (
  SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, user_id) AS row_no, count(*) OVER () AS n FROM rollup)
WHERE row_no BETWEEN 41 AND 60 OR ceil(row_no / 20) = ceil(n / 20)""")
def _(t):
    """The third page and the last one."""
    counts = accounts.user_counts(t.v_accounts)
    both = [accounts.users_page(rollup(t), n, counts) for n in (3, 1_000_000_000_000)]
    return both[0].unionByName(both[1]).select("user_id", "name", "row_no", "page", "page_count")


@query("user_export", "A8", f"""
WITH {ROLLUP}
SELECT CAST(user_id AS VARCHAR) AS "UID", name AS "Name", email AS "Email", gender AS "Gender", city AS "City",
  profession AS "Profession", plan AS "Plan", coalesce(last_coupon, '') AS "Coupon used",
  strftime(premium_until, '%Y-%m-%d') AS "Premium until", strftime(created_at, '%Y-%m-%d') AS "Joined",
  strftime(last_activity, '%Y-%m-%d') AS "Last activity", garments AS "Garments", outfits AS "Saved outfits",
  ai_actions AS "AI actions" FROM rollup""")
def _(t):
    return accounts.export_rows(rollup(t))


@query("user_admin_rows", "B19", f"""
WITH {ROLLUP}, attrs AS (
  SELECT user_id, 'Gender' AS label, gender AS value FROM rollup UNION ALL SELECT user_id, 'City', city FROM rollup
  UNION ALL SELECT user_id, 'Profession', profession FROM rollup
  UNION ALL SELECT user_id, 'Height', CASE WHEN height <> 0 THEN height || ' cm' END FROM rollup
  UNION ALL SELECT user_id, 'Body type', NULL FROM rollup UNION ALL SELECT user_id, 'Skin tone', NULL FROM rollup
  UNION ALL SELECT user_id, 'Hair color', NULL FROM rollup UNION ALL SELECT user_id, 'Plan', plan FROM rollup
  UNION ALL SELECT user_id, 'Coupon used', coalesce(last_coupon, 'No coupon') FROM rollup
  UNION ALL SELECT user_id, 'Premium until', strftime(premium_until, '%Y-%m-%d') FROM rollup
  UNION ALL SELECT user_id, 'Login', CASE WHEN login_blocked THEN 'Blocked' ELSE 'Enabled' END FROM rollup
  UNION ALL SELECT user_id, 'AI daily limit', coalesce(CAST(ai_daily_limit AS VARCHAR), 'Global default') FROM rollup
  UNION ALL SELECT user_id, 'Joined', strftime(created_at, '%Y-%m-%d') FROM rollup
  UNION ALL SELECT user_id, 'Last activity', strftime(last_activity, '%Y-%m-%d') FROM rollup)
SELECT user_id, label, coalesce(nullif(value, ''), '—') AS value FROM attrs""")
def _(t):
    return accounts.admin_rows(rollup(t))


@query("user_profile_rows", "B18", """
WITH p AS (
  SELECT user_id, unnest(['Name', 'Gender', 'Date of birth', 'Height', 'Weight', 'Profession', 'City', 'Body type',
    'Skin tone', 'Hair color', 'Profile completion']) AS label, unnest([coalesce(nullif(full_name, ''), display_name), gender, NULL,
    height || ' cm', NULL, profession, city, NULL, NULL, NULL, NULL]) AS value FROM {v_accounts}),
q AS (SELECT user_id, unnest(['Style direction', 'Favorite colors', 'Colors to avoid', 'Fit', 'Priority', 'Temperature',
    'Environment', 'Commute', 'Footwear', 'Hard exclusions', 'Coverage']) AS label FROM {v_accounts})
SELECT user_id, label, coalesce(nullif(value, ''), 'Not provided') AS value FROM p
UNION ALL SELECT user_id, label, 'Not specified' FROM q""")
def _(t):
    return accounts.profile_rows(t.v_accounts)


@query("user_labels", "B13,B14,B16,B20,B21", f"""
SELECT user_id, {NAME.format(d="'Unnamed user'")} AS name,
  coalesce(nullif(array_to_string(list_filter([gender, city, profession], lambda x: x <> '')[1:2], ' · '), ''), 'Profile incomplete') AS profile,
  login_blocked OR account_blocked AS restricted, coalesce(plan = 'premium' AND premium_until > {N}, false) AS premium,
  CAST(coalesce(ai_daily_limit, 5) AS BIGINT) AS daily_limit
FROM {{v_accounts}}""")
def _(t):
    return t.v_accounts.select(
        "user_id", accounts.display_name("Unnamed user").alias("name"), accounts.profile_line().alias("profile"),
        accounts.restricted().alias("restricted"), accounts.premium(NOW).alias("premium"),
        accounts.effective_limit("ai_daily_limit", F.lit(None).cast("int")).alias("daily_limit"),
    )


@query("user_search", "B11", f"""
SELECT user_id FROM {{v_accounts}} WHERE lower(concat_ws(' ', {NAME.format(d="'Unnamed user'")}, coalesce(email, ''),
  CAST(user_id AS VARCHAR))) LIKE '%machinery1%'""")
def _(t):
    return t.v_accounts.filter(accounts.name_search("  MACHINERY1 ")).select("user_id")


@query("open_account_garments", "A3,B13", """
SELECT i.user_id, i.item_id FROM {v_items} i JOIN {v_accounts} u ON i.user_id = u.user_id
WHERE NOT (u.login_blocked OR u.account_blocked)""")
def _(t):
    owners = t.v_accounts.filter(~accounts.restricted()).select("user_id")
    return t.v_items.join(owners, "user_id", "left_semi").select("user_id", "item_id")


@query("owner_garments", "A3", "SELECT user_id, item_id FROM {v_items} WHERE user_id = 7")
def _(t):
    """The garments of one owner, which is all the operator reads."""
    return owned_by(t.v_items, 7).select("user_id", "item_id")


@query("pending_deletions", "B12,C3,F13", f"""
SELECT d.user_id, d.requested_day AS requested_at, {NAME.format(d="'Unknown user'")} AS name,
  coalesce(nullif(u.email, ''), CAST(d.user_id AS VARCHAR)) AS contact
FROM {{v_deletions}} d LEFT JOIN {{v_accounts}} u ON d.user_id = u.user_id WHERE d.status = 'pending'""")
def _(t):
    requests = t.v_deletions.withColumnRenamed("requested_day", "requested_at")
    return accounts.pending_deletions(requests, t.v_accounts).orderBy(F.desc("requested_at"), "user_id")


SEGMENTS = f"""members AS (
  SELECT 'all' AS segment, user_id FROM rollup
  UNION ALL SELECT 'subscribed', user_id FROM rollup WHERE coalesce(plan = 'premium' AND premium_until > {N}, false)
  UNION ALL SELECT 'free', user_id FROM rollup WHERE NOT coalesce(plan = 'premium' AND premium_until > {N}, false)
  UNION ALL SELECT 'inactive', user_id FROM rollup WHERE coalesce(last_activity < {N} - INTERVAL 30 DAY, true)
  UNION ALL SELECT 'small_wardrobe', user_id FROM rollup WHERE garments < 10
  UNION ALL SELECT 'specific', user_id FROM rollup WHERE user_id IN (SELECT user_id FROM {{v_deletions}}))"""


@query("audience_members", "L1,L2,L3,L4,L5", f"WITH {ROLLUP}, {SEGMENTS} SELECT * FROM members")
def _(t):
    return accounts.segments(rollup(t), NOW, t.v_deletions)


@query("audience_reach", "L6", f"WITH {ROLLUP}, {SEGMENTS} SELECT segment, count(*) AS users FROM members GROUP BY segment")
def _(t):
    return accounts.segment_reach(accounts.segments(rollup(t), NOW, t.v_deletions))


@query("activity_feed", "G1,C4,H25", f"""
WITH {FEED}
SELECT f.type, f.label, f.user_id, f.time, f.detail, f.event_id,
  coalesce(nullif(u.full_name, ''), nullif(u.display_name, ''), u.email, f.user_id, 'System') AS actor
FROM timed f LEFT JOIN {{v_accounts}} u ON f.user_id = CAST(u.user_id AS VARCHAR)""")
def _(t):
    return activity.with_actor(feed(t), t.v_accounts)


@query("activity_filtered", "B10", f"""
WITH {FEED} SELECT event_id FROM timed WHERE type = 'ai'
AND time >= TIMESTAMP '2024-01-10 00:00:00' AND time < TIMESTAMP '2024-01-21 00:00:00'""")
def _(t):
    return activity.filter_feed(feed(t), "ai", date(2024, 1, 10), date(2024, 1, 20)).select("event_id")


@query("activity_registered", "C6", f"""
WITH {FEED} SELECT event_id FROM timed WHERE user_id IN (SELECT CAST(user_id AS VARCHAR) FROM {{v_accounts}})""")
def _(t):
    """The feed with as many events of accounts that are gone."""
    known = feed(t)
    gone = known.withColumns({c: F.concat(F.lit("gone:"), c) for c in ("user_id", "event_id")})
    return activity.registered_only(known.unionByName(gone), t.v_accounts).select("event_id")


@query("activity_summary", "D6", f"""
WITH {FEED} SELECT count(*) AS events,
  count(DISTINCT user_id) FILTER (user_id IN (SELECT CAST(user_id AS VARCHAR) FROM {{v_accounts}})) AS active_users,
  count(DISTINCT CAST(time AS DATE)) AS active_dates FROM timed""")
def _(t):
    return activity.feed_summary(feed(t), t.v_accounts)


@query("activity_per_day", "D7,H8", f"WITH {FEED} SELECT CAST(time AS DATE) AS day, count(*) AS events FROM timed GROUP BY ALL")
def _(t):
    return activity.events_per_day(feed(t))


def advanced_state(t):
    """The feed in three batches: half of it, then late events with a third of those before again, then all once more."""
    events, part = feed(t), F.pmod(F.xxhash64("event_id"), F.lit(6))
    state = increments.empty_state(t.spark)
    for batch in (events.filter(part < 3), events.filter(part > 1), events):
        state = increments.advanced(state, batch)
    return state


@query("activity_summary_grown", "G1,D6", f"""
WITH {FEED} SELECT count(*) AS events,
  count(DISTINCT user_id) FILTER (user_id IN (SELECT CAST(user_id AS VARCHAR) FROM {{v_accounts}})) AS active_users,
  count(DISTINCT CAST(time AS DATE)) AS active_dates FROM timed""")
def _(t):
    return increments.summary_of(advanced_state(t), t.v_accounts)


@query("activity_per_day_grown", "G1,D7", f"WITH {FEED} SELECT CAST(time AS DATE) AS day, count(*) AS events FROM timed GROUP BY ALL")
def _(t):
    return advanced_state(t).days


@query("active_days_of_bitmaps", "D24", f"""
WITH {FEED} SELECT user_id, count(DISTINCT CAST(time AS DATE)) AS active_days FROM timed
WHERE time >= TIMESTAMP '1998-01-10 00:00:00' AND time < TIMESTAMP '1998-12-21 00:00:00' GROUP BY user_id""")
def _(t):
    """Bitmaps of two overlapping halves of the feed."""
    days = feed(t).select("user_id", F.to_date("time").alias("day"), F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("part"))
    parts = [increments.month_bitmaps(days.filter(f"part {x}")) for x in ("> 0", "< 2")]
    return increments.active_days(increments.merged_bitmaps(*parts), date(1998, 1, 10), date(1998, 12, 20))


@query("activity_page", "E4,E5,F12", f"""
WITH {FEED}, ranked AS (
  SELECT *, CAST(time AS DATE) AS day, row_number() OVER (ORDER BY time DESC, event_id) AS row_no, count(*) OVER () AS n FROM timed),
shown AS (SELECT *, coalesce(lag(day) OVER (ORDER BY row_no) <> day, true) AS heading FROM ranked WHERE row_no BETWEEN 301 AND 330)
SELECT row_no, 11 AS page, CAST(ceil(n / 30) AS BIGINT) AS page_count, event_id, label, type, user_id, detail, time, day, heading,
  CASE WHEN heading THEN (SELECT count(*) FROM timed x WHERE CAST(x.time AS DATE) = shown.day) END AS day_events FROM shown""")
def _(t):
    return activity.feed_page(feed(t), 11)


@query("activity_last_page", "E5", f"""
WITH {FEED}, ranked AS (
  SELECT *, row_number() OVER (ORDER BY time DESC, event_id) AS row_no, count(*) OVER () AS n
  FROM timed)
SELECT row_no, page_count AS page, page_count, event_id FROM (SELECT *, CAST(ceil(n / 30) AS BIGINT) AS page_count FROM ranked)
WHERE ceil(row_no / 30) = page_count""")
def _(t):
    return activity.feed_page(feed(t), 1_000_000_000).select("row_no", "page", "page_count", "event_id")


@query("user_detail", "D24", f"""
WITH {FEED}, base AS (SELECT CAST(user_id AS VARCHAR) AS user_id FROM {{v_accounts}})
SELECT b.user_id, coalesce(e.n, 0) AS events, coalesce(e.d, 0) AS active_days, coalesce(e.ai, 0) AS ai_actions,
  coalesce(i.n, 0) AS closet_items, coalesce(l.n, 0) AS outfits
FROM base b
LEFT JOIN (SELECT user_id, count(*) AS n, count(DISTINCT CAST(time AS DATE)) AS d, count(*) FILTER (type = 'ai') AS ai
  FROM timed WHERE time >= TIMESTAMP '1998-01-01 00:00:00' AND time < TIMESTAMP '1999-01-01 00:00:00' GROUP BY user_id) e USING (user_id)
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM {{v_items}}
  WHERE created_at >= TIMESTAMP '1998-01-01 00:00:00' AND created_at < TIMESTAMP '1999-01-01 00:00:00' GROUP BY ALL) i USING (user_id)
LEFT JOIN (SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS n FROM {{v_looks}}
  WHERE created_at >= TIMESTAMP '1998-01-01 00:00:00' AND created_at < TIMESTAMP '1999-01-01 00:00:00' GROUP BY ALL) l USING (user_id)""")
def _(t):
    # Every other garment only says when it was changed.
    odd = F.expr("item_id % 2 = 1")
    items = t.v_items.withColumns({"updated_at": F.when(odd, F.col("created_at")), "created_at": F.when(~odd, F.col("created_at"))})
    return activity.user_detail(t.v_accounts, feed(t), items, t.v_looks, date(1998, 1, 1), date(1998, 12, 31))


@query("platform_totals", "D1", f"""
SELECT (SELECT count(*) FROM {{v_accounts}}) AS users,
  (SELECT count(*) FROM {{v_accounts}} WHERE created_at >= TIMESTAMP '1998-06-30 12:00:00' - INTERVAL 7 DAY) AS new_users,
  (SELECT count(*) FROM {{v_items}}) AS garments, (SELECT count(*) FROM {{v_looks}}) AS outfits,
  (SELECT count(*) FROM {{v_ai_responses}}) + (SELECT count(*) FROM {{v_outfit_history}}) AS ai_actions""")
def _(t):
    from datetime import datetime

    return platform.platform_totals(
        t.v_accounts, t.v_items, t.v_looks, t.v_ai_responses, t.v_outfit_history, datetime(1998, 6, 30, 12)
    )


ENGAGEMENT = """bars AS (
  SELECT 'Wardrobe' AS label, count(*) AS n FROM {v_items} UNION ALL SELECT 'Saved outfits', count(*) FROM {v_looks}
  UNION ALL SELECT 'Style checks', count(*) FROM {v_outfit_history} UNION ALL SELECT 'Wears logged', count(*) FROM {v_wear}
  UNION ALL SELECT 'Closet Quests', count(*) FROM {v_quest} UNION ALL SELECT 'AI responses', count(*) FROM {v_ai_responses})"""


@query("engagement_bars", "D2,D27", f"""
WITH {ENGAGEMENT}
SELECT label, n, greatest(CASE WHEN n <> 0 THEN 4 ELSE 0 END, n / (SELECT greatest(1, max(n)) FROM bars) * 100) AS width FROM bars""")
def _(t):
    return platform.bar_widths(platform.labelled_counts({
        "Wardrobe": t.v_items, "Saved outfits": t.v_looks, "Style checks": t.v_outfit_history,
        "Wears logged": t.v_wear, "Closet Quests": t.v_quest, "AI responses": t.v_ai_responses,
    }))


MEAN = "CAST(round(CAST(sum(CAST({x} AS DECIMAL(24,6))) AS DOUBLE) / nullif(count({x}), 0)) AS BIGINT)"


@query("api_health", "D3", f"""
SELECT CAST(CASE WHEN g + b > 0 THEN round(g / (g + b) * 100) ELSE 100 END AS BIGINT) AS success_percent, calls_today, average_ms, b AS failures
FROM (SELECT count(*) FILTER (status = 'success') AS g, count(*) FILTER (status = 'failure') AS b,
        count(*) FILTER (ts >= TIMESTAMP '2024-01-30 00:00:00') AS calls_today, {MEAN.format(x='response_time')} AS average_ms
      FROM {{v_api_logs}})""")
def _(t):
    return platform.api_health(t.v_api_logs, NOW)


@query("model_performance", "C11,D4,E6,F14", f"""
WITH keyed AS (
  SELECT coalesce(nullif(provider, ''), type, 'AI service') || '/' || coalesce(model, 'Unspecified model') AS model_key, status, ts, log_id,
         coalesce(response_time, duration_ms) AS ms, coalesce(feature, type) AS used_for FROM {{v_api_logs}}),
figures AS (SELECT model_key, count(*) AS calls, count(*) FILTER (status = 'success') AS g, count(*) FILTER (status = 'failure') AS b,
  {MEAN.format(x='ms')} AS average_ms, max(ts) AS last_used FROM keyed GROUP BY model_key),
uses AS (SELECT model_key, string_agg(used_for, ', ' ORDER BY ts, log_id) AS features FROM (
  SELECT *, row_number() OVER (PARTITION BY model_key ORDER BY ts, log_id) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY model_key, used_for ORDER BY ts, log_id) AS again FROM keyed) WHERE again = 1)
  WHERE n <= 3 GROUP BY model_key),
conf AS (SELECT unnest(['primary-gemini/gemini-3.1-flash-lite', 'groq/openai/gpt-oss-20b', 'groq/qwen/qwen3.6-27b',
  'groq/openai/gpt-oss-120b', 'secondary-gemini/gemini-3.1-flash-lite']) AS model_key)
SELECT coalesce(c.model_key, f.model_key) AS model_key, coalesce(f.calls, 0) AS calls,
  CASE WHEN f.g + f.b > 0 THEN CAST(round(f.g / (f.g + f.b) * 100) AS BIGINT) END AS success_percent,
  coalesce(f.b, 0) AS failures, f.average_ms, coalesce(u.features, 'General AI') AS features, f.last_used
FROM conf c FULL JOIN figures f ON c.model_key = f.model_key LEFT JOIN uses u ON u.model_key = f.model_key""")
def _(t):
    return platform.model_performance(t.v_api_logs).orderBy(F.desc("calls"), "model_key")


@query("provider_counts", "D8,F14", """
SELECT coalesce(nullif(provider, ''), type, 'unknown') AS label, count(*) AS n FROM {v_api_logs} GROUP BY ALL""")
def _(t):
    return platform.provider_counts(t.v_api_logs).orderBy(F.desc("n"), "label")


@query("feature_counts", "D8,H14", """
SELECT coalesce(CASE WHEN feature IS NOT NULL THEN 'Feature ' || feature[9:] END, upper(type[1]) || type[2:]) AS label, count(*) AS n
FROM {v_ai_responses} GROUP BY ALL""")
def _(t):
    return platform.feature_counts(t.v_ai_responses).orderBy(F.desc("n"), "label")


@query("share_metrics", "D25", """
SELECT cards, clicks, installs, CAST(CASE WHEN cards > 0 THEN round(clicks / cards * 100) ELSE 0 END AS BIGINT) AS click_percent
FROM (SELECT count(*) FILTER (is_link) AS cards,
        CAST(sum(CASE WHEN click_count <> 0 THEN click_count ELSE coalesce(clicks, 0) END) FILTER (is_link) AS BIGINT) AS clicks,
        count(*) FILTER (is_attribution AND activated) AS installs FROM {v_share})""")
def _(t):
    return platform.share_metrics(t.v_share.filter("is_link"), t.v_share.filter("is_attribution"))


@query("daily_limit_use", "D29", """
SELECT l.user_id, l.day, l.calls, CAST(coalesce(u.ai_daily_limit, 12) AS BIGINT) AS daily_limit,
  l.calls > coalesce(u.ai_daily_limit, 12) AS over_limit
FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS calls FROM {v_api_logs} GROUP BY ALL) l
LEFT JOIN (SELECT * FROM {v_accounts} WHERE user_id % 3 <> 0) u ON l.user_id = u.user_id""")
def _(t):
    """Every third account has no user row."""
    return platform.daily_limit_use(t.v_api_logs, t.v_accounts.filter("user_id % 3 <> 0"), F.lit(12))


@query("first_recommendations", "D30", """
SELECT user_id, log_id, ts, rn = 1 AS first, rn > 1 AS would_refuse FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, log_id) AS rn FROM {v_api_logs} WHERE status = 'success')""")
def _(t):
    return platform.first_recommendations(t.v_api_logs)


@query("user_extras", "M9", """
SELECT u.user_id, coalesce(w.planned, 0) AS planned, coalesce(w.worn, 0) AS worn, coalesce(q.n, 0) AS quests,
  coalesce(q.points, 0) AS points, coalesce(l.n, 0) AS good_calls
FROM {v_users} u
LEFT JOIN (SELECT user_id, count(*) FILTER (status = 'planned') AS planned, count(*) FILTER (status = 'worn') AS worn FROM {v_wear} GROUP BY ALL) w USING (user_id)
LEFT JOIN (SELECT user_id, count(*) AS n, CAST(sum(CASE WHEN coalesce(points_earned, 0) <> 0 THEN points_earned ELSE coalesce(score_total, 0) END) AS BIGINT) AS points
  FROM {v_quest} GROUP BY ALL) q USING (user_id)
LEFT JOIN (SELECT user_id, count(*) FILTER (status = 'success') AS n FROM {v_api_logs} GROUP BY ALL) l USING (user_id)""")
def _(t):
    return platform.user_extras(t.v_wear, t.v_quest, t.v_api_logs, t.v_users)


@query("event_labels", "H8,H11,H12,H13,H14,H25", f"""
SELECT log_id, CAST(ts AS DATE) AS day, CAST(floor(epoch(ts)) AS BIGINT) AS seconds,
  CASE WHEN ms < 60000 THEN 'Just now' WHEN ms < 3600000 THEN (ms // 60000) || 'm ago' WHEN ms < 86400000 THEN (ms // 3600000) || 'h ago'
       WHEN ms < 604800000 THEN (ms // 86400000) || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS age,
  CASE CAST(DATE '2024-01-30' - CAST(ts AS DATE) AS INT) WHEN 0 THEN 'Today' WHEN 1 THEN 'Yesterday' ELSE strftime(ts, '%Y-%m-%d') END AS heading,
  CASE WHEN feature IS NULL THEN '' ELSE 'Feature ' || feature[9:] END AS pretty,
  concat_ws(' · ', feature, model, nullif(provider, ''), CASE WHEN status = 'failure' THEN 'Failed request' END) AS detail
FROM (SELECT *, epoch_ms(TIMESTAMP '2024-01-30 12:00:00') - epoch_ms(ts) AS ms FROM {{v_api_logs}})""")
def _(t):
    """Instants come as seconds, as milliseconds or as text, each in a third of the rows."""
    ts, kind = F.col("ts").cast("timestamp"), F.col("log_id") % 3
    moment = instant(F.when(kind == 0, F.unix_seconds(ts)), F.when(kind == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")), F.when(kind == 1, F.unix_millis(ts)))
    return t.v_api_logs.select(
        "log_id", day("ts").alias("day"), F.unix_seconds(moment).alias("seconds"),
        age_label("ts", NOW).alias("age"), day_label("ts", NOW).alias("heading"),
        pretty_label("feature").alias("pretty"),
        event_detail("feature", "model", "provider", "status", F.lit(None).cast("string")).alias("detail"),
    )


FNV = "lower(to_base(list_reduce(list_concat([2166136261], list_transform(string_split({x}, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: xor(h, c) * 16777619 % 4294967296), 36))"
REG = ", ".join(f"('{p}', {v}, '{r}')" for p, v, r in PROMPT_REGISTRY)


@query("prompt_stamps", "C16,H20,H21", f"""
WITH reg AS (SELECT * FROM (VALUES {REG}) r(id, version, tag)),
known AS (SELECT p.*, r.id, r.version, r.tag FROM (
  SELECT *, CASE WHEN prompt_id IN (SELECT id FROM reg) THEN prompt_id ELSE 'unknown' END AS k FROM {{v_prompts}}) p JOIN reg r ON r.id = p.k)
SELECT log_id, id AS prompt_id, version AS prompt_version, {FNV.format(x="(id || ':' || version || ':' || tag)")} AS stamp,
  CASE WHEN request <> '' THEN {FNV.format(x='request')} ELSE '' END AS request_stamp,
  {FNV.format(x="(id || ':' || version || ':' || tag)")} || ':' || user_id AS cache_key
FROM known""")
def _(t):
    return t.v_prompts.select(
        "log_id", known_prompt("prompt_id").alias("prompt_id"), prompt_version("prompt_id").alias("prompt_version"),
        prompt_stamp("prompt_id").alias("stamp"), request_hash("request").alias("request_stamp"),
        cache_key("prompt_id", F.col("user_id").cast("string")).alias("cache_key"),
    )


@query("brief_hashes", "H20", f"SELECT doc_id, {FNV.format(x='text')} AS hash FROM {{documents}}")
def _(t):
    return t.documents.select("doc_id", character_hash("text").alias("hash"))
