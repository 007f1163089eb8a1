"""Declared schemas of the logical tables; every field may be missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DDL = {
    "users": """user_id string, full_name string, display_name string, email string, gender string,
        city string, profession string, height double, weight double, date_of_birth string,
        body_type string, skin_tone string, body_type_self_reported string, profile_completion int,
        subscription struct<plan string, last_coupon string, premium_until timestamp>,
        ai_analysis struct<body_type string, skin_tone string, hair_color string>,
        preferences struct<style_lean array<string>, favorite_colors array<string>,
            avoid_colors array<string>, hard_exclusions array<string>, fit_preference string,
            styling_priority string, temp_sensitivity string, environment string, commute string,
            footwear_comfort string,
            coverage_rules struct<sleeveless_allowed boolean, shorts_allowed boolean, fitted_allowed boolean>>,
        login_blocked boolean, account_blocked boolean, ai_daily_limit int,
        created_at timestamp, updated_at timestamp""",
    "wardrobe": """user_id string, item_id string, title string, type string, category string,
        sub_category string, category_role string, layer_role string, body_zone string,
        standalone_outfit boolean, requires_base_layer boolean, brand string, primary_color string,
        secondary_colors array<string>, pattern string, fit string, material string, fabric string,
        sleeve_type string, neckline string, season array<string>, occasion array<string>,
        user_occasions array<string>, activity_suitability array<string>, user_restrictions string,
        set_type string, included_components array<string>, required_components array<string>,
        formality string, tags array<string>, favorite boolean, in_lookbook boolean,
        laundry_status string, hidden_from_ai boolean, purchase_year int, purchase_price double,
        times_worn int, last_worn date, rating double, bg_removed boolean, created_at timestamp""",
    "looks": """user_id string, look_id string, occasion string, title string, subtitle string, score int,
        item_ids array<string>, lookbook boolean, source string, created_at timestamp""",
    "wear": """user_id string, record_id string, outfit_id string, wear_date date, status string,
        occasion string, outfit_title string, notes string, item_ids array<string>, source string, worn_at timestamp,
        created_at timestamp""",
    "quests": """user_id string, submission_id string, challenge_date date, challenge_title string,
        score_total int, points_earned int, item_ids array<string>, outfit_id string, snapshot_title string,
        snapshot_occasion string, created_at timestamp""",
    "today": "user_id string, outfit_id string, outfit_title string, title string, item_ids array<string>",
    "ai_responses": "user_id string, id string, feature string, type string, ts timestamp, created_at timestamp",
    "outfit_history": "user_id string, id string, feature string, type string, ts timestamp, created_at timestamp",
    "api_logs": """log_id string, user_id string, provider string, model string, type string,
        feature string, operation string, endpoint string, status string, response_time double,
        duration_ms double, latency_ms double, error_message string, ts timestamp""",
    "coupons": """code string, plan string, days int, active boolean, redeemed_count int,
        max_redemptions int, expires_at timestamp, campaign_label string, created_at timestamp""",
    "deletion_requests": "user_id string, status string, requested_at timestamp, reviewed_at timestamp",
    "campaigns": """id string, title string, body string, status string, channel string,
        image_url string, audience string, destination string, festival_campaign_id string,
        payload struct<title string, body string, image_url string, channel string, route string>,
        audience_filter struct<type string, inactive_days int, garment_threshold int, specific_uids array<string>>,
        festival struct<campaign_id string, festival_name string, mode_id string, delivery string>,
        unique_targeted_users bigint, device_targets bigint, targeted_devices bigint,
        sent bigint, failed bigint, opened bigint, scheduled_for timestamp, created_at timestamp""",
    "share_links": "id string, click_count bigint, clicks bigint",
    "share_attribution": "id string, activated boolean, event string",
    "app_config": "id string, kill_switch boolean, default_daily_limit int, message string",
    "candidates": """user_id string, candidate_id string, title string, category string, sub_category string,
        category_role string, primary_color string, pattern string, material string, brand string,
        tags array<string>, price double""",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(_DDL[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """Add the declared fields a table lacks, as nulls."""
    missing = {
        f.name: F.lit(None).cast(f.dataType) for f in schema(table).fields if f.name not in df.columns
    }
    return df.withColumns(missing) if missing else df
