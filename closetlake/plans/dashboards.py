"""The user and the administrator dashboard as sets of lazy results."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from closetlake.functions.taxonomy import taxonomy_values, with_taxonomy
from closetlake.functions.values import as_date
from closetlake.operators import accounts, activity, garments, insights, looks, platform, purchase, quests, report


@dataclass
class Tables:
    """The tables of the service; pieces of looks, wear records, quests and outfits of the day in long form.

    Panels of tables that are not given are left out.
    """

    users: DataFrame
    items: DataFrame
    looks: DataFrame
    look_items: DataFrame
    wear: DataFrame
    wear_items: DataFrame
    quests: DataFrame
    responses: DataFrame
    history: DataFrame
    logs: DataFrame
    quest_items: DataFrame | None = None
    today: DataFrame | None = None
    today_items: DataFrame | None = None

    def tagged(self) -> Tables:
        """With category and slot computed once for all panels."""
        return replace(self, items=with_taxonomy(self.items))

    def cached(self) -> Tables:
        """With the tables that many panels read kept in memory, else on disk."""
        level = StorageLevel.MEMORY_AND_DISK
        return replace(self, items=self.items.persist(level), wear=self.wear.persist(level))

    def release(self) -> None:
        """Let go of what ``cached`` keeps; other tables are the caller's."""
        for table in (self.items, self.wear):
            table.unpersist()


def user_dashboard(t: Tables, as_of) -> dict[str, DataFrame]:
    """Every panel of the user's dashboard, for all users."""
    summary = quests.quest_summary(t.users, t.quests, as_of)
    given = {}
    if t.quest_items is not None:
        given["quest_history"] = quests.quest_history(t.quests, t.quest_items, t.look_items, t.items)
    if t.today is not None and t.today_items is not None:
        given["today"] = insights.today_cards(t.users, t.today, t.today_items, t.look_items, t.items)
    today = t.users.select("user_id", as_date(as_of).alias("wear_date"))
    return given | {
        "day_cards": insights.selected_day_cards(today, t.wear, t.wear_items, t.look_items, t.items, as_of),
        "home_stats": insights.home_stats(t.users, t.items, t.looks, t.wear, t.quests, as_of),
        "home_cards": insights.home_cards(t.users, t.items, t.wear, t.history, as_of),
        "recent_garments": garments.recent_garments(t.items),
        "look_cards": looks.look_cards(t.looks, t.look_items, t.items),
        "look_thumbnails": looks.thumbnails(t.look_items, t.items, 4),
        "calendar": insights.calendar_grid(t.users, t.wear, as_of),
        "day_thumbnails": insights.day_thumbnails(t.wear, t.wear_items, t.items, as_of),
        "insights": insights.insight_summary(t.users, t.items, t.wear),
        "cost_per_wear": garments.cost_per_wear_list(t.items),
        "wear_history": insights.wear_history(t.wear),
        "weekly_report": report.weekly_report(
            t.users, t.items, t.wear, t.wear_items, t.looks, t.look_items, as_of
        ),
        "quests": summary,
        "badges": quests.badges(summary),
        "profile": accounts.profile_rows(t.users),
    }


def admin_dashboard(t: Tables, now) -> dict[str, DataFrame]:
    """Every panel of the administrator's dashboard."""
    rollup = accounts.user_rollup(t.users, t.items, t.looks, t.history, t.wear, t.quests, t.responses, t.logs)
    feed = activity.activity_feed(t.users, t.items, t.looks, t.history, t.wear, t.quests, t.responses, t.logs)
    return {
        "totals": platform.platform_totals(t.users, t.items, t.looks, t.responses, t.history, now),
        "engagement": platform.bar_widths(platform.labelled_counts({
            "Wardrobe": t.items, "Saved outfits": t.looks, "Style checks": t.history,
            "Wears logged": t.wear, "Closet Quests": t.quests, "AI responses": t.responses,
        })),
        "health": platform.api_health(t.logs, now),
        "models": platform.model_performance(t.logs),
        "providers": platform.bar_widths(platform.provider_counts(t.logs)),
        "features": platform.bar_widths(platform.feature_counts(t.responses)),
        "users": rollup,
        "users_page": accounts.users_page(rollup, 1),
        "activity_summary": activity.feed_summary(feed, t.users),
        "activity_page": activity.feed_page(feed, 1),
        "segments": accounts.segment_reach(accounts.segments(rollup, now)),
    }


def purchase_dashboard(candidates: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """Result, similar garments and combinations of every purchase check."""
    values = taxonomy_values(items, candidates)
    items, candidates = with_taxonomy(items, values), purchase.with_kind(candidates, values)
    return {
        "result": purchase.purchase_check(candidates, items),
        "similar": purchase.similar_garments(candidates, items),
        "combinations": purchase.combinations(candidates, items),
    }
