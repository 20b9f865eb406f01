"""The registered queries written once more as SQL over the same tables, as a check."""

from __future__ import annotations

from clickwarden.plans import batch

EV = """
ev as (
  select '172.10.' || (user_id // 255) || '.' || (user_id % 255) as ip,
         json_extract_string(props, '$.k') as category_id, event_type as type, ts as timestamp
  from events
),
daily as (
  select *, time_bucket(interval '1 day', timestamp) as window_start,
         time_bucket(interval '1 day', timestamp) + interval '1 day' as window_end
  from ev
),
sliding as (
  select ip, category_id, type, window_start - step * interval '1 day' as window_start,
         window_start - step * interval '1 day' + interval '2 days' as window_end
  from daily cross join (values (0), (1)) steps(step)
),
hourly as (
  select ip, category_id, type, hour - step * interval '1 hour' as window_start,
         hour - step * interval '1 hour' + interval '1 day' as window_end
  from (select *, time_bucket(interval '1 hour', timestamp) as hour from ev) cross join range(24) steps(step)
),
bounds as (select max(ts) - interval '1 hour' as watermark from events)
"""

CLICKS = "count(*) filter (type = 'click')"
VIEWS = "count(*) filter (type = 'view')"
RATIO = f"{CLICKS} // greatest({VIEWS}, 1)"
GROUP = "group by ip, window_start, window_end"
# A missing category counts as one.
CATEGORIES = "count(distinct category_id) + cast(count(*) > count(category_id) as bigint)"

ACTIVE = f"""
select ip, min(blocked_at) as blocked_at, max(expires_at) as expires_at from (
  select ip, window_end as blocked_at, window_end + interval '{batch.TTL_SECONDS} seconds' as expires_at from found
) where blocked_at <= timestamp '{batch.AS_OF}' and expires_at > timestamp '{batch.AS_OF}' group by ip
"""


def with_events(query: str, *more: str) -> str:
    return "with " + ",".join([EV, *more]) + query


def closed(query: str) -> str:
    """The part of a windowed result whose windows the final watermark has passed."""
    return with_events(
        f" select result.* from ({query}) as result, bounds where result.window_end <= bounds.watermark")


def high_activity(windows: str, limit: int) -> str:
    return (f" select ip, window_start, window_end, 'high_activity' as reason, count(*) as n_events"
            f" from {windows} {GROUP} having count(*) > {limit}")


def ratio_one(windows: str) -> str:
    return (f" select ip, window_start, window_end, 'click_view_ratio' as reason, {CLICKS} as clicks,"
            f" {VIEWS} as views, {RATIO} as ratio from {windows} {GROUP} having {RATIO} > {batch.MAX_RATIO}")


def ratio_join(windows: str) -> str:
    """Clicks joined to views, so that a side without rows drops the ip."""
    one = "select ip, window_start, window_end, count(*) as n from {} where type = '{}' {}"
    clicks, views = one.format(windows, "click", GROUP), one.format(windows, "view", GROUP)
    return (f" select ip, window_start, window_end, 'click_view_ratio' as reason, c.n as clicks, v.n as views,"
            f" c.n // v.n as ratio from ({clicks}) c join ({views}) v using (ip, window_start, window_end)"
            f" where c.n // v.n > {batch.MAX_RATIO}")


def category_spread(windows: str, limit: int) -> str:
    return (f" select ip, window_start, window_end, 'category_spread' as reason,"
            f" {CATEGORIES} as n_categories from {windows} {GROUP} having {CATEGORIES} > {limit}")


ALL_WINDOWS = f"""
 select ip, min(window_start) as window_start, max(window_end) as window_end, 'category_spread' as reason,
        count(*) as n_pairs
 from (select distinct ip, category_id, window_start, window_end from daily)
 group by ip having count(*) > {batch.MAX_PAIRS}
"""

HIGH = high_activity("daily", batch.MAX_EVENTS)
RATIO_ONE = ratio_one("daily")
SPREAD = category_spread("daily", batch.MAX_CATEGORIES)

def detect_all(windows: str) -> str:
    return f"""
 select ip, window_start, window_end,
        concat_ws(',', case when n_events > {batch.MAX_EVENTS} then 'high_activity' end,
                  case when clicks // greatest(views, 1) > {batch.MAX_RATIO} then 'click_view_ratio' end,
                  case when n_categories > {batch.MAX_CATEGORIES} then 'category_spread' end) as reasons,
        n_events, clicks, views, n_categories
 from (select ip, window_start, window_end, count(*) as n_events, {CLICKS} as clicks, {VIEWS} as views,
              {CATEGORIES} as n_categories from {windows} {GROUP})
 where n_events > {batch.MAX_EVENTS} or clicks // greatest(views, 1) > {batch.MAX_RATIO}
       or n_categories > {batch.MAX_CATEGORIES}
"""


DETECT_ALL = detect_all("daily")
UNION = " union all ".join(f"select ip, window_start, window_end, reason from ({part})"
                           for part in (HIGH, RATIO_ONE, SPREAD))


def combined(bucket: str) -> str:
    return f"""
 select ip, time_bucket(interval '{bucket}', window_start, timestamp '1970-01-01') as window_start,
        time_bucket(interval '{bucket}', window_start, timestamp '1970-01-01') + interval '{bucket}' as window_end,
        count(*) as n_detections, string_agg(distinct reason, ',' order by reason) as reasons
 from ({UNION}) group by 1, 2, 3
"""


REJECTS = """,
lines as (select *, epoch_us(timestamp) // 1000000 as seconds from ev)
select '{"unix_time":"' || seconds || '","category_id":"' || category_id || '","ip":"' || ip || '","type":"error"'
       as value, 'unreadable' as reject_reason from lines where type = 'error'
union all
select '{"unix_time":"' || seconds || '","category_id":"' || category_id || '","type":"signup"}',
       'no_ip' from lines where type = 'signup'
union all
select '{"unix_time":"' || seconds || '.5","category_id":"' || category_id || '","ip":"' || ip
       || '","type":"purchase"}', 'bad_time' from lines where type = 'purchase'
"""

# The detections, one after the other, each combined for itself: what early blocking writes.
UPDATED = " union all ".join(
    f"select ip, window_start as blocked_at, window_end + interval '{batch.TTL_SECONDS} seconds' as expires_at, reason"
    f" from ({part})" for part in (HIGH, RATIO_ONE, SPREAD))

# The entries of the combined blocklist that a stream has told when it ends.
TOLD_ENTRIES = f"""entries as (
  select f.ip, f.window_end as blocked_at, f.window_end + interval '{batch.TTL_SECONDS} seconds' as expires_at
  from ({combined('1 day')}) f, bounds where f.window_end <= watermark
)"""

PARSED = with_events(" select ip, category_id, type, date_trunc('second', timestamp) as timestamp from ev")
COMPLETE_HIGH = with_events(HIGH)

SQL = {
    "parse_json_events": PARSED,
    "reject_bad_events": "with " + EV + REJECTS,
    "read_json_files": PARSED,
    "filter_clicks_and_views": with_events(" select * from ev where type in ('click', 'view')"),
    "count_per_window": with_events(
        f" select ip, window_start, window_end, count(*) as n_events from daily {GROUP}"),
    "action_counts_per_window": with_events(
        f" select ip, window_start, window_end, {CLICKS} as clicks, {VIEWS} as views from daily {GROUP}"
        f" having {CLICKS} + {VIEWS} > 0"),
    "category_window_pairs": with_events(
        " select distinct ip, window_start, window_end, category_id from daily"),
    "distinct_categories_per_window": with_events(
        f" select ip, window_start, window_end, {CATEGORIES} as n_categories from sliding {GROUP}"),
    "count_per_window_hourly": with_events(
        f" select ip, window_start, window_end, count(*) as n_events from hourly {GROUP}"),
    "distinct_categories_hourly": with_events(
        f" select ip, window_start, window_end, {CATEGORIES} as n_categories from hourly {GROUP}"),
    "high_activity_hourly": with_events(high_activity("hourly", batch.MAX_EVENTS)),
    "click_view_ratio_hourly": with_events(ratio_one("hourly")),
    "category_spread_hourly": with_events(category_spread("hourly", batch.MAX_CATEGORIES)),
    "detect_all_hourly": with_events(detect_all("hourly")),
    "high_activity_tumbling": with_events(HIGH),
    "high_activity_sliding": with_events(high_activity("sliding", batch.MAX_EVENTS_SLIDING)),
    "click_view_ratio_one": with_events(RATIO_ONE),
    "click_view_ratio_drop": with_events(ratio_join("daily")),
    "click_view_ratio_sliding": with_events(ratio_join("sliding")),
    "category_spread_per_window": with_events(SPREAD),
    "category_spread_sliding": with_events(category_spread("sliding", batch.MAX_CATEGORIES_SLIDING)),
    "category_spread_all_windows": with_events(ALL_WINDOWS),
    "detect_all": with_events(DETECT_ALL),
    "detections_union": with_events(f" {UNION}"),
    "combined_blocklist": with_events(combined("2 days")),
    "blocklist_with_expiry": with_events(
        f" select ip, window_end as blocked_at, window_end + interval '{batch.TTL_SECONDS} seconds' as expires_at,"
        f" reasons from ({combined('1 day')})"),
    "active_blocklist": with_events(ACTIVE, f"found as ({combined('1 day')})"),
    "exclude_ips": with_events(f" select * from ({HIGH}) where ip not in (select ip from ({ALL_WINDOWS}))"),
    "flagged_ips": with_events(f" select ip from ({HIGH})"),
    "preview": with_events(
        f" select ip, window_start, window_end, {CATEGORIES} as n_categories from daily {GROUP}"
        " order by n_categories desc, ip, window_start limit 1000"),
    "kafka_messages": with_events(
        " select ip as key, '{\"ip\":\"' || ip || '\",\"reason\":\"' || reason || '\",\"clicks\":' || clicks"
        f" || ',\"views\":' || views || '}}' as value from ({RATIO_ONE})"),
    "missing_keys": f"""
with gaps as (
  select case when user_id % 7 <> 3 then user_id end as user_id, case when event_type <> 'error' then ts end as ts,
         case when user_id % 3 <> 1 then json_extract_string(props, '$.k') end as category_id
  from events
),
windows as (
  select '172.10.' || (user_id // 255) || '.' || (user_id % 255) as ip, category_id,
         time_bucket(interval '1 day', ts) as window_start,
         time_bucket(interval '1 day', ts) + interval '1 day' as window_end
  from gaps where user_id is not null and ts is not null
)
select ip, window_start, window_end, {CATEGORIES} as n_categories from windows {GROUP}
""",
    "rejected_table_rows": """
select event_type, case when user_id % 7 = 3 then 'no_ip' else 'no_time' end as reject_reason, count(*) as n
from events where user_id % 7 = 3 or event_type = 'error' group by 1, 2
""",
    "stream_spooled_events": PARSED,
    "store_events": PARSED,
    "store_detect_all": with_events(DETECT_ALL),
    "store_detect_all_hourly": with_events(detect_all("hourly")),
    "store_followed_late": closed(DETECT_ALL),
    "stream_rejects": "with " + EV + REJECTS,
    "stream_high_activity_complete": COMPLETE_HIGH,
    "stream_high_activity_update": COMPLETE_HIGH,
    "stream_high_activity_append": closed(HIGH),
    "stream_high_activity_sliding": closed(high_activity("sliding", batch.MAX_EVENTS_SLIDING)),
    "stream_high_activity_hourly": closed(high_activity("hourly", batch.MAX_EVENTS)),
    "stream_detect_all_hourly": closed(detect_all("hourly")),
    "stream_dedup_ips": with_events(" select distinct ip from ev"),
    "stream_click_view_ratio": with_events(RATIO_ONE),
    "stream_click_view_ratio_merged": with_events(RATIO_ONE),
    "stream_click_view_ratio_sliding": closed(ratio_join("sliding")),
    "stream_category_spread_append": closed(SPREAD),
    "stream_category_spread_update": with_events(SPREAD),
    "stream_category_spread_all_windows": with_events(ALL_WINDOWS),
    "stream_detect_all": closed(DETECT_ALL),
    "stream_detect_all_early": with_events(DETECT_ALL),
    "stream_combined_blocklist": closed(combined("1 day")),
    "stream_blocklist_table": with_events(ACTIVE, f"found as (select c.* from ({combined('1 day')}) c, bounds"
                                                  " where window_end <= watermark)"),
    "stream_blocklist_changes": with_events("""
 select ip, 'unblock' as action, before as at, before as expires_at from told, bounds where starts and before is not null
 union all
 select ip, case when starts then 'block' else 'extend' end, blocked_at, expires_at from told
 union all
 select ip, 'unblock', max(expires_at), max(expires_at) from told, bounds group by ip, watermark having max(expires_at) <= watermark
""", TOLD_ENTRIES, """told as (
  select *, before is null or blocked_at > before as starts
  from (select *, max(expires_at) over (partition by ip order by blocked_at rows between unbounded preceding and 1 preceding)
               as before from entries)
)"""),
    "stream_blocklist_keyed": with_events(f"""
 select ip, max(blocked_at) filter (before is null or blocked_at > before) as blocked_at, max(expires_at) as expires_at
 from (select *, max(expires_at) over (partition by ip order by blocked_at rows between unbounded preceding and 1 preceding)
              as before from entries)
 group by ip having max(expires_at) > timestamp '{batch.LAST_AS_OF}'
""", TOLD_ENTRIES),
    "stream_blocklist_replayed": with_events(f"""
 select ip, max(expires_at) as expires_at from entries
 where blocked_at <= timestamp '{batch.AS_OF}' and expires_at > timestamp '{batch.AS_OF}' group by ip
""", TOLD_ENTRIES),
    "stream_click_view_ratio_update": with_events(RATIO_ONE),
    "stream_combined_blocklist_early": with_events(f" {UPDATED}"),
    "stream_blocklist_short_ttl": with_events(f"""
 select f.ip, min(f.window_end) as blocked_at,
        max(f.window_end) + interval '1 hour' + interval '{batch.SHORT_TTL_SECONDS} seconds' as expires_at
 from found f, bounds
 where f.window_end <= watermark and f.window_end <= timestamp '{batch.SHORT_AS_OF}'
       and f.window_end + interval '1 hour' + interval '{batch.SHORT_TTL_SECONDS} seconds' > timestamp '{batch.SHORT_AS_OF}'
 group by f.ip
""", f"found as ({combined('1 day')})"),
    "stream_blocklist_after_expiry": with_events(f"""
 select f.ip, f.window_end as blocked_at, f.window_end + interval '{batch.TTL_SECONDS} seconds' as expires_at, f.reasons
 from found f, bounds
 where f.window_end <= watermark
       and cast(f.window_end + interval '{batch.TTL_SECONDS} seconds' as date) >= date '{batch.AS_OF[:10]}'
""", f"found as ({combined('1 day')})"),
}
