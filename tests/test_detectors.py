from collections import defaultdict
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from clickwarden import (
    action_counts_per_window, activity_per_window, category_window_pairs, count_per_window, detect_all,
    detect_category_spread, detect_click_view_ratio, detect_high_activity, distinct_categories_per_window,
    events_from_json_lines, flagged_ips)
from tests.data import BOT, MIDNIGHT, at, frame, ips, many_users, one_user

SLIDING = {"window_duration": "60 seconds", "slide_duration": "30 seconds"}
DETECTORS = {
    "high_activity": detect_high_activity,
    "ratio_one": detect_click_view_ratio,
    "ratio_drop": lambda events, **more: detect_click_view_ratio(events, missing_views="drop", **more),
    "spread_per_window": detect_category_spread,
    "spread_all_windows": lambda events, **more: detect_category_spread(events, scope="all_windows", **more),
    "all": detect_all,
}


@pytest.mark.parametrize("lines", [many_users, one_user])
@pytest.mark.parametrize("windows", [{}, SLIDING], ids=["tumbling", "sliding"])
@pytest.mark.parametrize("name", DETECTORS)
def test_only_the_bot_is_found_with_the_default_limits(spark, name, windows, lines):
    found = DETECTORS[name](events_from_json_lines(spark, lines()), **windows)
    assert set(ips(found)) == {BOT}


def test_numbers_of_the_bot(spark):
    row = detect_all(events_from_json_lines(spark, many_users())).collect()[0]
    assert (row.n_events, row.clicks, row.views, row.n_categories) == (1008, 1004, 4, 8)
    assert row.reasons == ["high_activity", "click_view_ratio", "category_spread"]
    ratio = detect_click_view_ratio(events_from_json_lines(spark, many_users())).collect()[0]
    assert (ratio.clicks, ratio.views, ratio.ratio) == (1004, 4, 251)


def test_window_columns(spark):
    events = frame(spark, [("a", "1", "click", at(minutes=17))] * 2)
    row = detect_high_activity(events, 1).collect()[0]
    assert (row.window_start, row.window_end) == (at(minutes=10), at(minutes=20))
    assert row.event_time == at(minutes=20) - timedelta(microseconds=1)
    assert row.reason == "high_activity"


def activity(ip, clicks=0, views=0, categories=1, other=0, **when):
    kinds = ["click"] * clicks + ["view"] * views + ["error"] * other
    return [(ip, str(i % categories), kind, at(**when)) for i, kind in enumerate(kinds)]


def test_high_activity_limit_is_strict_and_counts_all_types(spark):
    events = frame(spark, activity("at", other=500, clicks=500) + activity("over", other=500, views=501))
    assert ips(detect_high_activity(events)) == ["over"]


@pytest.mark.parametrize("clicks, views, one, drop", [
    (5, 1, False, False), (6, 1, True, True), (11, 2, False, False), (12, 2, True, True),
    (5, 0, False, False), (6, 0, True, False), (0, 3, False, False)])
def test_ratio(spark, clicks, views, one, drop):
    events = frame(spark, activity("a", clicks, views, other=100))
    assert bool(ips(detect_click_view_ratio(events))) is one
    assert bool(ips(detect_click_view_ratio(events, missing_views="drop"))) is drop
    reasons = [row.reasons for row in detect_all(events, max_events=10**6, max_categories=10**6).collect()]
    assert reasons == ([["click_view_ratio"]] if one else [])


def test_ratio_is_judged_per_window(spark):
    events = frame(spark, activity("a", clicks=4, minutes=1) + activity("a", clicks=4, minutes=11)
                   + activity("b", clicks=6, minutes=1) + activity("b", views=6, minutes=11))
    assert ips(detect_click_view_ratio(events)) == ["b"]


def test_ratio_ignores_other_types(spark):
    events = frame(spark, [("a", "1", kind, at()) for kind in ("click", None, "CLICK", "purchase")])
    row = action_counts_per_window(events).collect()[0]
    assert (row.clicks, row.views) == (1, 0)
    assert action_counts_per_window(frame(spark, [("a", "1", "error", at())])).count() == 0


def test_category_limit_is_strict(spark):
    events = frame(spark, activity("five", clicks=20, categories=5) + activity("six", clicks=20, categories=6))
    assert ips(detect_category_spread(events)) == ["six"]
    assert ips(detect_category_spread(events, scope="all_windows")) == ["six"]


def test_one_category_in_six_windows(spark):
    events = frame(spark, [("a", "1", "view", at(minutes=10 * i)) for i in range(6)])
    assert ips(detect_category_spread(events)) == []
    row = detect_category_spread(events, scope="all_windows").collect()[0]
    assert (row.ip, row.n_pairs, row.window_start, row.window_end) == ("a", 6, at(), at(minutes=60))


def test_missing_category_counts_as_one(spark):
    events = frame(spark, [("a", None, "view", at()), ("a", None, "view", at()), ("a", "1", "view", at())])
    assert distinct_categories_per_window(events).collect()[0].n_categories == 2
    assert activity_per_window(events).collect()[0].n_categories == 2
    assert category_window_pairs(events).count() == 2


def test_an_ip_comes_once_per_window_it_is_flagged_in(spark):
    events = frame(spark, activity("a", clicks=3, minutes=1) + activity("a", clicks=3, minutes=11))
    assert ips(flagged_ips(detect_high_activity(events, 2))) == ["a", "a"]
    assert flagged_ips(detect_high_activity(events, 2)).columns == ["ip"]


def test_sliding_windows_see_what_tumbling_ones_split(spark):
    events = frame(spark, activity("a", clicks=3, seconds=50) + activity("a", clicks=3, seconds=70))
    assert ips(detect_high_activity(events, 5, "60 seconds")) == []
    rows = detect_high_activity(events, 5, **SLIDING).collect()
    assert [(row.window_start, row.window_end) for row in rows] == [(at(seconds=30), at(seconds=90))]


def test_rows_without_time_or_on_either_time_type(spark):
    rows = activity("a", clicks=3) + [("a", "1", "click", None)]
    assert count_per_window(frame(spark, rows)).collect()[0].n_events == 3
    instants = frame(spark, rows).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    assert count_per_window(instants).collect()[0].n_events == 3


def test_a_batch_needs_no_watermark_and_ignores_one(spark):
    events = frame(spark, activity("a", clicks=3))
    assert ips(detect_high_activity(events, 2, watermark_delay="1 minute")) == ["a"]


@pytest.mark.parametrize("call", [
    lambda e: detect_high_activity(e, -1), lambda e: detect_high_activity(e, 1.5),
    lambda e: detect_click_view_ratio(e, True), lambda e: detect_click_view_ratio(e, missing_views="two"),
    lambda e: detect_category_spread(e, scope="x"), lambda e: detect_category_spread(e, "5"),
    lambda e: distinct_categories_per_window(e, mode="x")])
def test_bad_arguments(spark, call):
    with pytest.raises(ValueError):
        call(frame(spark, activity("a", 1)))


EVENTS = st.lists(st.tuples(
    st.sampled_from(["a", "b", "c"]), st.sampled_from(["1", "2", "3", None]),
    st.sampled_from(["click", "click", "view", "error"]),
    st.integers(0, 240).map(lambda s: MIDNIGHT + timedelta(seconds=s))), min_size=1, max_size=60)


def windows_of(time, length, step):
    seconds = int((time - MIDNIGHT).total_seconds())
    first = (seconds - length) // step + 1
    return [at(seconds=s * step) for s in range(first, seconds // step + 1)]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=EVENTS, length_and_step=st.sampled_from([(60, 60), (60, 30), (90, 30)]),
       missing=st.sampled_from(["one", "drop"]))
def test_against_plain_python(spark, rows, length_and_step, missing):
    length, step = length_and_step
    groups = defaultdict(list)
    for ip, category, kind, time in rows:
        for start in windows_of(time, length, step):
            groups[ip, start].append((category, kind))
    limits = {"max_events": 3, "max_ratio": 1, "max_categories": 2}
    high, ratio, spread, together, pairs = set(), set(), set(), {}, defaultdict(set)
    for (ip, start), acts in groups.items():
        clicks, views = (sum(kind == name for _, kind in acts) for name in ("click", "view"))
        reasons = []
        if len(acts) > 3:
            reasons.append("high_activity")
            high.add((ip, start, len(acts)))
        if clicks // max(views, 1) > 1 and (views or missing == "one"):
            reasons.append("click_view_ratio")
            ratio.add((ip, start, clicks, views))
        categories = {category for category, _ in acts}
        pairs[ip] |= {(category, start) for category in categories}
        if len(categories) > 2:
            reasons.append("category_spread")
            spread.add((ip, start, len(categories)))
        if reasons:
            together[ip, start] = (reasons, len(acts), clicks, views, len(categories))

    events = frame(spark, rows)
    when = {"window_duration": f"{length} seconds", "slide_duration": f"{step} seconds"}
    assert {(r.ip, r.window_start, r.n_events)
            for r in detect_high_activity(events, 3, **when).collect()} == high
    assert {(r.ip, r.window_start, r.clicks, r.views)
            for r in detect_click_view_ratio(events, 1, missing_views=missing, **when).collect()} == ratio
    assert {(r.ip, r.window_start, r.n_categories)
            for r in detect_category_spread(events, 2, **when).collect()} == spread
    assert {(r.ip, r.n_pairs) for r in detect_category_spread(events, 2, scope="all_windows", **when).collect()} == {
        (ip, len(found)) for ip, found in pairs.items() if len(found) > 2}
    assert {(r.ip, r.window_start): (r.reasons, r.n_events, r.clicks, r.views, r.n_categories)
            for r in detect_all(events, **limits, missing_views=missing, **when).collect()} == together
