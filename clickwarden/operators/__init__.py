from clickwarden.operators.blocklist import (
    active_blocklist, blocklist, combine_detections, exclude_ips, first_of_each_ip, preview, union_detections)
from clickwarden.operators.counts import (
    action_counts_per_window, activity_early, activity_per_window, category_pair_counts, category_window_pairs, category_words,
    count_per_window, distinct_categories_per_window, with_window)
from clickwarden.operators.detectors import (
    detect_all, detect_all_early, detect_category_spread, detect_click_view_ratio, detect_high_activity, flagged_ips, judge_activity)
from clickwarden.operators.panes import category_dictionary

__all__ = [
    "active_blocklist", "blocklist", "combine_detections", "exclude_ips", "first_of_each_ip", "preview", "union_detections",
    "action_counts_per_window", "activity_per_window", "category_dictionary", "category_pair_counts", "category_window_pairs",
    "category_words",
    "count_per_window", "distinct_categories_per_window", "with_window",
    "activity_early", "judge_activity",
    "detect_all", "detect_all_early", "detect_category_spread", "detect_click_view_ratio", "detect_high_activity", "flagged_ips",
]
