"""The limits, durations and names a detection run starts from."""

# Limits; a group is flagged when its number is strictly greater.
MAX_EVENTS = 1000
MAX_RATIO = 5
MAX_CATEGORIES = 5

# Action names found in the `type` field.
CLICK = "click"
VIEW = "view"

# Tumbling window, and the sliding pair for near-real-time use.
WINDOW = "10 minutes"
SLIDING_WINDOW = "60 seconds"
SLIDING_STEP = "30 seconds"

# Combining detections, and how long a block lasts.
COMBINE_WINDOW = "60 seconds"
TTL_SECONDS = 60

# Streaming runs; the second is a time limit to give to `--timeout`, not one that applies by itself.
BATCH_INTERVAL = "10 seconds"
RUN_SECONDS = 65

PREVIEW_ROWS = 1000
