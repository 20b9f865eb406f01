"""Detect automated traffic in ad events, on batch tables and on streams, with one set of operators."""

from clickwarden.functions import *  # noqa: F401,F403
from clickwarden.operators import *  # noqa: F401,F403
from clickwarden.session import build_session, scratch_dir  # noqa: F401
from clickwarden.sinks import *  # noqa: F401,F403
from clickwarden.sources import *  # noqa: F401,F403
from clickwarden.streaming import *  # noqa: F401,F403
