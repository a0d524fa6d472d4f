"""Column-level scalar expressions (all JVM-side, whole-stage-codegen safe)."""

from noticeflow.functions.text import strip_ws, upper_strip, normalize_id, null_tokens  # noqa: F401
from noticeflow.functions.dates import parse_ddmmyy, days_between  # noqa: F401
from noticeflow.functions.codes import cpv_prefix  # noqa: F401
from noticeflow.functions.lists import (  # noqa: F401
    nuts_region_count, nuts_level, winner_count, winner_country_count, sme_winner_count,
)
from noticeflow.functions.flags import yes_no_binary, positive_flag  # noqa: F401
