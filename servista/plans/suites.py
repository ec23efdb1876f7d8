"""Rule suites of the three layers."""

from __future__ import annotations

from servista.functions.clean import LATITUDE, LONGITUDE, STATUSES
from servista.operators.quality import Rule, rule

# Required columns, tolerances and bounds of each layer.
_RAW = ("sr_number", "created_date", "sr_type", "status", "ward", "latitude", "longitude")


def _box(mostly: float, action: str) -> list[Rule]:
    return [rule("between", "ward", low=1, high=50, mostly=mostly, action=action), rule("between", "latitude", low=LATITUDE[0], high=LATITUDE[1], mostly=mostly, action=action), rule("between", "longitude", low=LONGITUDE[0], high=LONGITUDE[1], mostly=mostly, action=action)]


BRONZE = [
    *[rule("exists", c, action="info") for c in _RAW],
    *[rule("not_null", c, action="fail" if c == "sr_number" else "drop") for c in _RAW[:4]],
    *[rule("not_null", c, mostly=0.99) for c in _RAW[4:]],
    rule("not_null", "closed_date", mostly=0.8, action="info"),
    rule("unique", "sr_number"),
    rule("one_of", "status", values=("Open", "Completed", "Canceled"), mostly=0.99, action="drop"),
    *_box(0.95, "warn"),
    rule("row_count", low=1000),
]
SILVER = [
    *[rule("exists", c, action="info") for c in _RAW[:5]],
    *[rule("not_null", c, action="fail") for c in _RAW[:5]],
    rule("one_of", "status", values=STATUSES, action="fail"),
    *_box(0.99, "fail"),
    rule("unique", "sr_number", action="fail"),
    rule("row_count", low=1000, action="fail"),
]
GOLD = [
    *[rule("exists", c, action="info") for c in ("date", "ward", "sr_type", "total_requests", "completion_rate")],
    *[rule("not_null", c, action="fail") for c in ("date", "ward", "sr_type", "total_requests")],
    rule("between", "total_requests", low=1, action="fail"),
    rule("between", "completion_rate", low=0.0, high=1.0, action="fail"),
    rule("between", "ward", low=1, high=50),
    rule("unique_combination", "date", "ward", "sr_type", "is_info_call", action="fail"),
    rule("row_count", low=100),
]
SCD2 = [
    rule("not_null", "sr_number", action="fail"),
    rule("not_null", "__START_AT", action="fail"),
    rule("sql", name="version_rate_healthy", sql="round(count(*) * 1.0 / count(DISTINCT sr_number), 2) BETWEEN 1.0 AND 2.0"),
]
