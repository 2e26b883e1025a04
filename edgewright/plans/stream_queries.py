"""Queries of the streaming extension, on the event table."""

from __future__ import annotations

from edgewright.runtime import table
from edgewright.streaming import verdicts


def ext_event_windows(spark, d):
    return verdicts.windowed_events(table(spark, d, "events")).selectExpr("window_start", "event_type", "n")


QUERIES = {"ext_event_windows": ext_event_windows}
ORACLE = {"ext_event_windows": "select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2"}
