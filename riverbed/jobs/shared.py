"""SQL that several query modules use."""

from __future__ import annotations

from ..sources.tables import EVENTS_SQL

HOUR = 3_600_000_000

LEFT_SQL, RIGHT_SQL = f"(SELECT * FROM {EVENTS_SQL} WHERE event_type = 'view')", f"(SELECT * FROM {EVENTS_SQL} WHERE event_type = 'purchase')"

LATE_SQL = f"""(SELECT * FROM (SELECT event_id, us, cents, arrival, max(us) OVER (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) - {HOUR} AS watermark, us // {2 * HOUR} * {2 * HOUR} AS pane
FROM (SELECT *, event_id + 40 * (event_id % 5) AS arrival FROM {EVENTS_SQL})) WHERE watermark < pane + {2 * HOUR} + {6 * HOUR})"""
