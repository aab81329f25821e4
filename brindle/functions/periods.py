"""Named periods, on the driver."""

from __future__ import annotations

from datetime import date, timedelta

# The names of the periods.
THIS_MONTH, LAST_MONTH, THIS_QUARTER, LAST_QUARTER, THIS_YEAR = "本月", "上月", "本季度", "上季度", "本年"


def period(name: str | None, today: date) -> tuple[date, date]:
    """First and last day, both included: a period that has begun ends today; an earlier one on its last day. Other names mean this month."""
    month, quarter = today.replace(day=1), date(today.year, (today.month - 1) // 3 * 3 + 1, 1)
    if name == LAST_MONTH:
        last = month - timedelta(days=1)
        return last.replace(day=1), last
    if name == LAST_QUARTER:
        last = quarter - timedelta(days=1)
        return date(last.year, (last.month - 1) // 3 * 3 + 1, 1), last
    return {THIS_QUARTER: quarter, THIS_YEAR: date(today.year, 1, 1)}.get(name or "", month), today
