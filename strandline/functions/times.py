"""Natural-language instants, read on the driver."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

_UNIT = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 7 * 86_400, "month": 30 * 86_400, "year": 365 * 86_400}
_WORDS = {"now": 0, "today": 0, "yesterday": 86_400, "last week": 7 * 86_400, "last month": 30 * 86_400, "last year": 365 * 86_400}


def parse_time(text: str, now: dt.datetime, tag: Callable[[str], dt.datetime | None] | None = None) -> dt.datetime | None:
    """ISO dates, epoch seconds or milliseconds, "n units ago" (a month is 30
    days), now / yesterday / last week / month / year, each after an optional
    since / after / before; anything else goes to the tag resolver."""
    s = re.sub(r"^(since|after|before|from|until)\s+", "", text.strip().lower())
    if s in _WORDS:
        return now - dt.timedelta(seconds=_WORDS[s])
    m = re.fullmatch(r"(\d+|an?)\s+(second|minute|hour|day|week|month|year)s?\s+ago", s)
    if m:
        n = 1 if m[1] in ("a", "an") else int(m[1])
        return now - dt.timedelta(seconds=n * _UNIT[m[2]])
    if re.fullmatch(r"\d{10}|\d{13}", s):
        v = int(s) / (1000 if len(s) == 13 else 1)
        return dt.datetime(1970, 1, 1) + dt.timedelta(seconds=v)
    if re.match(r"\d{4}-\d{2}-\d{2}", s):
        try:
            v = dt.datetime.fromisoformat(s.upper().replace("Z", "+00:00"))
        except ValueError:
            return None
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None) if v.tzinfo else v
    return tag(text.strip()) if tag else None
