"""What a caller asks for, checked on the driver before a plan is built."""

from __future__ import annotations

import re


def bounded(value: str | int | None, most: int, least: int = 1) -> int | None:
    """A whole number from `least` to `most`; None for anything else."""
    said = str(value).strip() if value is not None else ""
    if not re.fullmatch(r"[0-9]{1,18}", said):
        return None
    n = int(said)
    return n if least <= n <= most else None


def page(value: str | int | None, most: int = 1_000_000) -> int:
    """A page number; 1 for anything that is none."""
    return bounded(value, most) or 1


def tokens(query: str | None, most: int = 100) -> list[str]:
    """The distinct tokens of a query of at most `most` characters, split at space and commas."""
    said = re.sub(r"\s+", " ", (query or "").strip())[:most]
    return list(dict.fromkeys(t for t in re.split(r"[\s,]+", said) if t))


def year_month(year: str | int | None, month: str | int | None, first: int = 1900, last: int = 2100) -> tuple[int | None, int | None] | None:
    """A year and a month of it; (None, None) for all times; None if either is malformed or the month stands alone."""
    if year in (None, ""):
        return (None, None) if month in (None, "") else None
    y = bounded(year, last, first)
    m = bounded(month, 12) if month not in (None, "") else None
    return None if y is None or (month not in (None, "") and m is None) else (y, m)


def pages(total: int, size: int) -> int:
    """How many pages there are, at least one."""
    return max(1, -(-total // size))


def clamp(value: int, total: int, size: int) -> int:
    """A page number within the pages that there are."""
    return min(max(1, value), pages(total, size))
