"""Status codes, errors and times as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIMEOUT = ("timeout", "timed out", "network-error", "unknown-error", "econn", "enotfound", "eai_again", "socket hang up")


def failure_kind(error: Column) -> Column:
    """The kind of a recorded error; null for none."""
    reason = F.regexp_replace(error, r"^attempts-exhausted:\s*", "")
    low = F.lower(reason)
    kind = (
        F.when(reason.rlike(r"^http-40[13]\b"), "blocked403")
        .when(reason.rlike(r"^http-429\b"), "rateLimited429")
        .when(reason.rlike(r"^http-408\b"), "timeout")
        .when(reason.rlike(r"^http-5\d\d\b"), "serverError")
        .when(reason.rlike(r"^http-4\d\d\b"), "permanent")
        .when(low.rlike("|".join(_TIMEOUT)), "timeout")
        .otherwise("other")
    )
    return F.when(F.coalesce(error, F.lit("")) != "", kind)


def http_decision(status: Column) -> Column:
    """What follows from the status of a response."""
    return (
        F.when(status.between(200, 299), "success")
        .when(status.isin(408, 429) | status.between(500, 599), "retry")
        .when(status.isin(404, 410), "permanent")
        .when(status.isin(401, 403), "blocked")
        .when(status.between(400, 499), "permanent")
        .when(status.isNotNull(), "retry")
    )


def content_type(value: Column) -> Column:
    """A MIME type in lower case, without parameters."""
    return F.lower(F.trim(F.substring_index(F.coalesce(value, F.lit("")), ";", 1)))


def backoff(attempt: Column, base: int = 60, most: int = 3600) -> Column:
    """Seconds until the next attempt: doubled each time, up to `most`."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1), F.lit(float(most))).cast("bigint")


def time_ago(then: Column, now: Column) -> Column:
    """A distance in time in words, from times in seconds."""
    s = now - then
    return (
        F.when(s < 60, "just now")
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 86_400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .when(s < 172_800, "yesterday")
        .otherwise(F.concat(F.floor(s / 86_400).cast("string"), F.lit("d ago")))
    )


def ist_day(instant: Column) -> Column:
    """The calendar day of an instant in India."""
    return F.to_date(F.from_utc_timestamp(instant, "Asia/Kolkata"))


def ist_midnight(instant: Column, days_before: int = 0) -> Column:
    """Midnight in India of that day, some days before."""
    local = F.date_trunc("day", F.from_utc_timestamp(instant, "Asia/Kolkata"))
    return F.to_utc_timestamp(local - F.expr(f"INTERVAL {days_before} DAYS"), "Asia/Kolkata")


# Names of months in a short date.
_SHORT = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def format_stamp(instant: Column) -> Column:
    """Day, short month and minute of an instant in India, as "03 Mar, 09:05"; null stays null."""
    local = F.from_utc_timestamp(instant, "Asia/Kolkata")
    month = F.element_at(F.array(*[F.lit(m) for m in _SHORT]), F.month(local))
    return F.concat(F.lpad(F.dayofmonth(local).cast("string"), 2, "0"), F.lit(" "), month, F.lit(", "), F.date_format(local, "HH:mm"))


def retry_after(value: Column, now: Column, most: int = 3600) -> Column:
    """Seconds to wait by a header of seconds or of an HTTP date, from 0 to `most`; null for anything else. now: a timestamp."""
    said = F.trim(value)
    seconds = F.when(said.rlike(r"^\d{1,9}$"), said.cast("bigint"))
    bare = F.regexp_extract(said, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1)
    at = F.when(bare != "", F.try_to_timestamp(bare, F.lit("dd MMM yyyy HH:mm:ss")))
    left = F.ceil((F.unix_micros(F.to_utc_timestamp(at, F.current_timezone())) - F.unix_micros(now)) / 1_000_000)
    return F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(seconds, left))) * F.when(seconds.isNotNull() | left.isNotNull(), 1)


def error_decision(error: Column) -> Column:
    """What follows from an error without a response: another try."""
    return F.when(F.coalesce(error, F.lit("")) != "", "retry")


def hours_ago(then: Column, now: Column) -> Column:
    """time_ago() with hours up to two days instead of "yesterday"."""
    s = now - then
    return F.when((s >= 86_400) & (s < 172_800), F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago"))).otherwise(time_ago(then, now))


def named_together(text: Column, one: list[str], other: list[str]) -> Column:
    """Whether a text has a word of each of two lists, at word limits, in any letter case."""
    has = lambda words: text.rlike("(?iu)(?<![\\p{L}\\p{M}\\p{N}])(?:" + "|".join(words) + ")(?![\\p{L}\\p{M}\\p{N}])")
    return F.coalesce(has(one) & has(other), F.lit(False))
