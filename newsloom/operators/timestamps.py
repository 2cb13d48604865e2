"""Timestamps written in many ways, brought to one UTC instant.

Values are parsed to local wall time inside the JVM. Wall time becomes an instant by an as-of join
with the intervals between two changes of a zone's offset, measured on the zone's own wall clock
and exploded by zone and year, so the join has equality keys. Two intervals hold a time that the
clock shows twice, none holds a time it skips, and one gives the offset. Before FIRST_YEAR a zone keeps its
first offset; after LAST_YEAR a year stands for one of the 28 before that with the same days of the week.
"""

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of months, as written in the languages of the sources.
MONTHS = {
    1: "january jan जनवरी जन जनवरि জানুয়ারি জানুয়ারী جنوری",
    2: "february feb फरवरी फ़रवरी फेब्रुअरी ফেব্রুয়ারি ফেব্রুয়ারী فروری",
    3: "march mar मार्च মার্চ مارچ",
    4: "april apr अप्रैल अप्रिल এপ্রিল اپریل",
    5: "may मई मे মে مئی",
    6: "june jun जून जुन জুন جون",
    7: "july jul जुलाई जुलाइ জুলাই جولائی",
    8: "august aug अगस्त अगस्ट আগস্ট اگست",
    9: "september sep sept सितंबर सितम्बर सेप्टेम्बर সেপ্টেম্বর ستمبر",
    10: "october oct अक्टूबर अक्तूबर अक्टोबर অক্টোবর اکتوبر",
    11: "november nov नवंबर नवम्बर नोभेम्बर নভেম্বর نومبر",
    12: "december dec दिसंबर दिसम्बर डिसेम्बर ডিসেম্বর دسمبر",
}
DIGITS = "०१२३४५६७८९০১২৩৪৫৬৭৮৯٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９"
ASCII_DIGITS = "0123456789" * 5

# Customary abbreviations of zones for which the zone database has only numbers.
ABBREVIATIONS = {
    "Asia/Dubai": "gst", "Asia/Kathmandu": "npt", "Asia/Katmandu": "npt", "Asia/Dhaka": "bst", "Asia/Singapore": "sgt", "Asia/Colombo": "slst",
    "Asia/Thimphu": "btt", "Asia/Kabul": "aft", "Asia/Riyadh": "ast", "Asia/Qatar": "ast", "Asia/Yangon": "mmt", "Asia/Kuala_Lumpur": "myt",
}

_TIME = r"(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,](\d{1,9})\d*)?)?"
_HALF = r"(?:\s*([ap])\.?m\.?)?"
_TAIL = (
    r"(?:\s*(?:बजे|बज|টায়|টা|بجے))?(?:\s*\(?([a-z]{1,5})\)?)?(?:\s*([+-]\d{1,2}(?::?\d{2})?))?"
    r"(?:\s*\[([a-z0-9_/+-]+)\])?(?:\s*\([a-z ]+\))?$"
)
_DAY = r"(?:\p{L}[\p{L}\p{M}]*\.?,?\s+)?"
_MONTH = r"(\p{L}[\p{L}\p{M}]+)\.?,?"
_SEP = r"(?:,?\s+(?:at\s+|को\s+)?|,\s*)"

# Each form: its pattern, and where its groups stand in (year, month, day, hour, minute, second, fraction, half, abbreviation, offset, zone).
_FORMS = (
    (r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?:t|,?\s+)" + _TIME + _HALF + _TAIL, (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)),
    (r"^(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})()()(?:\s*([a-z]{1,5}))?([+-]\d{2}:?\d{2})?()$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)),
    (r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})()()()(?:\s*([a-z]{1,5}))?([+-]\d{2}:?\d{2})?()$", (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11)),
    (r"^" + _DAY + r"(\d{1,2})(?:st|nd|rd|th)?[\s-]+" + _MONTH + r"[\s-]+(\d{4})" + _SEP + _TIME + _HALF + _TAIL, (3, 2, 1, 4, 5, 6, 7, 8, 9, 10, 11)),
    (r"^" + _DAY + _MONTH + r"\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})" + _SEP + _TIME + _HALF + _TAIL, (3, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11)),
    # of the C library: Tue Mar 3 10:00:00 IST 2026; of RFC 850: Tuesday, 03-Mar-26 10:00:00 GMT
    (r"^" + _DAY + _MONTH + r"\s+(\d{1,2})\s+(\d{1,2}):(\d{2}):(\d{2})()()(?:\s+([a-z]{1,5}))?(?:\s+([+-]\d{2}:?\d{2}))?\s+(\d{4})()$", (10, 1, 2, 3, 4, 5, 6, 7, 8, 9, 11)),
    (r"^\p{L}+,\s+(\d{1,2})-" + _MONTH + r"-(\d{2})\s+(\d{1,2}):(\d{2}):(\d{2})()()(?:\s+([a-z]{1,5}))?(?:\s+([+-]\d{2}:?\d{2}))?()$", (3, 2, 1, 4, 5, 6, 7, 8, 9, 10, 11)),
)
_NUMERIC = r"^" + _DAY + r"(\d{1,2})[-./](\d{1,2})[-./](\d{4})" + _SEP + _TIME + _HALF + _TAIL
_EPOCH = r"^(?:/date\()?(\d{9,19})(?:[.,](\d{1,9})\d*)?(?:[+-]\d{4})?(?:\)/)?$"

FIRST_YEAR, LAST_YEAR = 1840, 2099
#: Seconds beyond all walls, and the most minutes of an offset that a value may state.
_FAR, _MOST = 1 << 60, 18 * 60
_EPOCH_START = datetime(1970, 1, 1, tzinfo=timezone.utc)


@lru_cache(maxsize=None)
def zone_intervals(zone: str, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> tuple:
    """(year, [(from, to, offset, abbreviation)]) of a zone; from and to are local seconds."""
    try:
        tz = ZoneInfo(zone)
    except Exception:  # an unknown name has no intervals
        return ()
    state = lambda s: ((d := datetime.fromtimestamp(s, tz)).utcoffset().total_seconds(), d.tzname())
    start, end = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - _EPOCH_START).total_seconds()) for y in (first, last + 1))
    start, end = start - 172_800, end + 172_800
    spans, begun, was, at = [], start, state(start), start
    while at < end:
        then = min(at + 14 * 86_400, end)
        now = state(then)
        if now != was:
            low, high = at, then
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if state(mid) == was else (low, mid)
            spans.append((begun, high, int(was[0]), was[1]))
            begun, was, then = high, state(high), high
        at = then
    spans.append((begun, end, int(was[0]), was[1]))
    spans[0] = (-_FAR, *spans[0][1:])
    years = []
    for year in range(first, last + 1):
        low, high = (int((datetime(y, 1, 1, tzinfo=timezone.utc) - _EPOCH_START).total_seconds()) for y in (year, year + 1))
        held = [(a + o, b + o, o, ABBREVIATIONS.get(zone, "") if n[:1] in "+-" else n.lower()) for a, b, o, n in spans if a + o < high and b + o > low]
        years.append((year, held))
    return tuple(years)


def offset_intervals(spark: SparkSession, zones: list[str]) -> DataFrame:
    """One row a zone and year with the intervals of that year; at most as many rows as there are IANA zones times years."""
    rows = [(z, year, held) for z in sorted(set(zones)) for year, held in zone_intervals(z)]
    return spark.createDataFrame(rows, "zone string, year int, spans array<struct<lo: bigint, hi: bigint, off: bigint, abbr: string>>")


@lru_cache(maxsize=1)
def zone_names() -> dict[str, str]:
    """IANA zones by their names in lower case."""
    return {z.lower(): z for z in sorted(available_timezones())}


def named_zones(values: DataFrame, value: str) -> list[str]:
    """The zones that values name in brackets; at most as many as the zone database has."""
    rows = values.where(F.col(value).contains("[")).select(F.regexp_extract(clean(F.col(value)), r"\[([a-z0-9_/+-]+)\]", 1).alias("z"))
    return [zone_names()[r[0]] for r in rows.where(F.col("z").isin(list(zone_names()))).distinct().collect()]


def clean(value: Column) -> Column:
    """Digits of any script as ASCII, one kind of minus and of space, lower case."""
    value = F.translate(value, DIGITS + "−–—   ", ASCII_DIGITS + "---   ")
    return F.lower(F.trim(F.regexp_replace(value, r"[\s​-‏﻿]+", " ")))


def _day_of(year: int) -> int:
    return (datetime(year, 1, 1, tzinfo=timezone.utc) - _EPOCH_START).days


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Gregorian date."""
    y = y - F.when(m <= 2, 1).otherwise(0)
    return y * 365 + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400) + F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1 - 719468


def parse(value: Column, order: Column) -> Column:
    """A struct: kind (instant, local, date or none), us (micros: UTC of an instant, wall clock of a local time), abbr, off (seconds or null), zone."""
    v = clean(value)
    mark = "\u0001"
    number = lambda c: F.when(c != "", c.cast("bigint"))

    def canon(pattern: str, at: tuple) -> Column:
        return F.when(v.rlike(pattern), F.regexp_replace(v, pattern, mark.join(f"${i}" for i in at)))

    rest = (4, 5, 6, 7, 8, 9, 10, 11)
    mdy = F.coalesce(F.lower(order), F.lit("dmy")) == "mdy"
    text = F.coalesce(
        *(canon(p, at) for p, at in _FORMS),
        F.when(mdy, canon(_NUMERIC, (3, 1, 2, *rest))).otherwise(canon(_NUMERIC, (3, 2, 1, *rest))),
    )
    months = F.create_map(*[F.lit(x) for n, names in MONTHS.items() for name in dict.fromkeys([*names.split(), str(n), f"{n:02d}"]) for x in (name, n)])
    epoch = F.when(v.rlike(_EPOCH) & ~v.rlike(r"^\d{14}$"), F.regexp_replace(v, _EPOCH, mark.join(("$1", "$2"))))
    return F.struct(v.alias("v"), F.split(text, mark).alias("p"), F.split(epoch, mark).alias("e"), months.alias("m")), number


def normalise(df: DataFrame, value: str, zone: str, order: str, out: str = "utc_us") -> DataFrame:
    """df with `out` (bigint, micros since 1970 UTC or null) and `out`_status for the string column `value`.

    zone and order name columns with the IANA zone whose wall clock is written and the order of
    numeric dates (dmy or mdy; null is dmy); a zone in brackets goes before it. Status: ok; ambiguous (the wall clock shows the time
    twice), nonexistent (it skips it), no_zone (no zone is known, or the abbreviation isn't one of
    the zone's), invalid (an impossible date, time or offset), unparsed (null, empty, no date and time).
    Repeated rows stay repeated; other columns pass through, whatever their names.
    """
    named = df.select(zone).where(F.col(zone).isin(sorted(available_timezones()))).distinct()  # at most as many as the zone database has
    return attach(df, value, zone, order, offset_intervals(df.sparkSession, [r[0] for r in named.collect()] + named_zones(df, value)), out)


def attach(df: DataFrame, value: str, zone: str, order: str, intervals: DataFrame, out: str = "utc_us") -> DataFrame:
    """normalise() with given intervals, so that callers that know their zones need no pass over the data."""
    keep = df.columns
    x, number = parse(F.col(value), F.col(order))
    p = lambda i: F.col("__nl_x.p")[i]
    df = df.withColumn("__nl_x", x)
    df = df.withColumn("__nl_mo", F.col("__nl_x.m")[p(1)].cast("bigint"))
    two, off = F.length(p(0)) == 2, p(9)
    digits = F.regexp_replace(off, "[^0-9]", "")
    stated = F.when(F.length(digits) <= 2, digits.cast("bigint") * 60).otherwise(F.substring(F.lpad(digits, 4, "0"), 1, 2).cast("bigint") * 60 + F.substring(digits, -2, 2).cast("bigint"))
    df = df.withColumn("__nl_n", F.struct(
        (number(p(0)) + F.when(two, F.when(p(0) < "69", 2000).otherwise(1900)).otherwise(0)).alias("y"), number(p(2)).alias("d"), number(p(3)).alias("h"), number(p(4)).alias("mi"),
        F.coalesce(number(p(5)), F.lit(0).cast("bigint")).alias("s"), F.when(off != "", F.when(off.startswith("-"), -stated).otherwise(stated)).alias("off"),
        ((F.length(digits) > 2) & (F.substring(digits, -2, 2).cast("bigint") > 59)).alias("odd"),
    ))
    y, d, h, mi, s, off = (F.col(f"__nl_n.{c}") for c in ("y", "d", "h", "mi", "s", "off"))
    mo, half = F.col("__nl_mo"), p(7)
    frac = F.rpad(F.substring(F.coalesce(p(6), F.lit("")), 1, 6), 6, "0").cast("bigint")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = F.when(mo == 2, F.when(leap, 29).otherwise(28)).when(mo.isin(4, 6, 9, 11), 30).otherwise(31)
    right = mo.between(1, 12) & d.between(1, length) & (mi < 60) & (s < 60) & F.when(half != "", h.between(1, 12)).otherwise(h < 24)
    right = right & (off.isNull() | ((F.abs(off) <= _MOST) & ~F.col("__nl_n.odd")))
    hour = F.when(half == "p", h % 12 + 12).when(half == "a", h % 12).otherwise(h)
    # a year after the last one stands for the one of the same length and first day of the week among the last 28
    jan = _days(y, F.lit(1), F.lit(1)).cast("bigint")
    df = df.withColumn("__nl_w", F.struct(right.alias("right"), leap.alias("leap"), jan.alias("jan"), (_days(y, mo, d).cast("bigint") * 86_400 + (hour * 60 + mi) * 60 + s).alias("wall")))
    w = lambda name: F.col(f"__nl_w.{name}")
    same = {(z % 4 == 0, _day_of(z) % 7): z for z in range(LAST_YEAR - 27, LAST_YEAR + 1)}
    like = F.create_map(*[F.lit(x) for (long, day), z in same.items() for x in (day + 7 * long, z)])[F.pmod(w("jan"), F.lit(7)).cast("int") + F.when(w("leap"), 7).otherwise(0)]
    late = y > LAST_YEAR
    year = F.when(late, like).otherwise(F.greatest(y, F.lit(FIRST_YEAR)).cast("int"))
    starts = F.create_map(*[F.lit(x) for z in same.values() for x in (z, _day_of(z))])
    shift = F.when(late, (w("jan") - starts[like]) * 86_400).otherwise(0)
    e = F.col("__nl_x.e")
    whole, part = e[0].cast("decimal(38,0)"), F.rpad(F.substring(F.coalesce(e[1], F.lit("")), 1, 6), 6, "0").cast("decimal(38,0)")
    n = F.length(e[0])
    micros = F.when(n <= 11, whole * 1_000_000 + part).when(n <= 14, whole * 1000 + F.floor(part / 1000)).when(n <= 17, whole).otherwise(F.floor(whole / 1000)).cast("bigint")
    df = df.withColumn("__nl_t", F.struct(
        micros.alias("us"), F.coalesce(w("right"), F.lit(False)).alias("right"), F.when(w("right"), w("wall")).alias("wall"), frac.alias("frac"), F.when(w("right"), year).alias("year"),
        F.when(w("right"), w("wall") - shift).alias("like"), (off * 60).alias("off"), F.coalesce(p(8), F.lit("")).alias("abbr"), p(10).alias("named"),
        F.col("__nl_x.p").isNotNull().alias("local"), F.col("__nl_x.v").alias("v"),
    ))
    titled = F.when(F.col("__nl_t.named") != "", F.col("__nl_t.named"))
    spans = intervals.select(F.col("zone").alias("__nl_zone"), F.lower("zone").alias("__nl_lzone"), F.col("year").alias("__nl_year"), F.col("spans").alias("__nl_spans"))
    df = df.withColumn("__nl_key", F.coalesce(titled, F.lower(F.col(zone))))
    df = df.join(F.broadcast(spans), (F.col("__nl_key") == F.col("__nl_lzone")) & (F.col("__nl_t.year") == F.col("__nl_year")), "left")
    t = lambda name: F.col(f"__nl_t.{name}")
    abbr = F.when(t("abbr").isin("", "t"), None).otherwise(t("abbr"))
    universal = abbr.isin("z", "utc", "gmt", "ut")
    at = F.filter("__nl_spans", lambda i: (i.lo <= t("like")) & (t("like") < i.hi))
    named = F.filter(F.col("__nl_spans"), lambda i: i.abbr == abbr)
    now = F.filter(at, lambda i: i.abbr == abbr)
    offs = F.array_distinct(F.transform(F.when(F.size(now) > 0, now).otherwise(named), lambda i: i.off))
    found = (
        F.when(t("off").isNotNull(), F.array(t("off")))
        .when(universal, F.array(F.lit(0).cast("bigint")))
        .when(abbr.isNotNull(), F.when(F.size(offs) > 0, offs))
        .otherwise(F.transform(at, lambda i: i.off))
    )
    df = df.withColumn("__nl_offs", found)
    count = F.size("__nl_offs")
    status = (
        F.when(t("us").isNotNull(), "ok")
        .when(~t("local"), "unparsed")
        .when(~t("right"), "invalid")
        .when(F.col("__nl_offs").isNull(), "no_zone")
        .when(count == 1, "ok")
        .when(count == 0, "nonexistent")
        .otherwise("ambiguous")
    )
    status = F.when(t("v").isNull(), "unparsed").otherwise(status)
    us = F.coalesce(t("us"), F.when(count == 1, (t("wall") - F.col("__nl_offs")[0]) * 1_000_000 + t("frac")))
    return df.select(*[F.col(f"`{c}`") for c in keep], F.when(status == "ok", us).alias(out), status.alias(f"{out}_status"))
