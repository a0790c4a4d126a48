"""Dates, ages and the three freshness formulas. Ages are always against an explicit instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import text_or_empty
from quarry.schema import AS_OF, DEFAULT_DATE, HALF_LIFE_DAYS, MAX_AGE_DAYS, VOLATILITY_DAYS, lookup

# Hours from UTC of the zone names that feeds use.
ZONES = {"UTC": "+00:00", "UT": "+00:00", "GMT": "+00:00", "Z": "+00:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00"}
ZONED = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ssXXX", "d MMM yyyy HH:mm:ss XXX", "d MMM yyyy HH:mm XXX"]
PLAIN = ["yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyyMMdd'T'HHmmss'Z'", "yyyyMMddHHmmss", "yyyyMMdd", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM", "yyyy MMM d", "yyyy MMM"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# The freshness windows of each domain with their greatest ages in days; the last has none.
WINDOWS = {
    "technology": [(7, "w1_under_1week"), (30, "w2_1week_1month"), (180, "w3_1to6months"), (None, "w4_over_6months")],
    "healthcare": [(180, "w1_1to6months"), (365, "w2_6to12months"), (1095, "w3_1to3years"), (None, "w4_over_3years")],
    "history": [(1825, "w1_1to5years"), (3650, "w2_5to10years"), (5840, "w3_over10years"), (None, "w4_archival")],
}


def parse_date(c: Column) -> Column:
    """The instant in UTC (timestamp without zone) of ISO, RFC 822, compact and written dates; null if none fits."""
    x = F.trim(F.regexp_replace(text_or_empty(c), r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""))
    zoned = F.regexp_replace(x, r"([+-]\d\d)(\d\d)$", "$1:$2")
    for name, offset in ZONES.items():
        zoned = F.regexp_replace(zoned, rf"(?<=[\d ]){name}$", offset)
    tries = [F.to_utc_timestamp(F.try_to_timestamp(zoned, F.lit(f)), F.current_timezone()) for f in ZONED]
    tries += [F.try_to_timestamp(x, F.lit(f)) for f in PLAIN]
    return F.coalesce(*tries).cast("timestamp_ntz")


def as_of_column(as_of: str | Column = AS_OF) -> Column:
    return as_of if isinstance(as_of, Column) else F.to_timestamp_ntz(F.lit(as_of))


def age_days(c: Column, as_of: str | Column = AS_OF) -> Column:
    """Days, with a fraction, from a date's text to as_of; a date to come has age 0, a bad one null."""
    micros = F.unix_micros(as_of_column(as_of).cast("timestamp")) - F.unix_micros(parse_date(c).cast("timestamp"))
    return F.when(micros.isNotNull(), F.greatest(F.lit(0.0), micros / F.lit(86400e6)))


def canonical_domain(c: Column) -> Column:
    low = F.lower(F.trim(text_or_empty(c)))
    return F.when(low == "historical", "history").otherwise(low)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Null stays null, which greatest() and least() alone would skip."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def freshness_linear_volatility(age: Column, domain: Column) -> Column:
    """Unrounded score by the domain's decay; 0 without an age."""
    return F.coalesce(clamp(1.0 - age / lookup(VOLATILITY_DAYS, domain).cast("double")), F.lit(0.0))


def freshness_label(score: Column) -> Column:
    return F.when(score >= 0.66, "High").when(score >= 0.33, "Medium").otherwise("Low")


def freshness_linear_maxage(age: Column, domain: Column) -> Column:
    return F.coalesce(F.round(clamp(1.0 - F.floor(age) / lookup(MAX_AGE_DAYS, domain, 365).cast("double")), 6), F.lit(0.0))


def freshness_half_life(age: Column) -> Column:
    return F.exp(-F.log(F.lit(2.0)) * age / HALF_LIFE_DAYS)


def freshness_window(age: Column, domain: Column) -> Column:
    """The window of an age, bounds inclusive; the oldest one without an age. Unknown domains follow technology."""

    def of(name: str) -> Column:
        out = None
        for most, window in WINDOWS[name]:
            if most is None:
                return out.otherwise(window)
            out = F.when(age <= most, window) if out is None else out.when(age <= most, window)
        raise AssertionError

    key = canonical_domain(domain)
    return F.when(key == "healthcare", of("healthcare")).when(key == "history", of("history")).otherwise(of("technology"))


def is_valid_window(window: Column, domain: Column) -> Column:
    key, w = canonical_domain(domain), F.trim(text_or_empty(window))
    rule = F.lit(False)
    for name, rows in WINDOWS.items():
        rule = rule | ((key == name) & w.isin([x for _, x in rows]))
    return rule


def published_date(c: Column) -> Column:
    """ISO text with zone; text that does not parse as it is; a default where empty."""
    at = parse_date(c)
    return F.when(at.isNotNull(), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).when(F.trim(text_or_empty(c)) != "", F.trim(c)).otherwise(DEFAULT_DATE)


def month_number(c: Column) -> Column:
    """A month's number or name as two digits; 01 where missing or unknown."""
    x = F.lower(F.trim(text_or_empty(c)))
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(x, 1, 3)).cast("int")
    n = F.coalesce(F.when(x.rlike(r"^\d{1,2}$"), x.cast("int")), named)
    return F.lpad(F.when(n.between(1, 12), n).otherwise(1).cast("string"), 2, "0")


def day_number(c: Column) -> Column:
    x = F.trim(text_or_empty(c))
    n = F.when(x.rlike(r"^\d{1,2}$"), x.cast("int"))
    return F.lpad(F.when(n.between(1, 31), n).otherwise(1).cast("string"), 2, "0")


def medline_date(c: Column) -> Column:
    """yyyy-MM-dd of free text such as '2019 Nov-Dec': the first year, and the first month's name after it."""
    year = F.regexp_extract(text_or_empty(c), r"((?:19|20)\d\d)", 1)
    month = F.regexp_extract(F.lower(text_or_empty(c)), r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)", 1)
    return F.when(year != "", F.concat(year, F.lit("-"), month_number(month), F.lit("-01"))).otherwise("")


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    return F.when(year.isNotNull(), F.concat(year.cast("string"), F.lit("-"), F.lpad(F.coalesce(month, F.lit(1)).cast("string"), 2, "0"), F.lit("-"), F.lpad(F.coalesce(day, F.lit(1)).cast("string"), 2, "0")))


def query_date_range(least: Column, most: Column, as_of: str | Column = AS_OF) -> tuple[Column, Column]:
    """(from, to) as yyyy/MM/dd for an age window; reversed bounds are swapped; null where the greatest age is not positive."""
    low, high, today = F.least(least, most), F.greatest(least, most), as_of_column(as_of).cast("date")
    text = lambda days: F.when(most > 0, F.date_format(F.date_sub(today, days.cast("int")), "yyyy/MM/dd"))
    return text(high), text(low)


def retry_after_seconds(c: Column, now: str | Column = AS_OF) -> Column:
    """Seconds of a number or until an HTTP date, 0 at least."""
    x = F.trim(text_or_empty(c))
    n = F.when(x.rlike(r"^[+-]?\d+(\.\d*)?$"), x.cast("double"))
    until = (F.unix_micros(parse_date(x).cast("timestamp")) - F.unix_micros(as_of_column(now).cast("timestamp"))) / F.lit(1e6)
    return F.coalesce(F.when(n > 0, n), F.when(n.isNull(), F.greatest(F.lit(0.0), until)), F.lit(0.0))
