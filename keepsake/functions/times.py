"""Date and time functions as column expressions. Days are those of a fixed offset (330 minutes) unless another is given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_MINUTES = 330
EPOCH_MS = 1288834974657  # fixed value: the first millisecond of time-ordered ids


def _origin() -> Column:
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", _origin(), ts) / 1_000_000).cast("long")


def local(seconds: Column, minutes: int = OFFSET_MINUTES) -> Column:
    """The clock's reading at an epoch second, as a timestamp without zone, so no session setting changes it."""
    return F.timestamp_add("SECOND", seconds + 60 * minutes, _origin())


def local_day(seconds: Column, minutes: int = OFFSET_MINUTES) -> Column:
    return F.date_format(local(seconds, minutes), "yyyy-MM-dd")


def local_month(seconds: Column, minutes: int = OFFSET_MINUTES) -> Column:
    return F.date_format(local(seconds, minutes), "yyyy-MM")


def day_start(day: Column, end: bool = False, minutes: int = OFFSET_MINUTES) -> Column:
    """Epoch second at which a local day begins (end: the next one)."""
    return (F.datediff(F.to_date(day), F.lit("1970-01-01").cast("date")) + int(end)).cast("long") * 86400 - 60 * minutes


def id_time(msg_id: Column) -> Column:
    """Epoch second in a time-ordered numeric id; null for ids that aren't all digits or are from before such ids."""
    n = F.when(msg_id.rlike("^[0-9]{1,19}$"), msg_id).try_cast("long")
    return F.when(n > 10_000_000_000_000, F.floor((F.shiftright(n, 22) + EPOCH_MS) / 1000).cast("long"))


def wide_id_time(n: Column) -> Column:
    """The same of a number that may be larger than 64 bits hold, as a decimal without fraction."""
    shifted = F.call_function("div", n, F.lit(1 << 22).cast("decimal(10,0)"))
    return F.when(n > 10_000_000_000_000, F.floor((shifted + EPOCH_MS) / 1000).cast("long"))


def sessions_of(at: Column, seconds: int) -> Column:
    """Session windows of times in whole seconds that end where `seconds` or more pass without a row. Spark joins a row that comes at the very end of a window to it, so the gap is a microsecond less."""
    return F.session_window(at, f"{seconds - 1} seconds 999999 microseconds")


def parsed(text: Column, *formats: str) -> Column:
    """The first format that fits, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))


def month_span(first: Column, last: Column, minutes: int = OFFSET_MINUTES) -> Column:
    a, b = local(first, minutes), local(last, minutes)
    f = lambda x: F.date_format(x, "MMM yyyy")
    return F.when(first.isNull() | last.isNull(), "").when(f(a) == f(b), f(a)).when(F.year(a) == F.year(b), F.concat(F.date_format(a, "MMM"), F.lit(" – "), f(b))).otherwise(F.concat(f(a), F.lit(" – "), f(b)))


def ago(day: Column, today: Column) -> Column:
    n = F.datediff(F.to_date(day), F.to_date(today))
    return F.when(n == 0, "today").when(n == 1, "tomorrow").when(n == -1, "yesterday").when(n > 1, F.concat(F.lit("in "), n.cast("string"), F.lit(" days"))).otherwise(F.concat((-n).cast("string"), F.lit(" days ago")))


def fact_freshness(durability: Column, status: Column, last_seen: Column, today: Column) -> tuple[Column, Column]:
    """(status, stale): transient facts unseen for over 45 days are past; states unseen for over 180 days are stale."""
    seen, now = F.to_date(last_seen), F.to_date(today)
    past = (durability == "transient") & (status == "current") & (seen < F.date_sub(now, 45))
    stale = (durability == "state") & (seen < F.date_sub(now, 180))
    return F.when(past, "past").otherwise(status), F.coalesce(stale, F.lit(False))


def is_peak(ts: Column, ranges: tuple[tuple[int, int], ...] = ((1, 4), (6, 10))) -> Column:
    """Weekdays within hour ranges [a, b)."""
    hit = F.lit(False)
    for a, b in ranges:
        hit = hit | ((F.hour(ts) >= a) & (F.hour(ts) < b))
    return F.dayofweek(ts).between(2, 6) & hit


def stated_in_utc(text: Column) -> Column:
    """Epoch second of an ISO time read as if it stood in UTC: an offset after it is dropped, not applied."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"(Z|[+-][0-9]{2}:?[0-9]{2})$", ""), " ", "T")
    return F.timestamp_diff("SECOND", _origin(), bare.try_cast("timestamp_ntz"))


def converted(text: Column) -> Column:
    """Epoch second of an ISO time with its offset applied; without one it stands in UTC."""
    sign = F.regexp_extract(text, r"([+-])[0-9]{2}:?[0-9]{2}$", 1)
    hours, minutes = (F.regexp_extract(text, r"[+-]([0-9]{2}):?([0-9]{2})$", k) for k in (1, 2))
    offset = F.when(sign != "", F.when(sign == "-", -60).otherwise(60) * (hours.try_cast("int") * 60 + minutes.try_cast("int"))).otherwise(0)
    return stated_in_utc(text) - offset


def seconds(ms: Column) -> Column:
    """Whole seconds of epoch milliseconds, rounded down, before 1970 too."""
    return F.floor(ms / 1000).cast("long")


def restamped(line: Column, minutes: int = OFFSET_MINUTES) -> Column:
    """A transcript line "[yyyy-MM-dd HH:mm] who: text" with its time moved from UTC to the local clock; other lines stay."""
    at = F.regexp_extract(line, r"^\[([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2})\]", 1)
    moved = F.timestamp_add("MINUTE", F.lit(minutes), F.replace(at, F.lit(" "), F.lit("T")).try_cast("timestamp_ntz"))
    return F.when(moved.isNotNull(), F.concat(F.lit("["), F.date_format(moved, "yyyy-MM-dd HH:mm"), F.lit("]"), F.substring(line, 19, 1_000_000_000))).otherwise(line)


def day_range(first: Column, last: Column, minutes: int = OFFSET_MINUTES) -> Column:
    """The local days between two epoch seconds: one day, or two with a dash."""
    a, b = local_day(first, minutes), local_day(last, minutes)
    return F.when(a == b, a).otherwise(F.concat(a, F.lit(" – "), b))


def redated(header: Column, first: Column, last: Column, minutes: int = OFFSET_MINUTES) -> Column:
    """A header of parts between dots with the part that is a date or a range of dates made anew."""
    date = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( – [0-9]{4}-[0-9]{2}-[0-9]{2})?$"
    return F.array_join(F.transform(F.split(header, " · "), lambda p: F.when(p.rlike(date), day_range(first, last, minutes)).otherwise(p)), " · ")


def since_days(day: Column, today: Column, days: int = 7) -> Column:
    """Whether a day is at most `days` before today."""
    return F.to_date(day) >= F.date_sub(F.to_date(today), days)
