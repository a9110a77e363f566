"""Time expressions: bucket rounding and tolerant timestamp parsing."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions import fixed

MINUTE_US = 60 * 1_000_000

ISO_DATE = r"^\d{4}-\d{1,2}-\d{1,2}($|[T ]\d)"

# What a free-form date is made of. A stamp is taken apart into a clock with its zone, which may
# stand anywhere, and the rest, which must be one of a few orders of day, month and year.
_NAMES = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "september" else "sept?(?:ember)?" for m in fixed.MONTHS) + ")"
_DAYS = "(?:" + "|".join(f"{d[:3]}(?:{d[3:]})?" for d in fixed.WEEKDAYS) + ")"
_GAP = r"[-/.,\s]*"
WEEKDAY = rf"(?i)\b{_DAYS}\b[.,]?"
PACKED = r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2})?)?(?=[Z+-]|[.,]\d|$)"
CLOCK = (
    r"(?i)(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?![\d:])\s*([ap]m\b)?"
    rf"\s*([+-]\d{{2}}:?\d{{2}}(?!\d)|[+-]\d{{2}}(?![\d:])|(?!{_NAMES}\b)[a-z]{{1,4}}\b)?"
)
DAY = rf"(\d{{1,2}})(?:st|nd|rd|th)?"
ORDERS = (
    r"(?i)^(?:(\d{4})[-/.\s](\d{1,2})[-/.\s](\d{1,2})"  # year month day
    rf"|(\d{{4}}){_GAP}({_NAMES}){_GAP}{DAY}"  # year name day
    rf"|{DAY}{_GAP}({_NAMES})\.?{_GAP}(\d{{4}}|\d{{2}})?"  # day name, maybe year
    rf"|({_NAMES})\.?{_GAP}{DAY}(?:{_GAP}(\d{{4}}))?"  # name day, maybe year
    r"|(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2}))$"  # month day year; a first number above 12 is the day
)
_SEP = "\x1f"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; a lambda also keeps the rule out of the fused stage's method."""
    return F.get(F.transform(F.array(value), use), 0)


def _groups(value: Column, pattern: str, n: int) -> Column:
    """The pattern's groups in ``value``, which it must match as a whole."""
    return F.split(F.regexp_replace(value, pattern, _SEP.join(f"${i}" for i in range(1, n + 1))), _SEP, -1)


def _first(parts: Column, *places: int) -> Column:
    return F.coalesce(*[F.nullif(F.get(parts, i), F.lit("")) for i in places])


def _assembled(rest: Column, clock: Column, as_of: Column) -> Column:
    """Timestamp from the groups of a date and of a clock; ``as_of`` gives the year or the day that is missing."""

    def build(d: Column, c: Column) -> Column:
        dated = F.size(d) == 15
        year, name = _first(d, 0, 3, 8, 11, 14).try_cast("int"), F.lower(F.left(_first(d, 4, 7, 9), F.lit(3)))
        year = F.when(F.length(_first(d, 0, 3, 8, 11, 14)) > 2, year).when(year < 69, year + 2000).otherwise(year + 1900)
        a, b = F.get(d, 12).try_cast("int"), F.get(d, 13).try_cast("int")
        named = F.when(name.isNotNull(), F.call_function("div", F.instr(F.lit("".join(m[:3] for m in fixed.MONTHS)), name) + 2, F.lit(3)).cast("int"))
        month = F.coalesce(F.get(d, 1).try_cast("int"), named, F.when(a > 12, b).otherwise(a))
        day = F.coalesce(_first(d, 2, 5, 6, 10).try_cast("int"), F.when(a > 12, a).otherwise(b))
        today = ~dated & (rest == "") & (clock != "")
        y = F.when(dated, F.coalesce(year, F.year(as_of))).when(today, F.year(as_of))
        m = F.when(dated, month).when(today, F.month(as_of))
        day = F.when(dated, day).when(today, F.day(as_of))
        timed = F.size(c) == 6
        hour, half = F.get(c, 0).try_cast("int"), F.lower(F.get(c, 4))
        hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
        seconds = F.concat(F.coalesce(_first(c, 2), F.lit("0")), F.lit("."), F.left(F.coalesce(_first(c, 3), F.lit("0")), F.lit(6)))
        offset = F.get(c, 5)
        zone = F.when(offset.rlike(r"^[+-]"), F.concat(F.left(offset, F.lit(3)), F.lit(":"), F.coalesce(F.nullif(F.right(F.substr(offset, F.lit(4)), F.lit(2)), F.lit("")), F.lit("00"))))
        at = [F.when(timed, hour).otherwise(0), F.when(timed, F.get(c, 1).try_cast("int")).otherwise(0), F.when(timed, seconds).otherwise("0").try_cast("decimal(16,6)")]
        return F.try_make_timestamp(y, m, day, *at, F.coalesce(zone, F.lit("UTC")))

    return _let(_groups(rest, ORDERS, 15), lambda d: _let(_groups(clock, CLOCK, 6), lambda c: build(d, c)))


def free_form(stamp: Column, as_of: Column | None = None) -> Column:
    """Timestamp of a date in words, numbers or both, with or without a clock and a zone, else null.

    Day and month are told apart by name or by order (month first, unless above 12); two-digit
    years lie between 1969 and 2068; a clock without a date or a date without a year takes them
    from ``as_of``, and is null without it. Zone names mean UTC, offsets count.
    """
    as_of = F.lit(None).cast("timestamp") if as_of is None else as_of
    bare = F.trim(F.regexp_replace(stamp, WEEKDAY, " "))
    spaced = F.regexp_replace(bare, PACKED, "$1-$2-$3 $4:$5:$6")  # an absent clock leaves bare colons
    tidy = F.regexp_replace(F.regexp_replace(spaced, r"(?<=\d):(?!\d)", ""), r" :+$", "")

    def parted(whole: Column) -> Column:
        return _let(F.regexp_extract(whole, CLOCK, 0), lambda clock: _assembled(remainder(whole, clock), clock, as_of))

    def remainder(whole: Column, clock: Column) -> Column:
        at = F.instr(whole, clock)
        without = F.concat(F.left(whole, at - 1), F.lit(" "), F.substr(whole, at + F.length(clock)))
        rest = F.when(clock == "", whole).otherwise(without)
        return F.regexp_replace(rest, r"(?i)^[\s,:]+|(?<=\d)t\s*$|[\s,:]+$", "")

    return _let(tidy, parted)


def parse_timestamp(text: Column, as_of: Column | None = None) -> Column:
    """Timestamp, or null when the text is no date; naive values are UTC. ISO dates skip the grammar."""
    stamp = F.trim(text)
    iso = F.when(stamp.rlike(ISO_DATE), stamp.try_cast("timestamp"))
    return F.coalesce(iso, F.when(stamp.rlike(r"\d"), free_form(stamp, as_of)))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def floor_index(ts: Column, minutes: int) -> Column:
    """Number of whole windows since the epoch (rounded down, also before 1970)."""
    width = F.lit(minutes * MINUTE_US)
    us = micros(ts)
    return F.call_function("div", us - F.pmod(us, width), width)


def round_to_bucket(ts: Column, minutes: int) -> Column:
    """Nearest multiple of the window, halves to the even multiple, in exact integers."""
    width = minutes * MINUTE_US
    us = micros(ts)
    rest = F.pmod(us, F.lit(width))
    low = us - rest
    up = (rest * 2 > width) | ((rest * 2 == width) & (F.pmod(F.call_function("div", low, F.lit(width)), F.lit(2)) == 1))
    return F.timestamp_micros(F.when(up, low + width).otherwise(low))


def floor_to(ts: Column, minutes: int) -> Column:
    us = micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(minutes * MINUTE_US)))
