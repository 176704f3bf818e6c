"""Scalar helpers: blanks, limits, weeks, grades and text renderings."""

from __future__ import annotations

import zoneinfo
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseek.functions import rules


def utc(value: datetime) -> datetime:
    """The moment in UTC without a zone; a value without one is in UTC already."""
    return value.astimezone(timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def instant(value: datetime) -> Column:
    """A literal moment. Spark would read a zone-less value in the driver's local zone."""
    return F.lit(utc(value).replace(tzinfo=timezone.utc))


def is_blank(text: Column) -> Column:
    """Null, empty, or nothing but white space in the Unicode sense."""
    return text.isNull() | text.rlike(r"(?U)^\s*\z")


def too_long(text: Column, limit: int) -> Column:
    """More than ``limit`` UTF-16 units, the contract's measure of length."""
    return F.octet_length(F.encode(text, "UTF-16BE")) > 2 * limit


def default_to(value: Column, default: object) -> Column:
    return F.coalesce(value, default if isinstance(default, Column) else F.lit(default))


def positive_id(text: Column) -> Column:
    """The id as a long, or null unless the text is a whole number of at least 1."""
    number = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast("bigint"))
    return F.when(number >= 1, number)


def utc_date(moment: Column) -> Column:
    """The moment's UTC day, whatever zone the session has."""
    return F.date_from_unix_date(F.floor(F.unix_micros(moment) / 86_400_000_000).cast("int"))


def utc_second(moment: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss`` of the moment in UTC, whatever zone the session has; fractions are cut."""
    second = F.floor(F.unix_micros(moment) / 1_000_000)
    rest = F.pmod(second, F.lit(86_400))
    clock = F.format_string("T%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    return F.concat(utc_date(moment).cast("string"), clock)


def week_start(moment: Column) -> Column:
    """Monday of the moment's UTC week, as a date."""
    return F.trunc(utc_date(moment), "week")


def days_later(moment: Column, days: int) -> Column:
    """So many times 24 hours later (or earlier), whatever clock changes the session's zone has."""
    return F.timestamp_micros(F.unix_micros(moment) + F.lit(days * 86_400_000_000))


def week_end(start: Column) -> Column:
    return F.date_add(start, 6)


def weeks_between(start: datetime | Column, end: datetime | Column) -> Column:
    """Array of every Monday whose week overlaps the window."""
    first = start if isinstance(start, Column) else instant(start)
    last = end if isinstance(end, Column) else instant(end)
    return F.sequence(week_start(first), week_start(last), F.expr("interval 7 days"))


def percentage(part: Column, total: Column) -> Column:
    """Share in percent, two places, halves to even; zero of nothing is zero."""
    safe = F.when(total != 0, total)
    return F.coalesce(F.rint(part / safe * 100 * 100) / 100, F.lit(0.0))


def grade_to_score(grade: Column) -> Column:
    """A whole grade, held to 0..10, as a score in 0..1."""
    return F.least(F.greatest(grade, F.lit(0)), F.lit(10)) / F.lit(10.0)


def pool_size(limit: Column, pool: int) -> Column:
    """How many candidates to fetch for a row's limit."""
    wanted = F.greatest(default_to(limit, rules.DEFAULT_RESULTS).cast("int"), F.lit(pool))
    return F.least(wanted, F.lit(rules.MAX_POOL))


def number_text(x: Column) -> Column:
    """Shortest decimal form: ``0.5``, ``1``, ``0.0005``, ``5E-05``, ``1E+15``.

    Spark writes ``1.0`` and ``5.0E-4``; the contract turns to exponents only
    below 0.0001 and from 1E15 on, with a sign and at least two digits.
    """
    raw = x.cast("string")
    size = F.abs(x)
    plain = F.rtrim(raw.cast("decimal(38,20)").cast("string"), F.lit("0"))
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.substring_index(raw, "E", -1).cast("int")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    scientific = F.concat(mantissa, F.lit("E"), sign, F.format_string("%02d", F.abs(power)))
    exponent_form = F.when((size >= 1e-4) & (size < 1e15), F.regexp_replace(plain, r"\.$", "")).otherwise(scientific)
    return F.when(F.contains(raw, F.lit("E")), exponent_form).otherwise(F.regexp_replace(raw, r"\.0$", ""))


def json_numbers(values: Column) -> Column:
    """Numbers as a compact JSON array: ``[0.91,0.73]``, ``[]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(values, number_text), ","), F.lit("]"))


def bool_text(flag: Column) -> Column:
    return F.initcap(flag.cast("string"))


def known_timezone(name: str | None) -> str | None:
    """The zone if it exists, none if not given; anything else breaks the contract."""
    if not name:
        return None
    if name not in zoneinfo.available_timezones():
        raise rules.RuleViolation("400-invalid-timezone", name)
    return name


def is_known_timezone(name: Column) -> Column:
    """``known_timezone`` as a row check; null and empty mean no zone and pass."""
    zones = sorted(zoneinfo.available_timezones())
    return name.isNull() | (name == "") | name.isin(zones)


def created_at_text(created_at: Column, zone: str | Column | None = None) -> Column:
    """ISO instant to the second: UTC with ``Z``, or the zone's wall clock with its offset.

    The offset is taken per row, so it follows daylight saving. Fractions of a
    second are cut, not rounded. The session's zone plays no part.
    """
    if zone is None:
        return F.concat(utc_second(created_at), F.lit("Z"))
    local = F.from_utc_timestamp(created_at, zone)
    minutes = ((F.unix_seconds(local) - F.unix_seconds(created_at)) / 60).cast("int")
    offset = F.format_string(
        "%s%02d:%02d",
        F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
        F.floor(F.abs(minutes) / 60).cast("int"),
        F.abs(minutes) % 60,
    )
    return F.concat(utc_second(local), offset)


def git_raw_link(raw_url: Column, source_file: Column) -> Column:
    """Link to the raw file; null if either part is."""
    return F.concat(raw_url, F.lit("/"), source_file)


def failure_status(code: Column) -> Column:
    """HTTP status a failure code starts with; 400 if there is none."""
    dash = F.instr(code, "-")
    head = F.when(dash > 1, F.substring_index(code, "-", 1)).otherwise(code)
    return default_to(F.trim(head).try_cast("int"), 400)


def failure_message(code: Column, value: Column) -> Column:
    """The contract's text for a code, with the row's own value filled in."""
    texts = F.create_map(*[F.lit(part) for pair in rules.FAILURES.items() for part in pair])
    return F.replace(texts[code], F.lit("%s"), F.coalesce(value.cast("string"), F.lit("")))


def export_file_stem(start: datetime | Column, end: datetime | Column, project_id: int | Column | None = None) -> str | Column:
    """Name of an export; given columns it names one export per row."""
    if isinstance(start, Column):
        project = project_id if isinstance(project_id, Column) else F.lit(project_id)
        suffix = F.coalesce(F.concat(F.lit("_project-"), project.cast("string")), F.lit(""))
        first, last = (F.replace(utc_date(c).cast("string"), F.lit("-"), F.lit("")) for c in (start, end))
        return F.concat(F.lit("feedback_export_"), first, F.lit("_"), last, suffix, F.lit(".csv"))
    suffix = "" if project_id is None else f"_project-{project_id}"
    return f"feedback_export_{start:%Y%m%d}_{end:%Y%m%d}{suffix}.csv"


def tokens(text: Column) -> Column:
    """Lower-cased words: runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
