"""Time functions as Column expressions. Whatever depends on the present takes it as a parameter."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names by number, English in full and shortened, Ukrainian and Russian in the genitive.
MONTHS = {
    1: ("january", "jan", "січня", "января"), 2: ("february", "feb", "лютого", "февраля"), 3: ("march", "mar", "березня", "марта"), 4: ("april", "apr", "квітня", "апреля"),
    5: ("may", "травня", "мая"), 6: ("june", "jun", "червня", "июня"), 7: ("july", "jul", "липня", "июля"), 8: ("august", "aug", "серпня", "августа"),
    9: ("september", "sep", "sept", "вересня", "сентября"), 10: ("october", "oct", "жовтня", "октября"), 11: ("november", "nov", "листопада", "ноября"), 12: ("december", "dec", "грудня", "декабря"),
}
YESTERDAY = ("yesterday", "вчора", "вчера")
#: Seconds of the units of a relative time.
SECONDS = {"m": 60, "h": 3600, "d": 86_400, "w": 604_800}


def instant(text: Column) -> Column:
    """An ISO time, without a zone in UTC; null if it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))


def configured(text: Column, end: bool = False) -> Column:
    """Like `instant`; a date alone is its first second, or its last for the end of a range."""
    is_date = F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$")
    return instant(F.when(is_date, F.concat(F.trim(text), F.lit("T23:59:59" if end else "T00:00:00"))).otherwise(text))


def in_range(text: Column, start: str | None, end: str | None, allow_missing: bool = False) -> Column:
    """Whether a time lies between start and end, both included. What can't be read counts as `allow_missing`."""
    at, inside = instant(text), F.lit(True)
    if start:
        inside = inside & (at >= configured(F.lit(start)))
    if end:
        inside = inside & (at <= configured(F.lit(end), end=True))
    return F.coalesce(F.when(at.isNotNull(), inside), F.lit(allow_missing))


def iso(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def epoch_iso(seconds: Column, now: Column) -> Column:
    """Seconds since 1970 as ISO; null before 2010 or over a week after now."""
    at = F.timestamp_seconds(seconds)
    return F.when((at >= F.to_timestamp(F.lit("2010-01-01T00:00:00+00:00"))) & (at <= now + F.make_dt_interval(F.lit(7))), iso(at))


def _month(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for number, names in MONTHS.items() for n in names for x in (n, number))), F.lower(name))


def _at(year: Column, month: Column, day: Column, clock: Column) -> Column:
    hour = F.coalesce(F.nullif(F.regexp_extract(clock, r"(\d{1,2}):", 1), F.lit("")).cast("int"), F.lit(0))
    minute = F.coalesce(F.nullif(F.regexp_extract(clock, r":(\d{2})", 1), F.lit("")).cast("int"), F.lit(0))
    pm, am = F.lower(clock).contains("pm"), F.lower(clock).contains("am")
    hour = F.when(pm & (hour < 12), hour + 12).when(am & (hour == 12), F.lit(0)).otherwise(hour)
    return F.try_make_timestamp(year, month, day, hour, minute, F.lit(0))


def posted(text: Column, now: Column) -> Column:
    """When a post was made by its label: `5m`, `3 h`, `yesterday at 10:30`, `March 15`, `15 березня 2026 р. о 10:00`; null if it can't be read."""
    from forumetry.functions.text import let

    label = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return let(F.struct(label.alias("label"), F.regexp_extract(label, r"(?i)(\d{1,2}:\d{2}(?:\s*[ap]m)?)", 1).alias("clock")), lambda x: _posted(x["label"], x["clock"], now))


def _posted(label: Column, clock: Column, now: Column) -> Column:
    # units alone: `28 whose` is no age, though it begins like one
    relative = rf"(?i)^(\d+)\s*(?={either(UNIT_NAMES)}(?: ago)?$)([mhdw])"
    count, unit = F.regexp_extract(label, relative, 1), F.lower(F.regexp_extract(label, relative, 2))
    each = F.element_at(F.create_map(*(F.lit(x) for kv in SECONDS.items() for x in kv)), unit)
    since = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (count.try_cast("long") * each).cast("decimal(18,6)"))
    day_before = F.date_sub(now.cast("date"), 1)
    yesterday = _at(F.year(day_before), F.month(day_before), F.dayofmonth(day_before), clock)
    month_first, day_first = r"(?iu)^(\p{L}+)\.? (\d{1,2})(?:,? (\d{4}))?", r"(?iu)(?:^|\s)(\d{1,2}) (\p{L}+)\.?(?:,? (\d{4}))?"
    year = lambda p: F.coalesce(F.nullif(F.regexp_extract(label, p, 3), F.lit("")).cast("int"), F.year(now))
    english = _at(year(month_first), _month(F.regexp_extract(label, month_first, 1)), F.regexp_extract(label, month_first, 2).try_cast("int"), clock)
    local = _at(year(day_first), _month(F.regexp_extract(label, day_first, 2)), F.regexp_extract(label, day_first, 1).try_cast("int"), clock)
    starts = F.lit(False)
    for word in YESTERDAY:
        starts = starts | F.lower(label).startswith(word)
    full = F.when(label.rlike(r"^\d{4}-\d{2}-\d{2}"), instant(label))
    dated = F.when(label.rlike(r"\d"), F.coalesce(english, local, full))  # a label without a digit is no date
    return F.when(count != "", since).when(starts, yesterday).otherwise(dated)


#: Names of units inside longer texts; the word before a clock, and whether the clock has halves of a day, by the word for the day
#: before; what may stand behind a year.
UNIT_NAMES = ("m", "ms", "min", "mins", "h", "hs", "hr", "hrs", "d", "ds", "day", "days", "w", "ws", "week", "weeks")
DAY_BEFORE = {"yesterday": ("at", True), "вчора": ("о", False), "вчера": ("в", False)}
YEAR_WORDS = ("року", "года", "р.", "р")


def either(words: Iterable[str]) -> str:
    """An expression for any of the words, longer ones first."""
    return "(?:" + "|".join(map(re.escape, sorted(words, key=lambda w: (-len(w), w)))) + ")"


def maybe(*parts: str) -> str:
    return "(?:" + "".join(parts) + ")?"


def date_patterns() -> list[str]:
    """Expressions for what is a date or an age inside a longer text, in the order in which they are looked for: an age, the day before, a month's name
    with a day behind it, a day with a name behind it."""
    blank, day, year = r"\s+", r"\d{1,2}", r"\d{4}"
    clock = lambda at, halves: [blank, at, blank, day, r":\d{2}", r"\s*[ap]m" if halves else ""]
    age = r"\d+\s*" + either(UNIT_NAMES)
    before = [word + maybe(*clock(*how)) for word, how in DAY_BEFORE.items()]
    short = either({name[:3] for names in MONTHS.values() for name in names if name.isascii()})
    month_first = short + "[a-z]*" + blank + day + maybe(r",\s*", year) + maybe(*clock("at", True))
    day_first = day + blank + r"[a-z\p{InCyrillic}]+" + maybe(blank, year) + maybe(r"\s*", either(YEAR_WORDS))
    return [rf"\b{p}\b" for p in (age, *before, month_first, day_first)]


_EDGE = " .,;:|()[]"
#: What every one of them has.
_MAY = r"(?iu)\d|yesterday|вчора|вчера"


def date_hint(text: Column) -> Column:
    """The first date or age inside a text; empty without any."""
    from forumetry.functions.text import clean_mobile_text, let

    def first(bare: Column) -> Column:
        found = F.coalesce(*(F.nullif(F.regexp_extract(bare, rf"(?iU){p}", 0), F.lit("")) for p in date_patterns()), F.lit(""))
        return F.when(bare.rlike(_MAY), F.btrim(found, F.lit(_EDGE))).otherwise("")

    return let(F.btrim(clean_mobile_text(text), F.lit(_EDGE)), first)


def posted_in(text: Column, now: Column) -> Column:
    """When a post was made, by a label or by the first date inside a longer text."""
    from forumetry.functions.text import let

    inside = lambda t: let(date_hint(t), lambda h: F.when(h != "", posted(h, now)))
    return let(text, lambda t: F.when(t.rlike(_MAY), F.coalesce(posted(t, now), inside(t))))


#: Names in a page's scripts, in the order in which they are tried. What has a medium's id, the field of a time near it, how many
#: characters lie between them at most, and whether the time is behind the id.
MEDIUM_TIMES = (
    ("id", "creation_time", 2500, True), ("id", "creation_time", 2500, False), ("id", "publish_time", 2500, True), ("id", "publish_time", 2500, False),
    ("story_fbid", "publish_time", 1200, True),
)
#: Times of any post: what stands before, the field, and the name of the field behind it.
ANY_TIMES = (('"post_id":"[^"]+",', "creation_time", "unpublished_content_type"), ("", "publish_time", "story_name"), ("", "creation_time", None), ("", "publish_time", None))


def _seconds(field: str) -> str:
    return rf'"{field}":(\d{{9,}})'


def _near(medium: Column, held: str, field: str, reach: int, behind: bool) -> Column:
    """An expression for the time near a medium's id, which is in a list where it is a story's."""
    opening, closing = (r'\["', r'"\]') if held == "story_fbid" else ('"', '"')
    own = F.concat(F.lit(f'"{held}":{opening}'), medium, F.lit(closing))
    gap, time = F.lit(f".{{0,{reach}}}?"), F.lit(_seconds(field))
    return F.concat(own, gap, time) if behind else F.concat(time, gap, own)


def published_in_page(html: Column, links: list[Column], now: Column) -> Column:
    """The time in a page's scripts: first beside the ids of the media that the links name, then any; the first that is a possible time."""
    from forumetry.functions.text import let
    from forumetry.functions.urls import numeric_media_id

    def at(pattern: Column) -> Column:
        return let(F.call_function("regexp_extract", html, F.concat(F.lit("(?s)"), pattern), F.lit(1)).try_cast("long"), lambda s: epoch_iso(s, now))

    def beside(medium: Column) -> Column:
        return F.when(medium.isNotNull(), F.coalesce(*(at(_near(medium, *how)) for how in MEDIUM_TIMES)))

    anywhere = [F.lit(before + _seconds(field) + (f',"{then}"' if then else "")) for before, field, then in ANY_TIMES]
    return F.coalesce(*(let(numeric_media_id(link), beside) for link in links), *map(at, anywhere))
