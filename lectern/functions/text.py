"""Text functions over columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
#: Icons by file type.
ICONS = {"pdf": "📄", "md": "📝", "txt": "📃"}
OTHER_ICON = "📎"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def bigrams(text: Column) -> Column:
    """Overlapping pairs of characters, for scripts without word borders."""
    packed = F.regexp_replace(text, r"(?U)\s+", "")
    return F.when(F.length(packed) < 2, F.array(packed)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(packed) - 1, F.lit(1))), lambda i: F.substr(packed, i, F.lit(2)))
    )


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ellipsis(text: Column, n: int) -> Column:
    """The first n characters, and ``...`` if there were more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def snippet(text: Column, n: int = 200) -> Column:
    """The first n characters and ``...``, always."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def suffix(path: Column) -> Column:
    """Lower-cased file suffix with its dot; empty if none."""
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_size(size: Column) -> Column:
    """Bytes, KB, MB or GB to base 1024 with at most two decimals."""
    shown = F.when(size == 0, F.lit("0 Bytes"))
    for power, unit in enumerate(("Bytes", "KB", "MB", "GB")):
        value = F.floor(size * 100.0 / (1 << 10 * power) + 0.5) / 100
        text = F.regexp_replace(F.format_string("%.2f", value), r"\.?0+$", "")
        text = F.when(F.instr(F.format_string("%.2f", value), ".") > 0, text)
        fits = size < (1 << 10 * (power + 1)) if power < 3 else F.lit(True)
        shown = shown.when(fits, F.concat(text, F.lit(f" {unit}")))
    return shown


def file_icon(file_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ICONS.items() for x in pair])
    return F.coalesce(F.element_at(table, file_type), F.lit(OTHER_ICON))


def merged(base: Column, over: Column) -> Column:
    """Both maps together; where both have a key, the value of ``over``."""
    over = F.coalesce(over, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)


def is_uuid(text: Column) -> Column:
    """True for 32 hexadecimal digits, with or without hyphens, braces and a urn:uuid: prefix; null is none."""
    digits = F.regexp_replace(F.regexp_replace(text, "^urn:uuid:", ""), r"^\{(.*)\}$", "$1")
    return F.coalesce(F.regexp_replace(digits, "-", "").rlike("^[0-9a-fA-F]{32}$"), F.lit(False))


def percent(score: Column) -> Column:
    return F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%"))


def relative_time(ts: Column, now: Column, days: int = 7) -> Column:
    """Just now, minutes, hours or days ago up to ``days``, else the date."""
    seconds = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 1e6)
    count = lambda size: F.floor(seconds / size).cast("string")
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(count(60), F.lit(" minutes ago")))
        .when(seconds < 86400, F.concat(count(3600), F.lit(" hours ago")))
        .when(seconds < 86400 * (days + 1), F.concat(count(86400), F.lit(" days ago")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def recency(ts: Column, now: Column) -> Column:
    """Today, yesterday, the last 7 or 30 days, or older, by whole days; the future counts as the last 7."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(ts)) / 86400e6)
    return F.when(days == 0, "today").when(days == 1, "yesterday").when(days < 7, "last7").when(days < 30, "last30").otherwise("older")
