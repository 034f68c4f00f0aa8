"""Text functions over Columns, and driver-side twins for query strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column, least: int, hyphen: bool = False) -> Column:
    """Lower-cased runs of word characters of at least ``least``; null text: null."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"{r'[\w-]' if hyphen else r'\w'}{{{least},}}"), 0)


def words_of(text: str, least: int, hyphen: bool = False) -> list[str]:
    """Driver-side twin of ``words`` for query strings."""
    return re.findall(rf"{r'[\w-]' if hyphen else r'\w'}{{{least},}}", text.lower(), re.ASCII)


def bound(value: Column, use) -> Column:
    """use(value) with the value worked out once: as a lambda's variable, not a repeated expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows(array: Column, n: int, join) -> Column:
    """``join`` of every n neighbours of an array; empty if it has fewer."""

    def of(a: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(a) - (n - 1))
        return F.when(F.size(a) >= n, F.transform(at, lambda i: join(F.slice(a, i, n)))).otherwise(F.array().cast("array<string>"))

    return bound(array, of)


def neighbours(array: Column) -> Column:
    """Each two neighbours of an array of texts, with a space between; ``array`` should be a variable."""
    n = F.greatest(F.size(array) - 1, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), n), F.slice(array, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def fingerprint(text: Column) -> Column:
    """Sketch of a text: its ten first sorted three-word windows, each sorted and joined.

    Under three words of over two letters the cleaned text itself is the sketch.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\w\s]", " "), r"\s+", " "))
    grams = windows(words(text, 3), 3, lambda w: F.array_join(F.array_sort(w), ""))
    sketch = lambda g: F.when(F.size(g) == 0, clean).otherwise(F.array_join(F.slice(F.array_sort(F.array_distinct(g)), 1, 10), "|"))
    return bound(grams, sketch)


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sketches; two empty texts are alike."""
    x, y = F.array_distinct(F.split(a, r"\|")), F.array_distinct(F.split(b, r"\|"))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def half_up(x: Column, scale: int = 100) -> Column:
    """x rounded to 1/scale, halves up, as floor(x * scale + 0.5)."""
    return F.floor(x * scale + F.lit(0.5)) / F.lit(float(scale))


def truncate(text: Column, most: int) -> Column:
    """Cut at ``most`` characters, at the last space if that is in the last fifth, with dots."""
    cut = F.substring(text, 1, most)
    last = F.when(F.instr(cut, " ") > 0, F.length(cut) - F.instr(F.reverse(cut), " ")).otherwise(-1)
    short = F.when(last > most * 0.8, F.substring(cut, F.lit(1), last)).otherwise(cut)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(short, F.lit("...")))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[\]|])", r"\\$1")


SPACE = r"[\s ﻿]"


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?i)<title>([^<]+)</title>", 1))


def html_content(html: Column, most: int = 50_000) -> Column:
    """Text of a page: scripts, styles and tags dropped, white space collapsed; entities stay."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?i)<script[\s\S]*?</script>", ""), r"(?i)<style[\s\S]*?</style>", "")
    flat = F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]+>", " "), rf"{SPACE}+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def html_description(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?i)<meta[^>]*name=["']description["'][^>]*content=["']([^"']+)["']""", 1)


def markdown_text(text: Column) -> Column:
    """Plain text: fenced and inline code dropped, links replaced by their text, marks dropped."""
    out = text
    for pattern, to in ((r"```[\s\S]*?```", ""), (r"`[^`]+`", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"[#*_~`]", ""), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return F.regexp_replace(out, rf"^{SPACE}+|{SPACE}+$", "")


def markdown_title(text: Column) -> Column:
    head = F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)
    return F.trim(F.when(head != "", head).otherwise(F.substring_index(text, "\n", 1)))


# File extensions and their languages.
LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".rb": "ruby", ".go": "go", ".rs": "rust",
    ".java": "java", ".cpp": "cpp", ".c": "c", ".cs": "c_sharp", ".php": "php", ".swift": "swift", ".kt": "kotlin",
}


def language(filename: Column) -> Column:
    ext = F.regexp_extract(filename, r"([.][^.]*)$", 1)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def anchor_title(html: Column, text: Column) -> Column:
    """Text of the first anchor; without one, the first 100 characters of ``text``."""
    found = F.regexp_extract(html, r"<a[^>]*>([^<]+)</a>", 1)
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(F.substring(text, 1, 100))


# Forms of dates in words and figures, each also with a time of day behind it.
_DAYS = ["MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy", "M/d/yyyy", "yyyy/M/d"]
_TIMES = ["", " H:mm", " H:mm:ss", " H:mm:ss Z", " h:mm a", " h:mm:ss a"]


def lenient_date(text: Column) -> Column:
    """A timestamp from ISO forms or the usual ones in words and figures, a day's name ignored; null if it is none."""
    bare = F.trim(F.regexp_replace(text, r"^\s*(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", ""))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"(?<=\d) ?(?:GMT|UTC|Z)$", " +0000"), r"(?<=\d{4}), (?=\d{1,2}:)", " ")
    bare = F.regexp_replace(F.initcap(F.regexp_replace(bare, r"(?i)\bsept\b", "Sep")), r"(?<=\d) ?([AaPp][Mm])$", " $1")
    forms = F.array(*[F.lit(d + t) for d in _DAYS for t in _TIMES])
    written = bound(bare, lambda b: F.get(F.filter(F.transform(forms, lambda f: F.try_to_timestamp(b, f)), lambda t: t.isNotNull()), F.lit(0)))
    short = F.regexp_replace(text, r"(T\d{2}:\d{2})Z$", "$1:00Z")
    return F.coalesce(short.try_cast("timestamp"), F.when(text.rlike(r"\d.*[A-Za-z]{3}|[A-Za-z]{3}.*\d|\d/") & ~text.rlike(r"(?i)\bago\b"), written))


def relative_date(age: Column, as_of: Column, fine: bool = True) -> Column:
    """A date or ``n units ago`` as a timestamp before ``as_of``; else ``as_of``.

    Months and years are clamped to the end of a shorter month. Not ``fine``: units under a day
    are none.
    """
    units = "second|minute|hour|day|week|month|year" if fine else "day|week|month|year"
    unit = F.lower(F.regexp_extract(age, rf"(?i)(\d+)\s*({units})s?\s*ago", 2))
    n = F.coalesce(F.regexp_extract(age, rf"(?i)(\d+)\s*({units})s?\s*ago", 1).try_cast("int"), F.lit(0))
    back = F.when(unit == "second", as_of - F.make_interval(secs=n.cast("decimal(18,6)")))
    for name in ("minute", "hour", "day", "week", "month", "year"):
        back = back.when(unit == name, as_of - F.make_interval(**{{"minute": "mins", "hour": "hours"}.get(name, name + "s"): n}))
    return F.coalesce(lenient_date(age), back, as_of)
