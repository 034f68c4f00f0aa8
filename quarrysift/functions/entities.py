"""Character references of HTML as a Column: all names of the standard table, decimal and hex numbers."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Numbers from 0x80 to 0x9F mean the characters of this code page, as browsers read them.
_PAGE = "cp1252"
#: Different references of a text up to which each is decoded once and then looked up.
DIFFERENT = 1000


@cache
def _tables() -> tuple[str, str, str, str]:
    """Names ended by a semicolon, those that need none, a pattern of the latter (longest first), the code page's numbers."""
    closed = {n[:-1]: c for n, c in html5.items() if n.endswith(";")}
    free = {n: c for n, c in html5.items() if not n.endswith(";")}
    page = {}
    for n in range(0x80, 0xA0):
        try:
            page[n] = ord(bytes([n]).decode(_PAGE))
        except UnicodeDecodeError:
            page[n] = n
    return json.dumps(closed), json.dumps(free), "|".join(sorted(free, key=lambda n: (-len(n), n))), json.dumps(page)


def character(code: Column) -> Column:
    """The character of a code point; what is none (0, surrogates, too large) becomes U+FFFD."""
    page = F.from_json(F.lit(_tables()[3]), "map<string,bigint>")

    def of(n: Column) -> Column:
        good = F.when((n <= 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF) | n.isNull(), F.lit(0xFFFD)).otherwise(n)
        return F.when(n.between(1, 0xFF), F.char(n)).otherwise(F.decode(F.unhex(F.lpad(F.hex(good), 8, "0")), "UTF-32"))

    return T.bound(F.when(code.between(0x80, 0x9F), F.try_element_at(page, code.cast("string"))).otherwise(code), of)


def _decoded(part: Column) -> Column:
    """What stood behind an ampersand, with its reference decoded.

    What is used more than once is bound: a lambda's expressions are worked out at each use.
    """
    closed, free, pattern, _ = _tables()
    rest = lambda n: F.substring(part, n + 1, F.length(part))

    def number(bare: Column, base: int) -> Column:
        # over eight digits it is too large for a code point
        return F.when(F.length(bare) > 8, F.lit(0x7FFFFFFF)).otherwise(F.conv(F.when(bare == "", "0").otherwise(bare), base, 10).cast("bigint"))

    def numbered(whole: Column) -> Column:
        bare = F.regexp_extract(whole, "^#[xX]?0*([0-9a-fA-F]*)", 1)
        code = T.bound(bare, lambda b: F.when(F.lower(F.substring(whole, 2, 1)) == "x", number(b, 16)).otherwise(number(b, 10)))
        return F.when(whole != "", F.concat(T.bound(code, character), rest(F.length(whole))))

    def named(name: Column) -> Column:
        found = F.try_element_at(F.from_json(F.lit(closed), "map<string,string>"), F.nullif(name, F.lit("")))
        return F.concat(found, rest(F.length(name) + 1))

    def legacy(name: Column) -> Column:
        return F.concat(F.try_element_at(F.from_json(F.lit(free), "map<string,string>"), F.nullif(name, F.lit(""))), rest(F.length(name)))

    plain = F.concat(F.lit("&"), part)
    numeric = T.bound(F.regexp_extract(part, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0), numbered)
    by_name = F.coalesce(T.bound(F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1), named), T.bound(F.regexp_extract(part, f"^(?:{pattern})", 0), legacy))
    return F.when(F.startswith(part, F.lit("#")), F.coalesce(numeric, plain)).otherwise(F.coalesce(by_name, plain))


def unescape(text: Column) -> Column:
    """``text`` with each reference decoded once, as a browser shows it.

    A name without its semicolon counts where the standard allows it, by its longest form; other
    ampersands stay. Null stays null.
    """

    pattern = _tables()[2]

    def decoded(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), T.bound(F.slice(parts, F.lit(2), F.size(parts)), behind))

    def behind(tails: Column) -> Column:
        found = F.transform(tails, lambda p: F.regexp_extract(p, f"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|{pattern})", 0))
        return T.bound(found, lambda refs: T.bound(F.array_distinct(refs), lambda few: joined(tails, refs, few)))

    def joined(tails: Column, refs: Column, few: Column) -> Column:
        each = lambda plain: F.zip_with(tails, refs, lambda p, r: F.concat(F.get(plain, (F.array_position(few, r) - 1).cast("int")), F.substring(p, F.length(r) + 1, F.length(p))))
        return F.array_join(F.when(F.size(few) <= DIFFERENT, T.bound(F.transform(few, _decoded), each)).otherwise(F.transform(tails, _decoded)), "")

    return F.when(F.contains(text, F.lit("&")), T.bound(F.split(text, "&", -1), decoded)).otherwise(text)
