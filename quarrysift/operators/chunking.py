"""Chunks of texts as rows: greedy folds over lines, paragraphs and sentences as Columns; chunks of code."""

from __future__ import annotations

import ast
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{T.SPACE}+|{T.SPACE}+$", "")


def _append(out: Column, value: Column, use: Column) -> Column:
    return F.when(use, F.concat(out, F.array(value))).otherwise(out)


def sentence_parts(text: Column) -> Column:
    """Runs of other characters with the stops behind them; an unterminated tail only counts if nothing else does.

    The tail is matched too, so that the pattern passes over a text once, and dropped then.
    """
    found = F.filter(F.regexp_extract_all(text, F.lit(r"[^.!?]++(?:[.!?]++|\z)"), 0), lambda s: F.substring(s, -1, 1).isin(".", "!", "?"))
    return T.bound(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(text)))


def sentences(text: Column, most: int, least: int) -> Column:
    """Greedy runs of sentences of at most ``most`` characters, trimmed; a run under ``least`` is dropped, but for the last one."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("cur"), none.alias("out"))

    def step(a: Column, s: Column) -> Column:
        full = F.length(a["cur"]) + F.length(s) > most
        return F.struct(F.when(full, s).otherwise(F.concat(a["cur"], s)).alias("cur"), _append(a["out"], _strip(a["cur"]), full & (F.length(a["cur"]) >= least)).alias("out"))

    return F.aggregate(sentence_parts(text), start, step, lambda a: _append(a["out"], _strip(a["cur"]), F.length(a["cur"]) > 0))


def paragraphs(text: Column, most: int = 2000, least: int = 100, overlap: int = 200) -> Column:
    """Greedy runs of paragraphs, each begun with the end of the one before; those under ``least`` are dropped.

    What is over ``most`` is cut into sentences, the last run of which stays open. A null text gives null.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("cur"), none.alias("out"))

    def step(a: Column, p: Column) -> Column:
        cur = a["cur"]
        fits = F.length(cur) + F.length(p) + 2 <= most
        begun = F.when(F.length(cur) > 0, F.concat(F.right(cur, F.lit(overlap)), F.lit("\n\n"), p)).otherwise(p) if overlap else p
        out = _append(a["out"], cur, F.length(cur) >= least)
        opened = lambda t: F.when(
            F.length(t) > most,
            T.bound(sentences(t, most, least), lambda s: F.struct(F.coalesce(F.get(s, F.size(s) - 1), F.lit("")).alias("cur"), F.concat(out, F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).alias("out"))),
        ).otherwise(F.struct(t.alias("cur"), out.alias("out")))
        joined = F.concat(cur, F.when(F.length(cur) > 0, F.lit("\n\n")).otherwise(F.lit("")), p)
        return F.when(fits, F.struct(joined.alias("cur"), a["out"].alias("out"))).otherwise(T.bound(begun, opened))

    return F.aggregate(F.split(text, r"\n\n+", -1), start, step, lambda a: _append(a["out"], a["cur"], F.length(a["cur"]) >= least))


def line_blocks(text: Column, most: int = 4000, least: int = 100, overlap: int = 0, first: int = 1) -> Column:
    """Greedy runs of lines as structs of first line, last line and content, counted from ``first``.

    A line counts its length and one; a line over ``most`` stays whole. A new run begins with the
    last lines of the one before, one for each 80 characters of ``overlap`` begun. Runs under
    ``least`` characters are dropped. The fold keeps places only; texts are cut out at the end.
    """
    keep = math.ceil(overlap / 80)

    def fold(rows: Column) -> Column:
        start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("first"), F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

        def step(s: Column, line: Column) -> Column:
            full = (s["size"] + F.length(line) + 1 > most) & (s["at"] > s["first"])
            begun = F.greatest(s["first"], s["at"] - keep)
            again = F.length(F.array_join(F.slice(rows, begun + 1, s["at"] - begun), "\n")) if keep else F.lit(0)
            return F.struct(
                (F.when(full, again).otherwise(s["size"]) + F.length(line) + 1).alias("size"), F.when(full, begun).otherwise(s["first"]).alias("first"),
                (s["at"] + 1).alias("at"), _append(s["out"], F.struct(s["first"].alias("a"), s["at"].alias("b")), full).alias("out"),
            )

        return F.aggregate(rows, start, step, lambda s: F.concat(s["out"], F.array(F.struct(s["first"].alias("a"), s["at"].alias("b")))))

    def cut(rows: Column) -> Column:
        content = lambda b: F.array_join(F.slice(rows, b["a"] + 1, b["b"] - b["a"]), "\n")
        return F.transform(fold(rows), lambda b: F.struct((b["a"] + first).alias("first_line"), (b["b"] + first - 1).alias("last_line"), content(b).alias("content")))

    return F.filter(T.bound(F.split(text, "\n", -1), cut), lambda c: F.length(c["content"]) >= least)


def chunked(df: DataFrame, chunks: Column, key: str) -> DataFrame:
    """(key, chunk, content) or (key, chunk, first_line, last_line, content): a row for each of ``chunks``; null texts have none."""
    rows = df.select(key, F.posexplode(chunks).alias("chunk", "c"))
    return rows.select(key, "chunk", "c.*") if isinstance(rows.schema["c"].dataType, StructType) else rows.select(key, "chunk", F.col("c").alias("content"))


def block_lines(text: str, first: int = 1, most: int = 4000) -> list[tuple[int, int, str]]:
    """As ``lines`` without a least length or overlap, counted from line ``first``."""
    return [(a + first - 1, b + first - 1, c) for a, b, c in lines(text, most, 0)]


def lines(text: str, most: int = 4000, least: int = 100, overlap: int = 0) -> list[tuple[int, int, str]]:
    """(first line, last line, content) from 1; a line over ``most`` stays whole."""
    rows = text.split("\n")
    keep = math.ceil(overlap / 80)
    out, cur, size, start = [], [], 0, 1
    for i, line in enumerate(rows, 1):
        if cur and size + len(line) + 1 > most:
            body = "\n".join(cur)
            if len(body) >= least:
                out.append((start, i - 1, body))
            cur = cur[-keep:] if keep else []
            start, size = i - len(cur), sum(len(x) + 1 for x in cur)
        cur.append(line)
        size += len(line) + 1
    body = "\n".join(cur)
    return [*out, (start, len(rows), body)] if cur and len(body) >= least else out


def _split(node: ast.AST, rows: list[str], most: int) -> list[tuple[int, int, str, str, str | None]]:
    """The functions directly inside an over-long definition, cut off if over-long too; else its lines."""
    inner = [n for n in node.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    out = []
    for n in inner:
        body = "\n".join(rows[n.lineno - 1 : n.end_lineno])
        out.append((n.lineno, n.end_lineno, body if len(body) <= most else body[:most] + "\n// ... truncated", "function", n.name))
    if inner:
        return out
    return [(a, b, c, "block", node.name) for a, b, c in block_lines("\n".join(rows[node.lineno - 1 : node.end_lineno]), node.lineno, most)]


def code(text: str, language: str | None, most: int = 4000, least: int = 100) -> list[tuple[int, int, str, str, str | None]]:
    """(first line, last line, content, type, name): functions and classes of Python, else lines.

    Nested definitions also come out by themselves. Other languages have no parser here.
    """
    rows = text.split("\n")
    if len(text) <= most:
        return [(1, len(rows), text, "full", None)]
    found = []
    if language == "python":
        try:
            for node in ast.walk(ast.parse(text)):
                if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    body = "\n".join(rows[node.lineno - 1 : node.end_lineno])
                    kind = "class" if isinstance(node, ast.ClassDef) else "function"
                    if len(body) <= most:
                        found.append((node.lineno, node.end_lineno, body, kind, node.name))
                    else:
                        found += _split(node, rows, most)
        except SyntaxError:
            found = []
    return sorted(set(found), key=lambda f: (f[0], f[1], f[3], f[2])) or [(a, b, c, "block", None) for a, b, c in lines(text, most, least)]
