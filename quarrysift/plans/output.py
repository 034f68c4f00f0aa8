"""Reports: rows at any size as DataFrames; whole Markdown and JSON texts from a bounded list."""

from __future__ import annotations

import json
import re
import sys
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from ..operators import refine
from ..session import materialize

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _optional(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(n) for n in names if n in df.columns]


def json_lines(results: DataFrame) -> DataFrame:
    """One JSON text for each result, by ord; null fields are left out."""
    row = F.struct("url", "title", "snippet", "source", T.half_up(F.col("score")).alias("score"), F.coalesce(U.host(F.col("url")), F.lit("unknown")).alias("domain"), F.date_format("ts", _ISO).alias("timestamp"), *_optional(results, "categories", "metadata"))
    return results.select("ord", F.to_json(row).alias("value"))


def json_compact(results: DataFrame) -> DataFrame:
    """(ord, u, t, s): URL, title and percent."""
    return results.select("ord", F.col("url").alias("u"), F.col("title").alias("t"), F.floor(F.col("score") * 100 + F.lit(0.5)).cast("long").alias("s"))


def summary(results: DataFrame) -> DataFrame:
    """One row: results and different domains (invalid URLs have none)."""
    return results.agg(F.count("*").alias("results"), F.count_distinct(U.host(F.col("url"))).alias("domains"))


def backlinks(results: DataFrame) -> DataFrame:
    """(link): the different hosts without their last label, a host of one label whole."""
    h = U.host(F.col("url"))
    return results.filter(h.isNotNull()).select(F.regexp_replace(h, "[.][^.]*$", "").alias("link")).distinct().orderBy("link")


def result_line(results: DataFrame) -> Column:
    """A Markdown block for a result, with its categories if ``results`` has that column."""
    percent = F.floor(F.col("score") * 100 + F.lit(0.5)).cast("string")
    head = F.concat(F.lit("### ["), T.escape_markdown(F.col("title")), F.lit("]("), F.col("url"), F.lit(")"))
    foot = F.concat(F.lit("*Score: "), percent, F.lit("% | Source: "), F.col("source"), F.lit(" | Date: "), F.date_format("ts", "yyyy-MM-dd"), F.lit("*"))
    if "categories" in results.columns:
        foot = F.concat(foot, F.lit("\n*Categories: "), F.array_join(F.transform("categories", lambda c: F.concat(F.lit("`"), c, F.lit("`"))), " "), F.lit("*"))
    return F.concat_ws("\n\n", head, T.truncate(F.col("snippet"), 300), foot)


def result_lines(results: DataFrame) -> DataFrame:
    """(ord, line): a Markdown block for each result."""
    return results.select("ord", result_line(results).alias("line"))


def _section(results: DataFrame, by: str | None) -> Column:
    if by == "domain":
        return F.coalesce(U.host(F.col("url")), F.lit("Unknown"))
    return F.coalesce(F.get("categories", F.lit(0)), F.lit("General")) if by and "categories" in results.columns else F.lit("General" if by else "")


def body(results: DataFrame, by: str | None = "domain") -> DataFrame:
    """(section, place, ord, line) of a report's body.

    By domain: the largest first, then by first appearance. By category: of the first category,
    by name. None: one section. Places count from 1 within a section. One scan of ``results``: a
    section's size and first row come from the same partitioning as the places.
    """
    lines = results.select("ord", result_line(results).alias("line"), _section(results, by).alias("section"))
    own = Window.partitionBy("section")
    placed = lines.withColumn("place", F.row_number().over(own.orderBy("ord")))
    if by != "domain":
        return placed.orderBy("section", "ord").select("section", "place", "ord", "line")
    placed = placed.withColumns({"n": F.count("*").over(own), "earliest": F.min("ord").over(own)})
    return placed.orderBy(F.desc("n"), "earliest", "ord").select("section", "place", "ord", "line")


def _quoted(names) -> str:
    return ", ".join(f'"{x}"' for x in names)


def front_matter(query: str, date: str, tags: list[str], sources: list[str], total: int, generator: str = "quarrysift") -> str:
    title = query.replace('"', '\\"')
    return f'---\ntitle: "{title}"\ndate: {date}\ntags: [{_quoted(tags)}]\nsources: [{_quoted(sources)}]\ntotal_results: {total}\ngenerated_by: {generator}\n---\n'


def markdown_text(results: DataFrame, query: str, date: str, most: int = 1000, by: str | None = "domain", tags: tuple[str, ...] = (), sources: tuple[str, ...] = (), front: bool = True) -> DataFrame:
    """One row ``text``: a report of the first ``most`` results by score: front matter, summary, body, backlinks."""
    best = materialize(results.orderBy(F.desc("score"), "ord").limit(most), "report")
    ordered = lambda c, sep, by: F.expr(f"listagg({c}, '{sep}') within group (order by {by})")
    rule = "\\n\\n---\\n\\n"
    lines = best.select("ord", result_line(best).alias("line"), _section(best, by).alias("section"))
    sections = lines.groupBy("section").agg(F.count("*").alias("n"), F.min("ord").alias("first"), ordered("line", "\\n\\n" if by else rule, "ord").alias("t"))
    if by:
        sections = sections.withColumn("t", F.concat(F.lit("## "), "section", F.lit("\n\n"), "t"))
    text = sections.agg(F.coalesce(ordered("t", rule, "n desc, first" if by == "domain" else "section"), F.lit("")).alias("body"))
    links = backlinks(best).agg(F.coalesce(ordered("concat('- [[', link, ']]')", "\\n", "link"), F.lit("")).alias("links"))
    title, number = re.sub(r"([\[\]|])", r"\\\1", query), F.col("results").cast("string")
    head = [F.lit("---\ntitle: \"" + query.replace('"', '\\"') + f'"\ndate: {date}\ntags: [{_quoted(tags)}]\nsources: [{_quoted(sources)}]\ntotal_results: '), number, F.lit("\ngenerated_by: quarrysift\n---\n\n")] if front else []
    parts = [
        *head, F.lit(f"# {title}\n\n> **Summary**\n> - **Query**: {query}\n> - **Results**: "), number, F.lit(f" unique results from {len(sources)} provider(s)\n> - **Sources**: "),
        F.col("domains").cast("string"), F.lit(f" unique domains\n> - **Generated**: {date}\n\n"), F.col("body"), F.lit("\n\n---\n\n## Related\n\n"), F.col("links"), F.lit("\n"),
    ]
    return summary(best).crossJoin(text).crossJoin(links).select(F.concat(*parts).alias("text"))


def markdown(results: DataFrame, query: str, date: str, most: int = 1000, by: str | None = "domain", tags: tuple[str, ...] = (), sources: tuple[str, ...] = (), front: bool = True) -> str:
    """The text of ``markdown_text``."""
    return markdown_text(results, query, date, most, by, tags, sources, front).first().text


def json_text(results: DataFrame, query: str, timestamp: str, sources: tuple[str, ...] = (), errors: list[dict] = (), most: int = 1000) -> DataFrame:
    """One row ``value``: a JSON text of the first ``most`` results by score, with what it is about; errors only if any."""
    best = materialize(results.orderBy(F.desc("score"), "ord").limit(most), "report")
    rows = json_lines(best).join(best.select("ord", "score"), "ord").agg(F.coalesce(F.expr("listagg(value, ',') within group (order by score desc, ord)"), F.lit("")).alias("rows"))
    meta = F.struct(F.lit(query).alias("query"), F.lit(timestamp).alias("timestamp"), F.array(*map(F.lit, sources)).cast("array<string>").alias("providers"), F.col("results").alias("totalResults"), F.col("domains").alias("uniqueDomains"), F.lit("1.0.0").alias("version"))
    more = F.lit(f'"errors":{json.dumps(list(errors))},' if errors else "")
    return summary(best).crossJoin(rows).select(F.concat(F.lit('{"meta":'), F.to_json(meta), F.lit(","), more, F.lit('"results":['), "rows", F.lit("]}")).alias("value"))


def json_report(results: DataFrame, query: str, timestamp: str, sources: tuple[str, ...] = (), errors: list[dict] = (), most: int = 1000, pretty: bool = True) -> str:
    """The text of ``json_text``, indented if ``pretty``."""
    value = json_text(results, query, timestamp, sources, errors, most).first().value
    return json.dumps(json.loads(value), indent=2, ensure_ascii=False) if pretty else value


def context(results: DataFrame, query: str, date: str, most: int = 1000) -> dict:
    """What a template may use: the results, and their numbers by domain and by each category."""
    best = results.orderBy(F.desc("score"), "ord").limit(most)
    rows = [r.asDict(recursive=True) | {"domain": r["domain"]} for r in best.withColumn("domain", F.coalesce(U.host(F.col("url")), F.lit("unknown"))).orderBy(F.desc("score"), "ord").collect()]
    groups: dict[str, dict[str, list]] = {"domain": {}, "category": {}}
    for r in rows:
        groups["domain"].setdefault(r["domain"], []).append(r)
        for c in r.get("categories") or []:
            groups["category"].setdefault(c, []).append(r)
    return {"query": query, "date": date, "total": len(rows), "results": rows, "groupedByDomain": groups["domain"], "groupedByCategory": groups["category"]}


def render(template: str, values: dict[str, str], results: list[dict[str, str]]) -> str:
    """``{{name}}`` and ``{{#each results}}`` blocks; the first ``{{/each}}`` ends a block."""

    def fill(text: str, names: dict[str, str]) -> str:
        return re.sub(r"\{\{(\w+)\}\}", lambda m: str(names.get(m[1], m[0])), text)

    out = re.sub(r"\{\{#each results\}\}(.*?)\{\{/each\}\}", lambda m: "".join(fill(m[1], {k: v for k, v in r.items()}) for r in results), template, flags=re.S)
    return fill(out, values)


def template_fields(results: DataFrame) -> dict[str, Column]:
    """What a template may say of a result; the score in percent, categories as a list with commas."""
    fields = {c: F.col(c) for c in ("url", "title", "snippet", "source")}
    fields |= {"timestamp": F.date_format("ts", _ISO), "score": F.floor(F.col("score") * 100 + F.lit(0.5)).cast("string"), "domain": F.coalesce(U.host(F.col("url")), F.lit("unknown"))}
    return fields | ({"categories": F.array_join("categories", ", ")} if "categories" in results.columns else {"categories": F.lit("")})


def _filled(template: str, names: dict[str, Column]) -> Column:
    """A template's text with ``{{name}}`` replaced; names that are not known stay as they stand."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    known = [F.coalesce(names[p], F.lit("")) if p in names else F.lit("{{" + p + "}}") for p in parts[1::2]]
    texts = [F.lit(p) for p in parts[::2]]
    return F.concat(*[c for pair in zip(texts, [*known, F.lit("")], strict=True) for c in pair])


def rendered(results: DataFrame, template: str, values: dict[str, str], by: str | None = None, block: int | None = None) -> DataFrame:
    """(section, block, n, text): a template made into one text for each section, in Spark.

    ``{{#each results}}`` blocks come once for each result, by ord; ``values`` may stand anywhere,
    ``section`` and ``totalResults`` (of the section) outside the blocks. by: domain, category (a result is in each of its
    categories) or None, one section. With ``block``, a text holds results of so many consecutive
    numbers ``ord`` only, so that it has a bound however large its section.
    """
    given = {k: F.lit(v) for k, v in values.items()}
    names = template_fields(results) | given
    pieces = re.split(r"\{\{#each results\}\}(.*?)\{\{/each\}\}", template, flags=re.S)
    if by == "category" and "categories" in results.columns:
        # outer, and rows without any dropped after: a filter on the list before would be worked out from the texts again
        results = results.select("*", F.posexplode_outer("categories").alias("qs_at", "qs_section")).filter("qs_at is not null")
        section = F.col("qs_section")
    else:
        section = {"domain": template_fields(results)["domain"], "category": F.lit("General"), None: F.lit("")}[by]
    number = F.floor(F.col("ord") / block).cast("long") if block else F.lit(0).cast("long")
    lines = results.select("ord", number.alias("block"), section.alias("section"), *[_filled(p, names).alias(f"line{i}") for i, p in enumerate(pieces[1::2])])
    joined = [F.expr(f"listagg(line{i}, '') within group (order by ord)").alias(f"each{i}") for i in range(len(pieces) // 2)]
    texts = lines.groupBy("section", "block").agg(F.count("*").alias("n"), *joined)
    outer = given | {"section": F.col("section"), "totalResults": F.col("n").cast("string")}
    whole = [c for i, p in enumerate(pieces[::2]) for c in (_filled(p, outer), *([F.col(f"each{i}")] if i < len(joined) else []))]
    return texts.select("section", "block", "n", F.concat(*whole).alias("text"))


def suggestion_line(place: Column, term: Column, score: Column, source: Column) -> Column:
    """``NN. term bar (source)``; the bar has a full block for each tenth, ten places at least."""
    return F.concat(F.format_string("%2d. ", place), F.rpad(term, F.greatest(F.lit(25), F.length(term)), F.lit(" ")), F.lit(" "), score_bar(score), F.lit(" ("), source, F.lit(")"))


def score_bar(score: Column) -> Column:
    n = F.floor(score * 10 + F.lit(0.5)).cast("int")
    return F.rpad(F.repeat(F.lit("█"), n), F.greatest(F.lit(10), n), F.lit("░"))


def refine_report(suggestions: DataFrame, query: str) -> DataFrame:
    """One row ``value``: the suggestions as JSON, and refined queries of the three best by each strategy.

    ``suggestions`` is a ranked list, already limited, with ``place`` from 1.
    """
    item = F.struct("place", "term", T.half_up(F.col("score")).alias("score"), "source", "frequency")
    one = suggestions.agg(F.sort_array(F.collect_list(item)).alias("x"))
    terms = F.transform(F.slice("x", 1, 3), lambda r: r["term"])
    lists = F.struct(*[refine.refined_queries(query, terms, s).alias(s) for s in ("expand", "narrow", "pivot")])
    shown = F.transform("x", lambda r: F.struct(r["term"].alias("term"), r["score"].alias("score"), r["source"].alias("source"), r["frequency"].alias("frequency")))
    return one.select(F.to_json(F.struct(F.lit(query).alias("query"), shown.alias("suggestions"), lists.alias("refinedQueries"))).alias("value"))


def cards(results: DataFrame) -> DataFrame:
    """(ord, title, url, snippet, percent, domain, source): scores against the best, 0.01 at least."""
    most = results.agg(F.greatest(F.coalesce(F.max("score"), F.lit(0.0)), F.lit(0.01)).alias("qs_most"))
    cut = F.concat(F.substring("snippet", 1, 200), F.when(F.length("snippet") > 200, "...").otherwise(""))
    title = F.when(F.coalesce("title", F.lit("")) == "", "Untitled").otherwise(F.col("title"))
    percent = F.floor(F.col("score") / F.col("qs_most") * 100 + F.lit(0.5)).cast("long")
    return results.crossJoin(F.broadcast(most)).select("ord", title.alias("title"), "url", cut.alias("snippet"), percent.alias("percent"), F.coalesce(U.host(F.col("url")), F.lit("unknown")).alias("domain"), "source")


def write(text: str, path: str | None, folder: str = ".") -> str | None:
    """Write a report to a path (``~`` is home; relative ones lie under ``folder``), or to standard output."""
    if path is None:
        sys.stdout.write(text if text.endswith("\n") else text + "\n")
        return None
    at = Path(path).expanduser()
    at = at if at.is_absolute() else Path(folder).expanduser() / at
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text)
    return str(at)
