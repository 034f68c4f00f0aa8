"""Registered queries over whole tables, each with the same statement in SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions.entities import unescape
from ..operators import cached as H
from ..operators import chunking as K
from ..operators import ranking as R
from ..operators import refine as Q
from ..operators import results as S
from ..operators import rounds as A
from ..operators import rules as L
from ..operators import vectors as V
from ..session import materialize, scratch, table
from ..sources import feeds as W
from ..sources import normalise as N
from ..sources import providers
from ..sources import topics as P
from ..streaming import feed
from . import corpora as C
from . import output as O

QUERY = "the and thing"
TRUST = ["example.org", *R.TRUSTED]
RULES = [("Blogs", ["blog."], [], []), ("English", [], [], ["/en/"]), ("Thing", [], ["thing"], []), *S.CATEGORIES]
_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def _sql_authority(trusted: list[str], suffix: bool = True) -> str:
    h = C.sql_host()
    quote = lambda xs: ", ".join(f"'{x}'" for x in xs)
    fits = lambda xs: f"len(list_filter([{quote(xs)}], lambda d: {h} = d or ends_with({h}, '.' || d))) > 0" if suffix else f"len(list_filter([{quote(xs)}], lambda d: contains({h}, d))) > 0"
    mid = f"when {fits(R.QUALITY)} then 0.8" if suffix else ""
    return f"cast(case when {h} is null then 0.3 when {fits(trusted)} then 1.0 when ends_with({h}, '.gov') or ends_with({h}, '.edu') then 0.9 {mid} else 0.5 end as double)"


_RECENCY = "greatest(0.1::double, 1 - (epoch_us(timestamp '2024-03-01 00:00:00') - epoch_us(ts)) / 86400000000.0::double / 365)"


def _sql_relevance(q: str) -> str:
    terms = T.words_of(q, 3)
    hits = lambda c: " + ".join(f"list_contains({C.sql_words(c, 3)}, '{t}')::int" for t in terms)
    base = f"(({hits('title')}) / {len(terms)}.0::double * 0.6::double + ({hits('snippet')}) / {len(terms)}.0::double * 0.4::double)"
    return f"case when contains(lower(title), '{q.lower()}') then least(1.0::double, {base} + 0.2::double) else {base} end"


_SCORE = f"({_RECENCY} * 0.3::double + {_sql_authority(TRUST)} * 0.2::double + {_sql_relevance(QUERY)} * 0.5::double)"


def _sql_categories(rules) -> str:
    quote = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::varchar[]"
    one = lambda n, d, k, u: f"case when len(list_filter({quote(d)}, lambda x: contains({C.sql_full_host()}, x))) > 0 or len(list_filter({quote(k)}, lambda x: contains(lower(title || ' ' || snippet), x))) > 0 or len(list_filter({quote(u)}, lambda x: contains(lower(url), x))) > 0 then '{n}' end"
    found = f"list_filter([{', '.join(one(*r) for r in rules)}], lambda x: x is not null)"
    return f"case when len({found}) = 0 then ['General'] else {found} end"


def _deduped(df):
    return S.deduplicate(df)


@query(f"""with {C.SQL_TWICE}, keyed as (select *, {C.sql_normalized()} || ':' || {C.sql_fingerprint("title || ' ' || snippet")} as key from two),
  one as (select * from (select *, row_number() over (partition by key order by ord) as rn from keyed) where rn = 1)
  select ord, url, title, round({_SCORE}, 6) as score, array_to_string({_sql_categories(RULES)}, ',') as categories from one order by {_SCORE} desc, ord limit 50""")
def search_pipeline(spark, d):
    one = R.scored(_deduped(C.pages_twice(spark, d)), QUERY, C.as_of(), TRUST)
    best = R.top(one, ["score"], 50)
    return best.select("ord", "url", "title", F.round("score", 6).alias("score"), F.array_join(S.categories(F.col("url"), F.col("title"), F.col("snippet"), RULES), ",").alias("categories"))


@query(f"select page_id, {C.sql_normalized()} as key from pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", U.normalized(F.col("url")).alias("key"))


@query(f"select page_id, {C.sql_host()} as host, {C.sql_full_host()} as full_host from pages")
def host_extract(spark, d):
    return table(spark, d, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.full_host(F.col("url")).alias("full_host"))


@query(f"select doc_id, {C.sql_fingerprint('text')} as sketch from documents")
def fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("sketch"))


_SOURCES = """s as (select key, string_agg(source, ',' order by first) as names from (select key, source, min(ord) as first from keyed group by all) group by key)"""


@query(f"""with {C.SQL_TWICE}, keyed as materialized (select *, {C.sql_normalized()} || ':' || {C.sql_fingerprint("title || ' ' || snippet")} as key from two), {_SOURCES}
  select min(ord) as ord, arg_min(url, ord) as url, arg_max(page, ord) as page, arg_max(copy, ord) as copy, case when count(*) > 1 then any_value(names) end as sources, count(*) as copies from keyed join s using (key) group by key""")
def dedup_url_fp(spark, d):
    return _deduped(C.pages_twice(spark, d)).select("ord", "url", F.col("metadata")["page_id"].alias("page"), F.col("metadata")["copy"].alias("copy"), F.array_join("sources", ",").alias("sources"), "copies")


@query(f"""with {C.SQL_DOCS}, keyed as materialized (select *, {C.sql_fingerprint("title || ' ' || snippet")} as key from res), {_SOURCES}
  select min(ord) as ord, arg_max(lang, ord) as lang, case when count(*) > 1 then any_value(names) end as sources, count(*) as copies from keyed join s using (key) group by key""")
def dedup_fp_merge_sources(spark, d):
    return S.deduplicate(C.documents(spark, d), S.dedup_key(url=False)).select("ord", F.col("metadata")["lang"].alias("lang"), F.array_join("sources", ",").alias("sources"), "copies")


@query(f"""with {C.SQL_PAGES}, s as (select ord, url, round({_SCORE}, 6) as score from res union all select ord + 1000000, url, round({_SCORE} * 0.9::double, 6) from res)
  select ord, url, score from (select *, row_number() over (partition by url order by score desc, ord) as rn from s) where rn = 1 order by score desc, ord limit 100""")
def dedup_web_url(spark, d):
    s = R.scored(C.pages(spark, d), QUERY, C.as_of(), TRUST).select("ord", "url", "score")
    again = s.select((F.col("ord") + 1_000_000).alias("ord"), "url", (F.col("score") * 0.9).alias("score"))
    return S.web_top(s.unionByName(again).withColumn("score", F.round("score", 6)), 100)


_SKETCHES = f"k as materialized (select doc_id, {C.sql_fingerprint('text')} as sketch from documents), m as (select sketch, min(doc_id) as doc_id from k group by sketch), s as (select doc_id, list_distinct(string_split(sketch, '|')) as p from m)"


@query(f"""with {_SKETCHES}, e as (select doc_id, len(p) as n, unnest(p) as t from s), c as (select a.doc_id as i, b.doc_id as j, a.n as na, b.n as nb, count(*) as c from e a join e b on a.t = b.t and a.doc_id < b.doc_id group by all)
  select i, j, round(c / (na + nb - c)::double, 6) as similarity from c where c / (na + nb - c)::double >= 0.5 union all select m.doc_id, k.doc_id, 1.0::double from k join m using (sketch) where k.doc_id <> m.doc_id""")
def similar_pairs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("sketch"))
    return S.similar_pairs(docs, 0.5, "doc_id").withColumn("similarity", F.round("similarity", 6))


@query(f"with {C.SQL_PAGES} select source, count(*) as n, min(ord) as first from res group by source")
def union_providers(spark, d):
    p = C.pages(spark, d)
    parts = [p.filter(F.col("source") == s) for s in C.SOURCES]
    return S.union_all(parts).groupBy("source").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


@query(f"with {C.SQL_PAGES} select source, ord, url from (select *, row_number() over (partition by source order by ord) as rn from res) where rn <= 20")
def provider_limit(spark, d):
    return S.limit_each(C.pages(spark, d), "source", 20).select("source", "ord", "url")


@query(f"select page_id, url from pages where contains({C.sql_host()}, 'example.org') or contains({C.sql_host()}, 'then')")
def filter_domain_include(spark, d):
    return table(spark, d, "pages").filter(S.in_domains(F.col("url"), ["example.org", "then"])).select("page_id", "url")


@query(f"select page_id, url from pages where not coalesce(contains({C.sql_host()}, 'example.org') or contains({C.sql_host()}, 'then'), false)")
def filter_domain_exclude(spark, d):
    return table(spark, d, "pages").filter(~F.coalesce(S.in_domains(F.col("url"), ["example.org", "then"]), F.lit(False))).select("page_id", "url")


@query("select event_id, ts from events where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-08 00:00:00'")
def filter_date_range(spark, d):
    return table(spark, d, "events").filter("ts between timestamp'2024-01-05 00:00:00' and timestamp'2024-01-08 00:00:00'").select("event_id", "ts")


@query(f"with {C.SQL_DOCS} select ord from res where contains(lower(title || ' ' || snippet), 'thing') or contains(lower(title || ' ' || snippet), 'erst')")
def filter_keyword_or(spark, d):
    return C.documents(spark, d).filter(S.has_any_word(F.concat_ws(" ", "title", "snippet"), "thing ERST")).select("ord")


@query(f"with {C.SQL_PAGES} select ord, round({_RECENCY}, 6) as recency, {_sql_authority(TRUST)} as authority, {_sql_authority(TRUST, False)} as authority_hybrid, round({_sql_relevance(QUERY)}, 6) as relevance from res")
def score_parts(spark, d):
    u = F.col("url")
    return C.pages(spark, d).select("ord", F.round(R.recency(F.col("ts"), C.as_of()), 6).alias("recency"), R.authority(u, TRUST).alias("authority"), R.authority(u, TRUST, False).alias("authority_hybrid"), F.round(R.relevance(F.col("title"), F.col("snippet"), QUERY), 6).alias("relevance"))


@query(f"with {C.SQL_DOCS} select ord, round({_SCORE}, 6) as score from res order by round({_SCORE}, 9) desc, ord limit 100")
def score_total_topk(spark, d):
    s = R.scored(C.documents(spark, d), QUERY, C.as_of(), TRUST).withColumn("score", F.round("score", 9))
    return R.top(s, ["score"], 100).select("ord", F.round("score", 6).alias("score"))


_BODY = "coalesce(title, '') || ' ' || coalesce(title, '') || ' ' || coalesce(snippet, '')"
_TOKENS = f"toks as (select ord, {C.sql_words(_BODY, 2)} as w from res), post as (select ord, term, count(*) as tf from (select ord, unnest(w) as term from toks) group by all), st as (select count(*) as n, coalesce(sum(len(w)), 0) / greatest(count(*), 1)::double as avgdl from toks)"


@query(f"with {C.SQL_DOCS}, {_TOKENS} select n, round(avgdl, 6) as avgdl, (select count(distinct term) from post) as vocabulary from st")
def bm25_stats(spark, d):
    docs = C.documents(spark, d)
    v = R.postings(docs).agg(F.count_distinct("term").alias("vocabulary"))
    return R.corpus_stats(docs).crossJoin(v).select("n", F.round("avgdl", 6).alias("avgdl"), "vocabulary")


@query(f"with {C.SQL_DOCS}, {_TOKENS} select term, count(*) as df, round(ln(1 + (n - count(*) + 0.5::double) / (count(*) + 0.5::double)), 6) as idf from post, st group by term, n")
def bm25_idf(spark, d):
    docs = C.documents(spark, d)
    return R.inverse_frequency(R.postings(docs), R.corpus_stats(docs)).select("term", "df", F.round("idf", 6).alias("idf"))


def _sql_bm25(delta: float) -> str:
    terms = ", ".join(f"('{t}')" for t in T.words_of("thing thou erst erst", 2))
    return f"""q as (select t, count(*) as k from (values {terms}) v(t) group by t), df as (select term, count(*) as df from post group by term),
    part as (select post.ord, sum(k * (ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.5::double) / (tf + 1.5::double * (0.25::double + 0.75::double * len(w) / avgdl)) + {delta}::double)) as s
      from post join q on t = post.term join df on df.term = post.term join toks on toks.ord = post.ord, st group by post.ord),
    ranked as (select res.*, coalesce(s, 0) as bm25_score from res left join part using (ord))"""


@query(f"with {C.SQL_DOCS}, {_TOKENS}, {_sql_bm25(0)} select ord, round(bm25_score, 6) as bm25_score from ranked order by round(bm25_score, 9) desc, ord limit 100")
def bm25_topk(spark, d):
    s = R.bm25(C.documents(spark, d), "thing thou erst erst").withColumn("bm25_score", F.round("bm25_score", 9))
    return R.top(s, ["bm25_score"], 100).select("ord", F.round("bm25_score", 6).alias("bm25_score"))


@query(f"with {C.SQL_DOCS}, {_TOKENS}, {_sql_bm25(0.5)} select ord, round(bm25_score, 6) as bm25_score from ranked")
def bm25_delta(spark, d):
    return R.bm25(C.documents(spark, d), "thing thou erst erst", delta=0.5).select("ord", F.round("bm25_score", 6).alias("bm25_score"))


_HYBRID = f"least(1.0::double, bm25_score / greatest((select max(bm25_score) from ranked), 1) * 0.6::double + {_RECENCY} * 0.2::double + {_sql_authority(TRUST, False)} * 0.2::double)"


@query(f"with {C.SQL_DOCS}, {_TOKENS}, {_sql_bm25(0)} select ord, round({_HYBRID}, 6) as score from ranked order by round({_HYBRID}, 9) desc, round(bm25_score, 9) desc, ord limit 100")
def bm25_hybrid_topk(spark, d):
    s = R.bm25_hybrid(C.documents(spark, d), "thing thou erst erst", C.as_of(), TRUST).withColumns({"score": F.round("score", 9), "bm25_score": F.round("bm25_score", 9)})
    return R.top(s, ["score", "bm25_score"], 100).select("ord", F.round("score", 6).alias("score"))


@query(f"with {C.SQL_DOCS} select ord, round((contains(lower(title || ' ' || snippet), 'thing')::int + contains(lower(title || ' ' || snippet), 'erst')::int) / 2.0::double, 6) as score from res")
def tfidf_lite(spark, d):
    return C.documents(spark, d).select("ord", F.round(R.web_tfidf(F.col("title"), F.col("snippet"), "thing of erst"), 6).alias("score"))


@query(f"with {C.SQL_PAGES} select ord, array_to_string({_sql_categories(RULES)}, ',') as categories from res")
def categorize(spark, d):
    return C.pages(spark, d).select("ord", F.array_join(S.categories(F.col("url"), F.col("title"), F.col("snippet"), RULES), ",").alias("categories"))


@query(f"with {C.SQL_PAGES} select category, count(*) as n from (select unnest({_sql_categories(RULES)}) as category from res) group by category")
def category_counts(spark, d):
    p = C.pages(spark, d).select(F.explode(S.categories(F.col("url"), F.col("title"), F.col("snippet"), RULES)).alias("category"))
    return p.groupBy("category").agg(F.count("*").alias("n"))


@query(f"with {C.SQL_PAGES} select ({_sql_categories(RULES)})[1] as category, count(*) as n, min(ord) as first from res group by 1")
def primary_category_groups(spark, d):
    p = C.pages(spark, d).select("ord", F.get(S.categories(F.col("url"), F.col("title"), F.col("snippet"), RULES), F.lit(0)).alias("category"))
    return p.groupBy("category").agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy("category")


@query(f"select coalesce({C.sql_host()}, 'Unknown') as domain, count(*) as n, min(page_id) as first from pages group by 1")
def domain_groups(spark, d):
    return table(spark, d, "pages").groupBy(F.coalesce(U.host(F.col("url")), F.lit("Unknown")).alias("domain")).agg(F.count("*").alias("n"), F.min("page_id").alias("first")).orderBy(F.desc("n"), "first")


@query(f"select count(distinct {C.sql_host()}) as domains from pages")
def distinct_domains(spark, d):
    return table(spark, d, "pages").agg(F.count_distinct(U.host(F.col("url"))).alias("domains"))


@query(f"select distinct case when contains({C.sql_host()}, '.') then regexp_replace({C.sql_host()}, '[.][^.]*$', '') else {C.sql_host()} end as link from pages where {C.sql_host()} is not null")
def backlinks(spark, d):
    return O.backlinks(table(spark, d, "pages"))


@query(f"""with {C.SQL_DOCS}, w as (select regexp_extract_all(lower(title || ' ' || snippet), '\\w{{3,}}') as w, ord from res), t as (select ord, unnest(w) as term, unnest(range(len(w))) as place from w)
  select term, count(*) as count from t where not list_contains({Q.SHORT_STOP + ['thing']}, term) group by term order by count(*) desc, min((ord, place)) limit 8""")
def web_suggestions(spark, d):
    return Q.frequent_words(C.documents(spark, d), "thing", 8)


def _sql_terms() -> str:
    word = lambda c: rf"regexp_extract_all(lower(coalesce({c}, '')), '[\w-]{{3,}}')"
    bigram = lambda c: f"list_transform([{word(c)}], lambda w: list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))[1]"
    part = lambda a, kind, s, w, r: f"select ord, unnest({a}) as term, unnest(range(len({a}))) as place, {kind} as kind, '{s}' as source, {w}::double as weight, {r} as r from res"
    label = f"string_split(split_part({C.sql_host()}, '.', 1), '-')"
    return f"""occ as ({part(word('title'), 0, 'title', 2, 0)} union all {part(bigram('title'), 1, 'title', 2, 0)} union all {part(word('snippet'), 0, 'snippet', 1, 1)} union all {part(bigram('snippet'), 1, 'snippet', 1, 1)}
    union all select * from ({part(label, 0, 'domain', 0.5, 2)}) where length(term) >= 3),
    grouped as (select kind, term, sum(weight) as frequency, min((ord, r, place)) as pos, max((source = 'title')::int) as t, max((source = 'snippet')::int) as s, max((source = 'domain')::int) as d
      from occ where kind = 1 or (not list_contains({Q.STOP + ['thing']}, term) and not regexp_matches(term, '^[0-9]+$')) group by kind, term having kind = 0 or sum(weight) >= 2),
    based as (select *, least(1.0::double, least(frequency / greatest((select count(*) from res), 1), 1.0::double) + (case when kind = 1 then 0 else t + s + d - 1 end) * 0.1::double + (case when kind = 1 then 1 else t end) * 0.2::double + (1 - abs(length(term) - 8) / 20.0::double) * 0.1::double) as base from grouped),
    best as (select term, round(case when kind = 1 then base * 1.2::double else base end, 9) as score, case when kind = 1 or (t = 1 and s = 1) then 'combined' when t = 1 then 'title' when s = 1 then 'snippet' else 'domain' end as source, frequency, kind, pos from based)"""


@query(f"with {C.SQL_DOCS}, {_sql_terms()} select term, round(score, 6) as score, source, frequency from best order by score desc, kind, pos limit 20")
def refine_topn(spark, d):
    return Q.suggestions(C.documents(spark, d), "thing", 20).withColumn("score", F.round("score", 6))


_PICKED = "p as (select item_id, w[1] as q, list_slice(w, 2, 4) as t from (select item_id, regexp_extract_all(lower(text), '\\w{3,}') as w from benchmark))"


@query(f"""with {_PICKED}, o as (select item_id, 'expand' as strategy, list_append(list_transform(t, lambda x: q || ' ' || x), q || ' ' || t[1] || ' ' || t[2]) as a from p where len(t) >= 2
  union all select item_id, 'narrow', list_transform(t, lambda x: '"' || q || '" "' || x || '"') from p where len(t) >= 2 union all select item_id, 'pivot', list_append(t, array_to_string(t, ' ')) from p where len(t) >= 2)
  select distinct item_id, strategy, unnest(a) as query from o""")
def refine_queries(spark, d):
    """Each item's first word as the query, the next three as terms."""
    w = T.words(F.col("text"), 3)
    p = table(spark, d, "benchmark").select("item_id", F.get(w, F.lit(0)).alias("q"), F.slice(w, 2, 3).alias("t")).filter(F.size("t") >= 2)
    return S.union_all([p.select("item_id", F.lit(s).alias("strategy"), F.explode(Q.refined_queries(F.col("q"), F.col("t"), s)).alias("query")) for s in ("expand", "narrow", "pivot")])


_COS = "list_cosine_similarity(e.embedding::double[], (select embedding::double[] from embeddings where vec_id = 0))"


@query(f"select vec_id, round({_COS}, 6) as similarity from embeddings e order by round({_COS}, 9) desc, vec_id limit 50")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    near = R.nearest(e, e.filter("vec_id = 0"), 50, digits=9)
    return near.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""with {C.SQL_DOCS}, {_TOKENS}, {_sql_bm25(0)}, m as (select vec_id as ord, {_COS} as similarity, coalesce(bm25_score, 0) as k from embeddings e left join ranked on ord = vec_id),
  x as (select ord, round(k / greatest((select max(k) from m), 1) * 0.5::double + similarity * 0.5::double, 9) as score from m) select ord, round(score, 6) as score from x order by x.score desc, ord limit 50""")
def semantic_hybrid(spark, d):
    e = table(spark, d, "embeddings")
    near = R.similarities(e, e.filter("vec_id = 0")).select(F.col("vec_id").alias("ord"), "similarity")
    s = R.semantic_hybrid(near, R.bm25(C.documents(spark, d), "thing thou erst erst")).withColumn("score", F.round("score", 9))
    return R.top(s, ["score"], 50).select("ord", F.round("score", 6).alias("score"))


@query(f"with {C.SQL_PAGES} select page_id, title, content, regexp_extract(html, '(?i)<meta[^>]*name=[\"'']description[\"''][^>]*content=[\"'']([^\"'']+)[\"'']', 1) as description from raw")
def html_extract(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", T.html_title(h).alias("title"), T.html_content(h, 10**9).alias("content"), T.html_description(h).alias("description"))


_MD = "'# ' || substr(text, 1, 30) || chr(10) || '`x` [a](u) **b**' || chr(10) || chr(10) || chr(10) || chr(10) || '```' || chr(10) || 'code' || chr(10) || '```' || text"


@query(rf"""with m as (select doc_id, {_MD} as t from documents) select doc_id, trim(regexp_extract(t, '(?m)^#\s+(.+)$', 1)) as title,
  md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '```[\s\S]*?```', '', 'g'), '`[^`]+`', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[#*_~`]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{00A0}}\x{{FEFF}}]+|[\s\x{{00A0}}\x{{FEFF}}]+$', '', 'g')) as plain from m""")
def md_plain_text(spark, d):
    m = table(spark, d, "documents").select("doc_id", F.expr(_MD.replace("chr(10)", "char(10)")).alias("t"))
    return m.select("doc_id", T.markdown_title(F.col("t")).alias("title"), F.md5(T.markdown_text(F.col("t"))).alias("plain"))


_ENDS = [".js", ".py", ".tar.rs", ".xyz", "", ".TS", ".kt"]


@query(f"select page_id, 'page' || page_id || ({_ENDS})[page_id % 7 + 1] as file, (map {{'.js': 'javascript', '.py': 'python', '.rs': 'rust', '.kt': 'kotlin'}})[regexp_extract(({_ENDS})[page_id % 7 + 1], '([.][^.]*)$', 1)] as language from pages")
def detect_language(spark, d):
    end = F.get(F.array(*map(F.lit, _ENDS)), (F.col("page_id") % 7).cast("int"))
    files = table(spark, d, "pages").select("page_id", F.concat(F.lit("page"), F.col("page_id").cast("string"), end).alias("file"))
    return files.select("page_id", "file", T.language(F.col("file")).alias("language"))


@query("""with c as (select doc_id, text, substr(text, 1, 300) as t from documents), l as (select *, case when contains(t, ' ') then length(t) - instr(reverse(t), ' ') else -1 end as k from c)
  select doc_id, case when length(text) <= 300 then text else case when k > 240 then substr(t, 1, k) else t end || '...' end as snippet from l""")
def truncate_snippet(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncate(F.col("text"), 300).alias("snippet"))


@query(r"select doc_id, regexp_replace(text || '[x|y]', '([\[\]|])', '\\\1', 'g') as escaped from documents")
def md_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escape_markdown(F.concat(F.col("text"), F.lit("[x|y]"))).alias("escaped"))


@query(f"with {C.SQL_PAGES} select ord, floor({_SCORE} * 100 + 0.5::double) / 100 as score, coalesce({C.sql_host()}, 'unknown') as domain, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') as timestamp, title, snippet from res")
def json_rows(spark, d):
    s = R.scored(C.pages(spark, d), QUERY, C.as_of(), TRUST)
    return s.select("ord", T.half_up(F.col("score")).alias("score"), F.coalesce(U.host(F.col("url")), F.lit("unknown")).alias("domain"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), "title", "snippet")


@query(f"with {C.SQL_PAGES} select ord, url as u, title as t, cast(floor({_SCORE} * 100 + 0.5::double) as bigint) as s from res")
def json_compact(spark, d):
    return O.json_compact(R.scored(C.pages(spark, d), QUERY, C.as_of(), TRUST))


@query(f"with {C.SQL_PAGES}, s as (select ord, round({_SCORE}, 6) as s from res) select ord, rpad(repeat('█', cast(floor(s * 10 + 0.5::double) as int)), greatest(10, cast(floor(s * 10 + 0.5::double) as int)), '░') as bar from s")
def suggestion_bar(spark, d):
    s = R.scored(C.pages(spark, d), QUERY, C.as_of(), TRUST).withColumn("score", F.round("score", 6))
    return s.select("ord", O.score_bar(F.col("score")).alias("bar"))


_UNITS = ["second", "minute", "hour", "day", "week", "month", "year"]
_AGES = """case event_id % 11 when 0 then 'some time' when 1 then strftime(ts, '%b %-d, %Y') when 2 then strftime(ts, '%-d %B %Y %H:%M') when 3 then strftime(ts, '%Y-%m-%d %H:%M:%S')
  else (event_id % 40) || ' ' || (['second', 'minute', 'hour', 'day', 'week', 'month', 'year'])[event_id % 11 - 3] || case when event_id % 2 = 0 then 's' else '' end || ' ago' end"""


def _sql_back(units: list[str]) -> str:
    back = {"second": "to_seconds", "minute": "to_minutes", "hour": "to_hours", "day": "to_days", "week": "to_weeks", "month": "to_months", "year": "to_years"}
    return " ".join(f"when {i + 4} then timestamp '2024-03-01 00:00:00' - {back[u]}(cast(event_id % 40 as int))" for i, u in enumerate(_UNITS) if u in units)


@query(f"""select event_id, {_AGES} as age, case event_id % 11 when 1 then date_trunc('day', ts) when 2 then date_trunc('minute', ts) when 3 then date_trunc('second', ts) {_sql_back(_UNITS)} else timestamp '2024-03-01 00:00:00' end as ts,
  case event_id % 11 when 1 then date_trunc('day', ts) when 2 then date_trunc('minute', ts) when 3 then date_trunc('second', ts) {_sql_back(_UNITS[3:])} else timestamp '2024-03-01 00:00:00' end as whole_days from events""")
def relative_dates(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 11
    unit = F.get(F.array(*map(F.lit, _UNITS)), (k - 4).cast("int"))
    ago = F.concat((F.col("event_id") % 40).cast("string"), F.lit(" "), unit, F.when(F.col("event_id") % 2 == 0, "s").otherwise(""), F.lit(" ago"))
    age = F.when(k == 0, "some time").when(k == 1, F.date_format("ts", "MMM d, yyyy")).when(k == 2, F.date_format("ts", "d MMMM yyyy HH:mm")).when(k == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(ago)
    ages = e.select("event_id", age.alias("age"))
    return ages.select("event_id", "age", T.relative_date(F.col("age"), C.as_of()).alias("ts"), T.relative_date(F.col("age"), C.as_of(), fine=False).alias("whole_days"))


@query(f"with {C.SQL_PAGES} select page_id, '<' || content || '> & é ½ …' as text from raw")
def entities(spark, d):
    """Every character of the pages' texts as a name or number, decoded again."""
    code = lambda c, i: F.when(i % 2 == 0, F.concat(F.lit("#"), F.ascii(c).cast("string"))).otherwise(F.concat(F.lit("#x"), F.hex(F.ascii(c))))
    name = F.from_json(F.lit('{"<": "lt", ">": "gt", "&": "amp", "é": "eacute", "½": "frac12", "…": "hellip"}'), "map<string,string>")
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("<"), T.html_content(F.col("html"), 10**9), F.lit("> & é ½ …")).alias("t"))
    coded = F.array_join(F.transform(F.split("t", ""), lambda c, i: F.concat(F.lit("&"), F.coalesce(F.try_element_at(name, c), code(c, i)), F.lit(";"))), "")
    return p.select("page_id", unescape(coded).alias("text"))


_NESTED = ["0", "0.0", "0.0.0", "0.0.0.0", "0.0.0.0.0", "0.0.0.1", "0.0.1", "0.1", "1"]


@query(f"""with {C.SQL_PAGES}, n as (select unnest({_NESTED}) as path, unnest(range({len(_NESTED)})) as place), t as (select ord * 100 as first, url || '#' || path as url, title || ' ' || path as text, path, place from res, n where path <> '0.0.0' or ord % 3 <> 0),
  k as (select *, row_number() over (partition by first order by place) as k from t)
  select first + k - 1 as ord, url, case when length(path) % 4 = 1 then 'T ' || path else substr(text, 1, 100) end as title, text as snippet, 'related' as type from k where k <= 6""")
def topics_normalize(spark, d):
    """A payload for each page, its topics nested five deep; every third one has an inner topic without address."""
    def topic(path: str, inner: list):
        own = [F.concat("url", F.lit(f"#{path}")).alias("FirstURL"), F.concat("title", F.lit(f" {path}")).alias("Text")]
        if path == "0.0.0":
            own[0] = F.when(F.col("ord") % 3 != 0, own[0]).alias("FirstURL")
        own.append(F.lit(f'<a href="x">T {path}</a> more' if len(path) % 4 == 1 else "plain").alias("Result"))
        return F.struct(*own, *([F.to_variant_object(F.array(*inner)).alias("Topics")] if inner else []))

    tree = lambda path: topic(path, [F.to_variant_object(tree(c)) for c in _NESTED if c.startswith(path + ".") and c.count(".") == path.count(".") + 1])
    payload = F.to_json(F.struct(F.array(F.to_variant_object(tree("0")), F.to_variant_object(tree("1"))).alias("RelatedTopics")))
    p = C.pages(spark, d).select((F.col("ord") * 100).alias("ord"), payload.alias("payload"))
    return P.instant_answers(p, C.as_of(), 6).select("ord", "url", "title", "snippet", F.col("metadata")["type"].alias("type"))


@query("select conv_id, turn, sha256('brave:' || role || ':' || turn || ':a.org,b.org:c.org:en:2024-01-01/2024-02-01') as key from conversations")
def cache_key(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", S.cache_key(F.lit("brave"), F.col("role"), F.col("turn"), ["b.org", "a.org"], ["c.org"], "en", ("2024-01-01", "2024-02-01")).alias("key"))


@query("select event_id, epoch_ms(timestamp '2024-01-15 00:00:00') - epoch_ms(ts) > 3600000 as expired from events")
def cache_expiry(spark, d):
    return table(spark, d, "events").select("event_id", (F.unix_millis(F.lit("2024-01-15 00:00:00").cast("timestamp")) - F.unix_millis(F.col("ts").cast("timestamp")) > 3_600_000).alias("expired"))


@query(f"with w as (select doc_id, unnest({C.sql_words('text', 3)}) as term from documents) select term, count(*) as n from w where not list_contains({Q.STOP + ['thing']}, term) group by term")
def term_anti_join(spark, d):
    stop = spark.createDataFrame([(w,) for w in [*Q.STOP, "thing"]], "term string")
    w = table(spark, d, "documents").select(F.explode(T.words(F.col("text"), 3)).alias("term"))
    return w.join(F.broadcast(stop), "term", "left_anti").groupBy("term").agg(F.count("*").alias("n"))


@query(f"with {C.SQL_PAGES} select ord from res where source = 'brave' union all (select ord from res where source = 'rss' order by ord limit 5) union all (select ord from res where source = 'serp' order by ord limit 5)")
def waterfall_union(spark, d):
    p = C.pages(spark, d).select("ord", "source")
    by = lambda s: p.filter(F.col("source") == s)
    return S.waterfall([by("none"), by("brave"), by("duckduckgo")], [by("rss"), by("serp")], 5).select("ord")


@query("select page_id, case when coalesce(regexp_extract(html, '<a[^>]*>([^<]+)</a>', 1), '') <> '' then regexp_extract(html, '<a[^>]*>([^<]+)</a>', 1) else substr(url, 1, 100) end as title from pages")
def anchor_title(spark, d):
    return table(spark, d, "pages").select("page_id", T.anchor_title(F.col("html"), F.col("url")).alias("title"))


def _sql_strip(text: str) -> str:
    return rf"regexp_replace({text}, '^{C._SPACE}+|{C._SPACE}+$', '', 'g')"


def _sql_sentences(text: str, most: int, least: int) -> str:
    parts = f"list_transform([regexp_extract_all({text}, '[^.!?]+[.!?]+')], lambda f: case when len(f) > 0 then f else [{text}] end)[1]"
    states = f"list_prepend({{'cur': '', 'out': []::varchar[]}}, list_transform({parts}, lambda s: {{'cur': s, 'out': []::varchar[]}}))"
    step = f"""case when length(a.cur) + length(x.cur) > {most} then {{'cur': x.cur, 'out': case when length(a.cur) >= {least} then list_append(a.out, {_sql_strip("a.cur")}) else a.out end}} else {{'cur': a.cur || x.cur, 'out': a.out}} end"""
    return f"list_transform([list_reduce({states}, lambda a, x: {step})], lambda e: case when e.cur <> '' then list_append(e.out, {_sql_strip('e.cur')}) else e.out end)[1]"


def _sql_paragraphs(text: str, most: int = 2000, least: int = 100, overlap: int = 200) -> str:
    """One paragraph a step of a recursive query: cur is open, done came out at this step."""
    return rf"""with recursive parts as (select doc_id, string_split_regex({text}, '\n\n+') as p from documents where text is not null),
  walk as (select doc_id, p, 0 as i, '' as cur, []::varchar[] as done from parts
    union all select doc_id, p, i + 1, case when fits then joined when length(begun) > {most} then coalesce(cut[-1], '') else begun end,
      case when fits then [] else list_concat(case when length(cur) >= {least} then [cur] else [] end, case when length(begun) > {most} then cut[:-2] else [] end) end
    from (select *, case when not fits and length(begun) > {most} then {_sql_sentences("begun", most, least)} end as cut
      from (select *, length(cur) + length(p[i + 1]) + 2 <= {most} as fits, cur || case when cur <> '' then chr(10) || chr(10) else '' end || p[i + 1] as joined, case when cur <> '' then right(cur, {overlap}) || chr(10) || chr(10) else '' end || p[i + 1] as begun from walk where i < len(p)))),
  rows as (select doc_id, i, unnest(done) as content, unnest(range(len(done))) as k from walk union all select doc_id, i + 1, cur, 0 from walk where i = len(p) and length(cur) >= {least})
  select doc_id, cast(row_number() over (partition by doc_id order by i, k) - 1 as int) as chunk, content from rows"""


@query(_sql_paragraphs("text"))
def text_chunks(spark, d):
    return K.chunked(table(spark, d, "documents"), K.paragraphs(F.col("text")), "doc_id")


@query(_sql_paragraphs("replace(text, chr(10), chr(10) || chr(10))", 600, 60, 50))
def paragraph_chunks(spark, d):
    """Each line of a text as a paragraph."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return K.chunked(table(spark, d, "documents"), K.paragraphs(text, 600, 60, 50), "doc_id")


_LINE_STEP = """list_transform([a.size + length(y.line) + 1 > 1000 and a.at > a.first], lambda f: list_transform([greatest(a.first, a.at - 2)], lambda b:
  {'line': '', 'size': case when f then length(array_to_string(list_slice(r, b + 1, a.at), chr(10))) else a.size end + length(y.line) + 1, 'first': case when f then b else a.first end, 'at': a.at + 1, 'out': case when f then list_append(a.out, {'a': a.first, 'b': a.at}) else a.out end})[1])[1]"""


@query(f"""with t as (select doc_id, string_split(text, chr(10)) as r from documents where text is not null),
  s as (select doc_id, r, list_prepend({{'line': '', 'size': 0::bigint, 'first': 0::bigint, 'at': 0::bigint, 'out': []::struct(a bigint, b bigint)[]}}, list_transform(r, lambda z: {{'line': z, 'size': 0::bigint, 'first': 0::bigint, 'at': 0::bigint, 'out': []::struct(a bigint, b bigint)[]}})) as x from t),
  e as (select doc_id, r, list_reduce(x, lambda a, y: {_LINE_STEP}) as e from s),
  c as (select doc_id, list_filter(list_transform(list_append(e.out, {{'a': e.first, 'b': e.at}}), lambda b: {{'first_line': cast(b.a + 1 as int), 'last_line': cast(b.b as int), 'content': array_to_string(list_slice(r, b.a + 1, b.b), chr(10))}}), lambda c: length(c.content) >= 100) as c from e)
  select doc_id, cast(k as int) as chunk, c[k + 1].first_line as first_line, c[k + 1].last_line as last_line, c[k + 1].content as content from (select doc_id, c, unnest(range(len(c))) as k from c)""")
def line_chunks(spark, d):
    """Runs of lines of up to 1000 characters, the last two lines of each repeated in the next."""
    return K.chunked(table(spark, d, "documents"), K.line_blocks(F.col("text"), 1000, 100, 160), "doc_id")


@query(f"with {C.SQL_PAGES} select ord, url, title, snippet, 'serp' as source, timestamp '2024-03-01 00:00:00' - to_days(cast(ord % 30 as int)) as ts from res where contains({C.sql_host()}, 'example') and not coalesce(contains({C.sql_host()}, 'spam'), false) order by ord limit 60")
def serp_normalize(spark, d):
    item = F.struct(F.col("title"), F.col("url").alias("link"), "snippet", F.concat((F.col("ord") % 30).cast("string"), F.lit(" days ago")).alias("date"))
    pages = C.pages(spark, d).select(F.expr("ord - pmod(ord, 100)").alias("first"), F.expr("int(pmod(ord, 100))").alias("place"), item.alias("i"))
    # one payload for each 100 ids; an id without a page leaves its place empty
    held = pages.groupBy("first").agg(F.map_from_entries(F.collect_list(F.struct("place", "i"))).alias("m"))
    payloads = held.select("first", F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(99)), lambda n: F.col("m")[n]).alias("organic_results"))).alias("payload"))
    return N.organic(payloads, C.as_of(), 60, ["example"], ["spam"])


@query(rf"with {C.SQL_PAGES} select ord, url, title, trim(regexp_replace(regexp_replace('<b>' || snippet || '</b>  x', '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))[1:500] as snippet, 'rss' as source, ts from res where ord % 3 <> 0")
def rss_normalize(spark, d):
    p = C.pages(spark, d)
    items = p.select("ord", F.when(F.col("ord") % 3 != 0, F.col("url")).alias("link"), "title", F.lit(None).cast("string").alias("contentSnippet"), F.concat(F.lit("<b>"), "snippet", F.lit("</b>  x")).alias("summary"), F.lit("c").alias("content"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("isoDate"))
    return N.feed_items(items, C.as_of())


@query(rf"""with {C.SQL_PAGES}, s as (select *, {_SCORE} as v from res), t as (select *, case when length(snippet) <= 300 then snippet else
    case when contains(snippet[1:300], ' ') and 300 - instr(reverse(snippet[1:300]), ' ') > 240 then substr(snippet, 1, 300 - instr(reverse(snippet[1:300]), ' ')) else snippet[1:300] end || '...' end as cut from s)
  select ord, '### [' || regexp_replace(title, '([\[\]|])', '\\\1', 'g') || '](' || url || ')' || chr(10) || chr(10) || cut || chr(10) || chr(10) || '*Score: ' || cast(floor(v * 100 + 0.5::double) as bigint) || '% | Source: ' || source || ' | Date: ' || strftime(ts, '%Y-%m-%d') || '*' || chr(10) || '*Categories: ' || array_to_string(list_transform({_sql_categories(RULES)}, lambda x: '`' || x || '`'), ' ') || '*' as line from t""")
def result_format(spark, d):
    return O.result_lines(_with_categories(R.scored(C.pages(spark, d), QUERY, C.as_of(), TRUST)))


def _with_categories(df):
    return df.withColumn("categories", S.categories(F.col("url"), F.col("title"), F.col("snippet"), RULES))


_BEST = f"best as (select *, {_SCORE} as v, row_number() over (order by {_SCORE} desc, ord) as rank from res qualify rank <= 60)"


@query(f"with {C.SQL_PAGES}, {_BEST} select ord, url, round(v, 6) as score, rank from best")
def global_rank(spark, d):
    return S.ranked(R.scored(C.pages(spark, d), QUERY, C.as_of(), TRUST), 60).select("ord", "url", F.round("score", 6).alias("score"), "rank")


@query(f"""with {C.SQL_PAGES}, s as (select *, coalesce({C.sql_host()}, 'Unknown') as section from res) select section, ord, row_number() over (partition by section order by ord) as place from s""")
def markdown_by_domain(spark, d):
    return O.body(R.scored(C.pages(spark, d), QUERY, C.as_of(), TRUST), "domain").select("section", "ord", "place")


@query(f"""with {C.SQL_PAGES}, s as (select *, ({_sql_categories(RULES)})[1] as section from res) select section, ord, row_number() over (partition by section order by ord) as place from s""")
def markdown_by_category(spark, d):
    return O.body(_with_categories(R.scored(C.pages(spark, d), QUERY, C.as_of(), TRUST)), "category").select("section", "ord", "place")


@query(f"select count(*) as results, count(distinct {C.sql_host()}) as domains from pages")
def report_summary(spark, d):
    return O.summary(table(spark, d, "pages"))


_LINE = rf"""'### [' || regexp_replace(title, '([\[\]|])', '\\\1', 'g') || '](' || url || ')' || chr(10) || chr(10) || case when length(snippet) <= 300 then snippet else
    case when contains(snippet[1:300], ' ') and 300 - instr(reverse(snippet[1:300]), ' ') > 240 then substr(snippet, 1, 300 - instr(reverse(snippet[1:300]), ' ')) else snippet[1:300] end || '...' end
  || chr(10) || chr(10) || '*Score: ' || cast(floor(v * 100 + 0.5::double) as bigint) || '% | Source: ' || source || ' | Date: ' || strftime(ts, '%Y-%m-%d') || '*' || chr(10) || '*Categories: ' || array_to_string(list_transform({_sql_categories(RULES)}, lambda x: '`' || x || '`'), ' ') || '*'"""
_RULE = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@query(f"""with {C.SQL_PAGES}, b as materialized (select *, {_SCORE} as v, coalesce({C.sql_host()}, 'Unknown') as section, {C.sql_host()} as host from res order by {_SCORE} desc, ord limit 50),
  l as (select ord, section, {_LINE} as line from b), s as (select section, count(*) as n, min(ord) as first, '## ' || section || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) order by ord) as t from l group by section),
  k as (select distinct regexp_replace(host, '[.][^.]*$', '') as link from b where host is not null),
  r as (select '---' || chr(10) || 'title: "{QUERY}"' || chr(10) || 'date: 2024-03-01' || chr(10) || 'tags: ["notes"]' || chr(10) || 'sources: ["duckduckgo", "brave", "rss", "serp"]' || chr(10) || 'total_results: ' || (select count(*) from b) || chr(10) || 'generated_by: quarrysift' || chr(10) || '---' || chr(10) || chr(10)
    || '# {QUERY}' || chr(10) || chr(10) || '> **Summary**' || chr(10) || '> - **Query**: {QUERY}' || chr(10) || '> - **Results**: ' || (select count(*) from b) || ' unique results from 4 provider(s)' || chr(10) || '> - **Sources**: ' || (select count(distinct host) from b) || ' unique domains' || chr(10) || '> - **Generated**: 2024-03-01' || chr(10) || chr(10)
    || (select string_agg(t, {_RULE} order by n desc, first) from s) || {_RULE} || '## Related' || chr(10) || chr(10) || (select string_agg('- [[' || link || ']]', chr(10) order by link) from k) || chr(10) as text)
  select cast(i as int) as line, p[i + 1] as text from (select string_split(text, chr(10)) as p, unnest(range(len(string_split(text, chr(10))))) as i from r)""")
def markdown_report(spark, d):
    """The fifty best pages; a row for each line."""
    text = O.markdown_text(_with_categories(R.scored(C.pages(spark, d), QUERY, C.as_of(), TRUST)), QUERY, "2024-03-01", 50, "domain", ("notes",), tuple(C.SOURCES))
    return text.select(F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))


@query(f"""with {C.SQL_PAGES}, b as materialized (select *, {_SCORE} as v, {C.sql_host()} as host, row_number() over (order by {_SCORE} desc, ord) - 1 as place from res qualify place < 50)
  select place, url, title, floor(v * 100 + 0.5::double) / 100 as score, coalesce(host, 'unknown') as domain, (select count(*) from b) as total, (select count(distinct host) from b) as domains from b""")
def json_report(spark, d):
    """The fifty best pages; what the text says of each."""
    text = O.json_text(_with_categories(R.scored(C.pages(spark, d), QUERY, C.as_of(), TRUST)), QUERY, "2024-03-01T00:00:00.000Z", tuple(C.SOURCES), most=50)
    value = F.from_json("value", "meta struct<totalResults:long,uniqueDomains:long>, results array<struct<url:string,title:string,score:double,domain:string>>")
    rows = text.select(value.alias("v")).select("v.meta", F.posexplode("v.results").alias("place", "r"))
    return rows.select(F.col("place").cast("long").alias("place"), "r.url", "r.title", "r.score", "r.domain", F.col("meta.totalResults").alias("total"), F.col("meta.uniqueDomains").alias("domains"))


_TEMPLATE = "# {{section}}: {{totalResults}} of {{query}}\n{{#each results}}- [{{title}}]({{url}}) {{score}}% {{nothing}} {{categories}}\n{{/each}}end"
_SQL_LINE = "'- [' || coalesce(title, '') || '](' || coalesce(url, '') || ') ' || cast(floor(v * 100 + 0.5::double) as bigint) || '% {{{{nothing}}}} ' || array_to_string(cats, ', ') || chr(10)"
_SQL_TEXT = f"'# ' || section || ': ' || count(*) || ' of {QUERY}' || chr(10) || string_agg({_SQL_LINE.format()}, '' order by ord) || 'end'"


@query(f"""with {C.SQL_PAGES}, s as materialized (select ord, url, title, {_SCORE} as v, {_sql_categories(RULES)} as cats, coalesce({C.sql_host()}, 'unknown') as domain from res),
  g as (select 'domain' as kind, domain as section, * exclude (domain) from s union all select 'category', unnest(cats), * exclude (domain) from s)
  select kind, section, count(*) as n, {_SQL_TEXT} as text from g group by kind, section""")
def template_sections(spark, d):
    """One text for each domain and each category of all pages, which are scored once for both."""
    s = materialize(_with_categories(R.scored(C.pages(spark, d), QUERY, C.as_of(), TRUST)).select("ord", "url", "title", "score", "categories"), "lines")
    return S.union_all([O.rendered(s, _TEMPLATE, {"query": QUERY}, by).select(F.lit(by).alias("kind"), "section", "n", "text") for by in ("domain", "category")])


@query(f"""with {C.SQL_PAGES}, s as (select *, {_SCORE} as v from res), m as (select greatest(max(v), 0.01) as most from s)
  select ord, case when coalesce(title, '') = '' then 'Untitled' else title end as title, url, substr(snippet, 1, 200) || case when length(snippet) > 200 then '...' else '' end as snippet,
  cast(floor(v / most * 100 + 0.5::double) as bigint) as percent, coalesce({C.sql_host()}, 'unknown') as domain, source from s, m""")
def web_cards(spark, d):
    return O.cards(R.scored(C.pages(spark, d), QUERY, C.as_of(), TRUST))


@query(f"with {C.SQL_DOCS}, {_sql_terms()}, ten as (select term, score, source, frequency, row_number() over (order by score desc, kind, pos) as place from best order by score desc, kind, pos limit 10) select place, term, floor(score * 100 + 0.5::double) / 100 as score, source from ten")
def refine_report(spark, d):
    ten = Q.suggestions(C.documents(spark, d), "thing", 10).coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)
    value = F.from_json("value", "query string, suggestions array<struct<term:string,score:double,source:string,frequency:double>>")
    x = O.refine_report(ten, "thing").select(F.posexplode(value["suggestions"]).alias("place", "s"))
    return x.select((F.col("place") + 1).cast("long").alias("place"), "s.term", "s.score", "s.source")


_PLAIN_COS = "list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])))"


@query(f"select e.vec_id, round({_PLAIN_COS}, 6) as similarity from embeddings e, (select embedding from embeddings where vec_id = 1) q")
def web_cosine(spark, d):
    e = table(spark, d, "embeddings")
    return R.similarities(e, e.filter("vec_id = 1"), strict=False).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"with {C.SQL_PAGES} select ord, url from res where url not in (select url from res where ord % 2 = 0)")
def not_indexed(spark, d):
    p = C.pages(spark, d).select("ord", "url")
    return S.not_indexed(p, p.filter("ord % 2 = 0"))


@query(f"with {C.SQL_PAGES} select row_number() over (order by ord) - 1 as ord, url, title, snippet, 'brave' as source, timestamp '2024-03-01 00:00:00' - to_days(cast(ord % 30 as int)) as ts from res order by ord limit 20")
def brave_normalize(spark, d):
    """All pages in one answer; the source's own limit is 20 results."""
    item = F.struct("ord", "title", "url", F.col("snippet").alias("description"), F.concat((F.col("ord") % 30).cast("string"), F.lit(" days ago")).alias("age"))
    first = C.pages(spark, d).orderBy("ord").limit(20)  # what the service sends at most
    p = first.agg(F.to_json(F.struct(F.struct(F.sort_array(F.collect_list(item)).alias("results")).alias("web"))).alias("payload"))
    return N.web_and_news(p, C.as_of(), 20)


@query(f"with {C.SQL_PAGES} select ord, url, title, trim(snippet) as snippet, 'duckduckgo' as source, timestamp '2024-03-01 00:00:00' as ts from res where title <> '' and ord % 2 = 0")
def lite_normalize(spark, d):
    quote = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit('<tr><td><a rel="nofollow" href="'), quote(F.col("url")), F.lit('" class="result-link">'), quote(F.col("title")), F.lit('</a></td></tr><tr><td class="result-snippet">'), quote(F.trim("snippet")), F.lit("</td></tr>"))
    p = C.pages(spark, d).filter("ord % 2 = 0").select("ord", F.concat(F.lit("<table>"), row, F.lit('<a href="/x" class="result-link">x</a></table>')).alias("payload"))
    return N.lite_page(p, C.as_of(), None)


@query(rf"with {C.SQL_PAGES}, i as (select ord, url, title, trim(regexp_replace(regexp_replace(snippet, '<[^>]*>', '', 'g'), '{C._SPACE}+', ' ', 'g')) as snippet, ts from res) select ord, url, case when trim(title) = '' then 'Untitled' else trim(title) end as title, substr(snippet, 1, 500) as snippet, 'rss' as source, ts, 'by ' || ord as author from i")
def feed_normalize(spark, d):
    tag = lambda n, c: F.concat(F.lit(f"<{n}><![CDATA["), c, F.lit(f"]]></{n}>"))
    item = F.concat(F.lit("<item>"), tag("title", F.col("title")), tag("link", F.col("url")), tag("description", F.col("snippet")), tag("dc:creator", F.concat(F.lit("by "), F.col("ord").cast("string"))), tag("pubDate", F.date_format("ts", "dd MMM yyyy HH:mm:ss' GMT'")), F.lit("</item>"))
    p = C.pages(spark, d).select("ord", F.concat(F.lit("<rss><channel>"), item, F.lit("</channel></rss>")).alias("payload"))
    return W.feed(p, C.as_of()).select("ord", "url", "title", "snippet", "source", "ts", F.col("metadata")["author"].alias("author"))


def _turns(spark, d) -> A.Rounds:
    """The turns of all conversations as rounds, distinct by first word."""
    c = table(spark, d, "conversations")
    found = c.select(F.col("conv_id").alias("ord"), "turn", F.lower(F.substring_index("text", " ", 1)).alias("url"), F.col("role").alias("source"), F.create_map(F.lit("conv"), F.col("conv_id").cast("string")).alias("metadata"))
    r = A.Rounds(spark, F.col("url"), 8)
    for turn in range(c.agg(F.coalesce(F.max("turn"), F.lit(-1))).first()[0] + 1):
        r.add(found.filter(F.col("turn") == turn).drop("turn"))
    return r


_TURNS = "t as materialized (select conv_id as ord, turn, lower(split_part(text, ' ', 1)) as url, role as source from conversations where turn >= 0 and text is not null)"


@query(f"""with {_TURNS}, n as (select url, source, min((turn, ord)) as first from t group by all), s as (select url, string_agg(source, ',' order by first) as names from n group by url)
  select url, arg_min(ord, (turn, ord)) as ord, cast(min(turn) + 1 as int) as round, count(*) as copies, cast(arg_max(ord, (turn, ord)) as varchar) as conv, case when count(*) > 1 then any_value(names) end as sources from t join s using (url) group by url""")
def rounds_union(spark, d):
    r = _turns(spark, d).total()
    return r.filter("url is not null").select("url", "ord", "round", "copies", F.col("metadata")["conv"].alias("conv"), F.array_join("sources", ",").alias("sources"))


@query(f"with {_TURNS}, u as (select url, turn, row_number() over (partition by url order by turn) as k from (select distinct url, turn from t)) select cast(turn + 1 as int) as round, count(*) as keys, count(*) filter (k = 1) as new from u group by turn")
def rounds_counts(spark, d):
    r = _turns(spark, d)
    return r.counts()


@query(f"""with {C.SQL_TWICE}, keyed as materialized (select *, {C.sql_normalized()} || ':' || {C.sql_fingerprint("title || ' ' || snippet")} as key from two), {_SOURCES}
  select min(ord) as ord, arg_min(url, ord) as url, arg_max(page, ord) as page, arg_max(copy, ord) as copy, case when count(*) > 1 then any_value(names) end as sources, count(*) as copies from keyed join s using (key) group by key""")
def stream_first_wins(spark, d):
    """The pages and their copies as a stream of files; same rows as dedup_url_fp."""
    rows = C.pages_twice(spark, d)
    path = scratch(spark, "arrivals")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(path)
    got = feed.run_available(feed.merged_first_wins(stream, "3000 hours", "3000 hours"))
    return got.select("ord", "url", F.col("metadata")["page_id"].alias("page"), F.col("metadata")["copy"].alias("copy"), F.array_join("sources", ",").alias("sources"), "copies")


def _item_rules(spark, d):
    """Pieces of all benchmark items, some hundreds each, as keyword rules."""
    items = table(spark, d, "benchmark").select("item_id", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("i"))
    pieces = items.select("item_id", (F.col("item_id") * 1000 + F.col("i")).cast("long").alias("rank"), F.lower(F.substring("text", F.col("i"), 6 + F.col("i") % 9)).alias("pattern"))
    return pieces.select("rank", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("name"), F.lit("text").alias("kind"), "pattern")


@query("""with r as (select item_id * 1000 + i as rank, 'item ' || item_id as name, lower(substr(text, i, 6 + i % 9)) as pattern from (select item_id, text, unnest(range(1, length(text) + 1)) as i from benchmark)),
  p as (select distinct pattern from r), m as (select doc_id, pattern from (select doc_id, lower(text) as t from documents) join p on contains(t, pattern)),
  n as (select doc_id, name, min(rank) as first, count(*) as k from m join r using (pattern) group by all)
  select doc_id, cast(coalesce(sum(k), 0) as bigint) as n_rules, coalesce(string_agg(name, ',' order by first), 'General') as categories from documents left join n using (doc_id) group by doc_id""")
def rules_categories(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    met = L.matched_rules(docs, _item_rules(spark, d), "doc_id", {"text": F.lower("text")})
    return met.select("doc_id", F.size("rules").cast("long").alias("n_rules"), F.array_join(L.categories(F.col("rules")), ",").alias("categories"))


@query("""with s as (select q.vec_id as query, e.vec_id, round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 9) as similarity from embeddings e, embeddings q where q.vec_id % 5 = 0)
  select query, cast(row_number() over (partition by query order by similarity desc, vec_id) as int) as rank, vec_id, round(similarity, 6) as similarity from s qualify row_number() over (partition by query order by s.similarity desc, vec_id) <= 10""")
def vectors_topk(spark, d):
    """Every fifth vector as a query against all."""
    e = table(spark, d, "embeddings")
    return V.nearest_many(e, e.filter("vec_id % 5 = 0"), 10, digits=9).withColumn("similarity", F.round("similarity", 6))


#: For each web adapter what stands for a page in its payload, and the place of the list in it.
_WEB_ITEMS = {
    "searxng": ("results", {"url": "url", "title": "nullif(title, '')", "content": "snippet"}),
    "wikipedia": ("query.search", {"title": "concat('Page of ', ord)", "snippet": "concat('<b>', title, '</b> ', ord)", "timestamp": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"}),
    "hackernews": ("hits", {"url": "if(ord % 5 = 0, null, url)", "title": "title", "points": "int(ord % 100)", "num_comments": "int(ord % 7)", "author": "source", "created_at": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"}),
    "github": ("items", {"html_url": "url", "full_name": "concat(source, '/', ord)", "description": "if(ord % 3 = 0, null, title)", "stargazers_count": "int(ord % 1000)", "updated_at": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"}),
    "reddit": ("data.children", {"data": "named_struct('permalink', concat('/r/', source, '/', ord), 'title', title, 'selftext', snippet, 'created_utc', double(unix_timestamp(ts)))"}),
    "stackoverflow": ("items", {"link": "url", "title": "concat('&lt;', ord, '&gt; &eacute;&#x21; ', replace(title, '&', '&amp;'))", "score": "int(ord % 50)", "answer_count": "int(ord % 4)", "creation_date": "unix_timestamp(ts)"}),
}


@query(f"""with {C.SQL_PAGES}, a as (
  select 'searxng' as source, url, coalesce(nullif(title, ''), 'Untitled') as title, snippet, timestamp '{C.AS_OF}' as ts from res
  union all select 'wikipedia', 'https://en.wikipedia.org/wiki/Page_of_' || ord, 'Page of ' || ord, title || ' ' || ord, ts from res
  union all select 'hackernews', url, title, (ord % 100) || ' points | ' || (ord % 7) || ' comments | by ' || source, ts from res where ord % 5 <> 0
  union all select 'github', url, source || '/' || ord || ' (★' || (ord % 1000) || ')', case when ord % 3 = 0 then '' else title end, ts from res
  union all select 'reddit', 'https://www.reddit.com/r/' || source || '/' || ord, title, substr(snippet, 1, 200), ts from res
  union all select 'stackoverflow', url, '<' || ord || '> é! ' || title, 'Score: ' || (ord % 50) || ' | Answers: ' || (ord % 4), ts from res
  union all select 'arxiv', 'https://p.test/' || ord, 'paper ' || ord, case when length(trim(snippet)) > 200 then substr(trim(snippet), 1, 200) || '...' else trim(snippet) end, ts from res)
  select * from a""")
def web_adapters(spark, d):
    """All pages as payloads of each web service, and of a paper archive, fifty to a payload."""
    p = C.pages(spark, d).withColumn("block", F.floor(F.col("ord") / 50))
    parts = []
    for name, (at, fields) in _WEB_ITEMS.items():
        item = F.struct(*[F.expr(e).alias(k) for k, e in fields.items()])
        held = p.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", item.alias("i")))), lambda e: e["i"]).alias("x"))
        payload = F.col("x")
        for part in reversed(at.split(".")):
            payload = F.struct(payload.alias(part))
        parts.append(N.adapter(name, held.select(F.to_json(payload).alias("payload")), C.as_of(), None).drop("ord"))
    quote = F.replace(F.replace("snippet", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(F.lit("<entry><id>https://p.test/"), F.col("ord").cast("string"), F.lit("</id><title>paper "), F.col("ord").cast("string"), F.lit("</title><summary>"), quote, F.lit("</summary><published>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published></entry>"))
    atom = p.groupBy("block").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("payload")).select("payload")
    return S.union_all([*parts, W.papers(atom, C.as_of()).drop("ord")]).select("source", "url", "title", "snippet", "ts")


def _read_cut(path: str, query: str, limit: int):
    """Results of one provider from the files that were cut for it: their names, and rows within, are in order of ord."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    files, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    for name in sorted(i.path for i in files.get_file_info(fs.FileSelector(at)) if i.path.endswith(".parquet")):
        with files.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(1000, columns=["url", "title", "snippet"]):
                for r in batch.to_pylist():
                    yield r["url"], r["title"], r["snippet"], None


class Gone(OSError):
    status = 410


def _fail(error: Exception, query: str, limit: int):
    raise error


@query(f"""with {C.SQL_PAGES} select source, cast(row_number() over (partition by source order by ord) - 1 as int) as place, url, title, null as message, null as code from res
  union all select 'broken', -1, null, null, 'no answer', null union all select 'gone', -1, null, null, 'gone for good', 410""")
def provider_fetch(spark, d):
    """Four providers with the pages cut among them, and two that fail."""
    path = scratch(spark, "cut")
    cut = C.pages(spark, d).select("source", "ord", "url", "title", "snippet")
    cut.repartitionByRange("source", "ord").sortWithinPartitions("source", "ord").write.partitionBy("source").parquet(path)
    fetchers = {s: functools.partial(_read_cut, f"{path}/source={s}") for s in C.SOURCES}
    fetchers |= {"broken": functools.partial(_fail, OSError("no answer")), "gone": functools.partial(_fail, Gone("gone for good"))}
    providers.register(spark, fetchers, "quarrysift_pages")
    rows = spark.read.format("quarrysift_pages").option("limit", str(10**9)).option("wait", "0.01").load()
    good, bad = providers.fetched(rows)
    errors = bad.select(F.col("provider").alias("source"), F.lit(-1).alias("place"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("title"), "message", F.col("statusCode").alias("code"))
    return good.select("source", "place", "url", "title", F.lit(None).cast("string").alias("message"), F.lit(None).cast("int").alias("code")).unionByName(errors)


@query("""with r as (select event_id, user_id as key, ts as at from events), e as (select user_id as key, ts as at, event_id % 5 as n, event_type as value from events where event_id % 3 = 0 and event_id % 5 > 0),
  m as (select event_id, arg_max(e.at, (e.at, n, value)) as hit, arg_max(value, (e.at, n, value)) as value from r join e on e.key = r.key and e.at <= r.at and e.at >= r.at - to_days(1) group by event_id)
  select event_id, hit, value from r left join m using (event_id)""")
def cache_lookup(spark, d):
    """All events as requests of their user; every third one has left an entry, good for a day."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp")).withColumn("key", F.col("user_id"))
    entries = e.filter("event_id % 3 = 0").select("key", "at", (F.col("event_id") % 5).alias("n"), F.col("event_type").alias("value"))
    return H.lookup(e.select("event_id", "key", "at"), entries, 86_400, ["n", "value"]).select("event_id", "hit", "value")


@query(rf"""with {C.SQL_PAGES}, i as (select ord, url, title, trim(regexp_replace(regexp_replace(snippet, '<[^>]*>', '', 'g'), '{C._SPACE}+', ' ', 'g')) as snippet, ts from res)
  select 100000 * (ord // 50) + ord % 50 as ord, url, case when trim(title) = '' then 'Untitled' else trim(title) end as title, substr(snippet, 1, 500) as snippet, ts, case when ord // 50 % 2 = 0 then 'by ' || ord end as author, null as message from i where ord // 50 % 4 <> 3
  union all select distinct 100000 * (ord // 50), null, null, null, null::timestamp, null, 'no well-formed feed' from i where ord // 50 % 4 = 3""")
def feed_documents(spark, d):
    """Fifty pages to a feed, RSS and Atom by turns; every fourth feed is cut off in the middle. Items and errors."""
    plain = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda n, c, more="": F.concat(F.lit(f"<{n}{more}>"), c, F.lit(f"</{n}>"))
    # one element's text in two CDATA parts, an item's end inside it, and one in a comment
    halves = F.concat(F.lit("<![CDATA["), F.regexp_replace("snippet", r"\]\]>", ""), F.lit(" <b></item></b>]]><![CDATA[]]>"))
    rss = F.concat(F.lit("<item><!-- <item> </item> -->"), tag("title", plain(F.col("title"))), tag("link", plain(F.col("url"))), tag("description", halves), tag("dc:creator", F.concat(F.lit("by "), F.col("ord").cast("string"))), tag("pubDate", F.date_format("ts", "dd MMM yyyy HH:mm:ss' GMT'")), F.lit("</item>"))
    atom = F.concat(F.lit("<entry>"), tag("title", plain(F.col("title")), ' type="text"'), F.lit('<link rel="self" href="https://x.test/"/><link href="'), F.replace(plain(F.col("url")), F.lit('"'), F.lit("&quot;")), F.lit('"/>'), tag("summary", plain(F.col("snippet"))), tag("updated", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("</entry>"))
    p = C.pages(spark, d).withColumn("block", F.floor(F.col("ord") / 50)).withColumn("x", F.when(F.col("block") % 2 == 0, rss).otherwise(atom))
    body = p.groupBy("block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "x"))), lambda e: e["x"]), "\n").alias("b"))
    whole = F.when(F.col("block") % 2 == 0, F.concat(F.lit('<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title>'), "b", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>c</title>'), "b", F.lit("</feed>")))
    cut = F.when(F.col("block") % 4 == 3, F.substring(whole, F.lit(1), F.floor(F.length(whole) / 2).cast("int"))).otherwise(whole)
    payloads = body.select((F.col("block") * 100_000).alias("ord"), cut.alias("payload"))
    good = W.feed(payloads, C.as_of()).select("ord", "url", "title", "snippet", "ts", F.col("metadata")["author"].alias("author"), F.lit(None).cast("string").alias("message"))
    none = lambda t: F.lit(None).cast(t)
    bad = W.feed_errors(payloads).select("ord", none("string").alias("url"), none("string").alias("title"), none("string").alias("snippet"), none("timestamp").alias("ts"), none("string").alias("author"), "message")
    return good.unionByName(bad)


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
