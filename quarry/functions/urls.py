"""URL keys, unwrapping and query building."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import text_or_empty

# Query keys that only track, besides all that start with utm_.
TRACKING = ["gclid", "fbclid", "msclkid", "igshid", "mc_cid", "mc_eid", "ocid", "cmpid", "cmp", "ref", "ref_src", "ref_url", "output", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]
# Parts of addresses that hold no article.
SKIPPED = ["youtube.com", "youtu.be", "youtube-nocookie.com", "consent.yahoo.com", "guce.yahoo.com", "collectconsent", "/consent", "privacy-mgmt", "baijiahao.baidu.com"]
# The query keys that hold a redirect's target, in order.
TARGET_KEYS = ["url", "u", "q", "target", "dest"]


def parts(c: Column) -> dict[str, Column]:
    """scheme, host, path, query of an address, as text; '' where missing. Parameters after ; and fragments are left out."""
    raw = F.trim(text_or_empty(c))
    bare = F.regexp_replace(raw, r"#.*$", "")
    get = lambda i: F.regexp_extract(bare, r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?]*))?([^?]*)(?:\?(.*))?$", i)
    path = F.regexp_replace(get(3), r";[^/]*$", "")
    return {"raw": raw, "bare": bare, "scheme": F.lower(get(1)), "host": F.lower(get(2)), "path": path, "query": get(4)}


def canonical_news_url(c: Column) -> Column:
    """Scheme and host in lower case without www., no trailing slash, tracking keys or fragment; other pairs keep their order."""
    p = parts(c)
    path = F.when(p["path"] == "", "/").otherwise(p["path"])
    path = F.when((path != "/") & F.endswith(path, F.lit("/")), F.regexp_replace(path, "/$", "")).otherwise(path)
    pairs = F.filter(F.split(p["query"], "&"), lambda x: x != "")

    def kept(x: Column) -> Column:
        key = F.lower(F.trim(F.element_at(F.split(x, "="), 1)))
        return (key != "") & ~F.startswith(key, F.lit("utm_")) & ~key.isin(TRACKING)

    coded = F.transform(F.filter(pairs, kept), lambda x: F.when(F.contains(x, F.lit("=")), x).otherwise(F.concat(x, F.lit("="))))
    query = F.array_join(coded, "&")
    whole = F.concat(F.when(p["scheme"] == "", "https").otherwise(p["scheme"]), F.lit("://"), F.regexp_replace(p["host"], r"^www\.", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(p["raw"] == "", "").when(p["host"] == "", F.lower(p["bare"])).otherwise(whole)


def url_key(url: Column, source_type: Column) -> Column:
    return F.when(F.lower(F.trim(text_or_empty(source_type))) == "news", canonical_news_url(url)).otherwise(F.lower(F.trim(text_or_empty(url))))


def host(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(parts(c)["host"], r"^[^@]*@|:\d+$", ""), r"^www\.", "")


def query_value(c: Column, key: str) -> Column:
    found = F.regexp_extract(F.concat(F.lit("&"), parts(c)["query"]), rf"&{key}=([^&]*)", 1)
    return F.when(found != "", F.try_url_decode(found))


def redirect_target(c: Column) -> Column:
    """The address that a news redirect carries, '' if it is none."""
    ours = F.contains(parts(c)["host"], F.lit("bing.com")) | F.contains(parts(c)["host"], F.lit("news.google.com"))
    tries = [F.when(F.startswith(query_value(c, k), F.lit("http")), query_value(c, k)) for k in TARGET_KEYS]
    return F.when(ours, F.coalesce(*tries, F.lit(""))).otherwise("")


def result_link(c: Column) -> Column:
    """The target of a search page's /url?q= link, or the link itself."""
    wrapped = F.startswith(parts(c)["path"], F.lit("/url"))
    return F.when(wrapped, F.coalesce(query_value(c, "q"), F.lit(""))).otherwise(F.trim(text_or_empty(c)))


def should_skip(c: Column) -> Column:
    low = F.lower(F.trim(text_or_empty(c)))
    rule = low == ""
    for s in SKIPPED:
        rule = rule | F.contains(low, F.lit(s))
    return rule


def search_query(*texts: Column) -> Column:
    """Tokens of the parts in order, each once whatever its case; quoted and bracketed groups stay whole."""
    joined = F.concat_ws(" ", *texts)
    tokens = F.regexp_extract_all(joined, F.lit(r'("[^"]*"|\([^)]*\)|\S+)'), 1)
    lowered = F.transform(tokens, lambda t: F.lower(t))
    return F.array_join(F.filter(tokens, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1), " ")


def unique_phrases(values: Column) -> Column:
    """Trimmed phrases in order, each once whatever its case."""
    none = F.array().cast("array<string>")

    def step(state: Column, v: Column) -> Column:
        v = F.trim(text_or_empty(v))
        known = (v == "") | F.array_contains(state["seen"], F.lower(v))
        add = F.struct(F.array_append(state["seen"], F.lower(v)).alias("seen"), F.array_append(state["out"], v).alias("out"))
        return F.when(known, state).otherwise(add)

    return F.aggregate(values, F.struct(none.alias("seen"), none.alias("out")), step, lambda state: state["out"])


def source_api(name: Column, url: Column) -> Column:
    """Where a record came from, by ordered rules over its source's name and its address."""
    n, u = F.lower(F.trim(text_or_empty(name))), F.lower(F.trim(text_or_empty(url)))
    has = lambda c, s: F.contains(c, F.lit(s))
    return (
        F.when(has(n, "arxiv") | has(u, "arxiv.org"), "arxiv")
        .when(has(n, "pubmed") | has(u, "pubmed.ncbi.nlm.nih.gov"), "pubmed")
        .when(has(n, "gdelt") | has(u, "gdeltproject.org"), "gdelt")
        .when((has(n, "google") & has(n, "news")) | has(u, "news.google.com"), "google_news_rss")
        .when((has(n, "bing") & has(n, "news")) | has(u, "bing.com/news"), "bing_news_rss")
        .when(has(n, "wikipedia") | has(u, "wikipedia.org"), "wikipedia")
        .when(has(n, "crossref"), "crossref")
        .when(has(n, "googlesearch"), "google_search")
        .when(has(n, "bingsearch"), "bing_search")
        .when(has(u, "doi.org"), "doi")
        .otherwise("unknown")
    )


def canonical_news_url_sql(u: str) -> str:
    """The same in DuckDB SQL, for addresses with a host."""
    bare = f"regexp_replace(trim(coalesce({u}, '')), '#.*$', '')"
    m = f"regexp_extract({bare}, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?]*))?([^?]*)(?:\\?(.*))?$', ['s', 'h', 'p', 'q'])"
    kept = f"""list_filter(string_split({m}.q, '&'), lambda x: x <> '' AND lower(trim(string_split(x, '=')[1])) <> ''
      AND NOT starts_with(lower(trim(string_split(x, '=')[1])), 'utm_') AND NOT list_contains({TRACKING!r}, lower(trim(string_split(x, '=')[1]))))"""
    query = f"array_to_string(list_transform({kept}, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&')"
    path = f"regexp_replace({m}.p, ';[^/]*$', '')"
    return f"""CASE WHEN {bare} = '' THEN '' WHEN {m}.h = '' THEN lower({bare})
      ELSE coalesce(nullif(lower({m}.s), ''), 'https') || '://' || regexp_replace(lower({m}.h), '^www\\.', '')
        || CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/$', '') END
        || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"""
