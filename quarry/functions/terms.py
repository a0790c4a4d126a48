"""Term lists, term counts and the document classifiers built on them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import W, WORDLY, normalize_text, text_or_empty, word_count

# Hint terms of each domain.
DOMAIN_HINTS = {
    "technology": ["technology", "software", "computing", "ai", "algorithm", "cyber", "data", "cloud", "infrastructure", "automation", "digital", "platform", "systems", "network", "engineering"],
    "healthcare": ["health", "medical", "clinical", "disease", "treatment", "hospital", "patient", "diagnosis", "therapy", "epidemiology", "public health", "biomedical", "prevention", "care", "medicine"],
    "history": ["history", "historical", "civilization", "war", "archive", "archaeology", "heritage", "ancient", "medieval", "revolution", "empire", "chronicle", "manuscript", "artifact", "historiography"],
}
# Patterns of sports news, between word boundaries.
OFFTOPIC = ["ipl", "cricket", "football", "soccer", "nba", "nfl", "tennis", "fifa", "uefa", "premier league", "la liga", "serie a", "super bowl", "world cup", "match highlights", "live score", "innings", "bowler", "batsman", "hat-?trick"]
# Core and noise terms.
HEALTHCARE_CORE = ["healthcare", "health", "medical", "clinical", "hospital", "patient", "disease", "treatment", "therapy", "diagnosis", "medicine", "public health", "care"]
FINANCE_NOISE = ["nasdaq", "stock", "shares", "earnings", "semiconductor", "chip", "cloud", "startup", "venture capital", "crypto", "bitcoin", "blockchain"]
HISTORY_CORE = ["history", "historical", "archaeology", "archaeological", "heritage", "archive", "archival", "museum", "artifact", "artifacts", "manuscript", "manuscripts", "repatriation", "antiquities", "monument", "unesco", "excavation", "commemoration"]
HISTORY_NOISE = ["live score", "match", "fixture", "premier league", "football", "soccer", "nba", "nfl", "celebrity", "box office", "trailer", "streaming", "episode"]
# Signs of implementation documents.
TECH_URL = ["docs.", "/docs/", "developer.", "/developer/", "/api/", "readthedocs", "kubernetes.io/docs", "learn.microsoft.com", "developer.mozilla.org"]
TECH_TEXT = ["documentation", "developer", "api", "reference", "tutorial", "guide", "quickstart", "installation", "configuration", "endpoint", "sdk", "example"]
TECH_TITLE = ["documentation", "docs", "api", "reference", "developer", "guide", "tutorial", "quickstart", "sdk", "cli"]
TECH_NOISE = ["stock", "investor", "market", "newsletter", "breaking news", "subscribe", "earnings", "captcha", "cookie consent", "privacy preference"]
# Signs of archival documents.
HISTORY_URL = ["/archive", "/archives", "/collection", "/collections", "/catalog", "/catalogs", "/records", "/research", "/manuscript", "/manuscripts", "/heritage", "/museum", "/chronicle", "/timeline", "/finding-aid", "/finding_aid", "/preservation", "digitalcollections", "digital-collections", "chroniclingamerica", "iiif", "openarchives", "dublincore", "tei-c", "repository"]
HISTORY_STRUCTURE = ["archive", "archives", "archival", "collection", "collections", "catalog", "catalogs", "record", "records", "research", "manuscript", "manuscripts", "finding aid", "finding-aid", "preservation", "digital collection", "digital collections", "museum", "heritage", "history", "historical", "chronicle", "timeline"]
# Signs of a challenge page.
WALL_TITLE = ["just a moment", "please wait", "attention required", "checking your browser", "verify you are human", "access denied", "one more step"]
WALL_TEXT = ["checking if the site connection is secure", "enable javascript and cookies to continue", "malicious bots", "verify you are human", "ddos protection by", "cloudflare ray id", "please stand by while we are checking your browser", "captcha", "security check", "browser integrity check"]
WALL_URL = ["cdn-cgi/challenge", "challenge-platform", "captcha", "turnstile"]


def bounded(pattern: str) -> str:
    """The pattern between word boundaries of any script, as both Java and RE2 read it."""
    return f"(^|[^{W}])({pattern})($|[^{W}])"


def term_pattern(term: str) -> str:
    return bounded(" +".join(re.escape(p).replace("\\-", "-").replace("\\ ", " ") for p in term.lower().split()))


def has_term(blob: Column, term: str) -> Column:
    """Whether normalized text holds the term as whole words; the pattern is only tried where the term occurs at all."""
    words = term.lower().split()
    return F.contains(blob, F.lit(" ".join(words))) & blob.rlike(term_pattern(term)) if words else F.lit(False)


def _count(tests: list[Column]) -> Column:
    out = F.lit(0)
    for t in tests:
        out = out + t.cast("int")
    return out


def word_set(blob: Column) -> Column:
    return F.array_distinct(F.split(blob, f"[^{WORDLY}]+"))


def single_words(terms: list[str]) -> list[str]:
    """Those of the terms that a word_set() can hold."""
    return [t for t in terms if re.fullmatch(r"\w+", t)]


def words_among(blob: Column, lists: list[list[str]]) -> Column:
    """word_set() without the words that are in none of the lists, so that counts look at a few words instead of the whole text's."""
    asked = list(dict.fromkeys(t for terms in lists for t in single_words(terms)))
    return F.array_intersect(F.split(blob, f"[^{WORDLY}]+"), F.array(*[F.lit(t) for t in asked]))


def count_terms(blob: Column, words: Column | None, terms: list[str]) -> Column:
    """How many of the terms a normalized text holds as whole words; words is its word_set(), or words_among() lists with these terms, so that single words cost one look-up, or None where there are few."""
    if words is None:
        return _count([has_term(blob, t) for t in terms])
    single = single_words(terms)
    found = F.size(F.array_intersect(words, F.array(*[F.lit(t) for t in single])))
    return found + _count([has_term(blob, t) for t in terms if t not in single])


def count_parts(text: Column, parts: list[str]) -> Column:
    """How many of the parts occur anywhere in the text, also inside words."""
    return _count([F.contains(text, F.lit(p)) for p in parts])


def domain_terms(domain: str, keywords: list[str]) -> list[str]:
    """A domain's hints, and the keywords' tokens of four characters or more; each once."""
    tokens = [t for k in keywords for t in re.split(r"[^a-z0-9]+", k.lower()) if len(t) >= 4]
    return list(dict.fromkeys([*DOMAIN_HINTS[domain], *tokens]))


def domain_hits(text: Column, domain: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """Hits of the row's domain: its terms as parts of the normalized text."""
    return blob_hits(normalize_text(text), domain, keywords)


def blob_hits(blob: Column, domain: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """domain_hits() of text that is normalized already."""
    out = None
    for name in DOMAIN_HINTS:
        hits = count_parts(blob, domain_terms(name, (keywords or {}).get(name, [])))
        out = F.when(domain == name, hits) if out is None else out.when(domain == name, hits)
    return out.otherwise(0)


def min_hits(domain: Column) -> Column:
    return F.when(domain == "history", 1).otherwise(2)


def offtopic(blob: Column, words: Column) -> Column:
    """Whether normalized text holds a pattern of sports news; words is its word_set(), or words_among() lists with these patterns."""
    single = single_words(OFFTOPIC)
    found = F.arrays_overlap(words, F.array(*[F.lit(t) for t in single]))
    for t in OFFTOPIC:
        if t not in single:
            # an optional character leaves what stands before it
            found = found | (F.contains(blob, F.lit(re.split(r".\?", t)[0])) & blob.rlike(bounded(t)))
    return found


def is_offtopic(text: Column) -> Column:
    blob = normalize_text(text)
    return offtopic(blob, word_set(blob))


def counted(docs: DataFrame, keywords: dict | None = None) -> DataFrame:
    """docs with the counts that the classifiers ask for, each made once: columns t_...

    Blobs and word sets are columns of their own, so that no expression is repeated in the branches above them.
    """
    c = F.col
    d = docs.withColumns({
        "t_head": normalize_text(c("title")),
        "t_body": normalize_text(c("text")),
        "t_link": F.lower(F.trim(text_or_empty(c("url")))),
    })
    # both parts are normalized already, so that the text is not gone through once more
    d = d.withColumn("t_blob", F.trim(F.concat_ws(" ", "t_head", "t_body")))
    told = [HEALTHCARE_CORE, FINANCE_NOISE, HISTORY_CORE, HISTORY_NOISE, TECH_TEXT, TECH_NOISE, HISTORY_STRUCTURE, OFFTOPIC]
    d = d.withColumns({"t_words": words_among(c("t_blob"), told), "t_head_words": words_among(c("t_head"), [TECH_TITLE, HISTORY_STRUCTURE, WALL_TITLE])})
    blob = lambda terms: count_terms(c("t_blob"), c("t_words"), terms)
    head = lambda terms: count_terms(c("t_head"), c("t_head_words"), terms)
    d = d.withColumns({
        "t_hits": blob_hits(c("t_blob"), c("domain"), keywords),
        "t_offtopic": offtopic(c("t_blob"), c("t_words")),
        "t_care": blob(HEALTHCARE_CORE),
        "t_finance": blob(FINANCE_NOISE),
        "t_past": blob(HISTORY_CORE),
        "t_past_noise": blob(HISTORY_NOISE),
        "t_tech_url": count_parts(c("t_link"), TECH_URL),
        "t_tech_title": head(TECH_TITLE),
        "t_tech_text": blob(TECH_TEXT),
        "t_tech_noise": blob(TECH_NOISE),
        "t_history_url": count_parts(c("t_link"), HISTORY_URL),
        "t_history_title": head(HISTORY_STRUCTURE),
        "t_history_text": blob(HISTORY_STRUCTURE),
        "t_wall_url": count_parts(c("t_link"), WALL_URL),
        "t_wall_title": head(WALL_TITLE),
        "t_wall_text": count_terms(c("t_body"), None, WALL_TEXT),
    })
    # words are counted where two phrases make the number matter
    return d.withColumn("t_n_words", F.when(c("t_wall_text") >= 2, word_count(c("text"))))


def news_relevant() -> Column:
    """Of counted() rows: domain hits, more of them for what looks like sports, and the domain's own evidence."""
    c, least = F.col, min_hits(F.col("domain"))
    healthy = (c("t_care") >= 2) & ~((c("t_finance") >= 4) & (c("t_care") <= 3))
    historic = (c("t_past") >= F.greatest(F.lit(1), least)) & ~((c("t_past_noise") >= 3) & (c("t_past") <= 3))
    own = F.when(c("domain") == "healthcare", healthy).when(c("domain") == "history", historic).otherwise(True)
    return (c("t_hits") >= least) & (~c("t_offtopic") | (c("t_hits") >= least + 1)) & own


def domain_relevant() -> Column:
    return F.col("t_hits") >= min_hits(F.col("domain"))


def tech_documentation() -> Column:
    """Of counted() rows: implementation documents, by address, title and text; no encyclopedia."""
    u, t, x, n = (F.col(f"t_tech_{k}") for k in ("url", "title", "text", "noise"))
    return (
        F.when(F.contains(F.col("t_link"), F.lit("wikipedia.org/wiki/")), False)
        .when((n >= 3) & (u + t == 0), False)
        .when((n >= 2) & (x <= 2), False)
        .when(u + t == 0, False)
        .when(x >= 2, True)
        .when((u >= 2) & (x >= 1) & (n == 0), True)
        .otherwise(False)
    )


def history_documentation() -> Column:
    """Of counted() rows: archival documents."""
    u, s, x = (F.col(f"t_history_{k}") for k in ("url", "title", "text"))
    h, n = F.col("t_past"), F.col("t_past_noise")
    return (
        F.when(F.contains(F.col("t_link"), F.lit("wikipedia.org/wiki/")), False)
        .when((n >= 3) & (u == 0) & (s == 0), False)
        .when(u >= 1, True)
        .when((s >= 1) & ((x >= 1) | (h >= 1)), True)
        .when(h >= 2, True)
        .otherwise(x >= 3)
    )


def is_interstitial() -> Column:
    """Of counted() rows: a challenge page, by address, by title, or by two phrases in at most 500 words."""
    c = F.col
    return (c("t_wall_url") > 0) | (c("t_wall_title") > 0) | ((c("t_wall_text") >= 2) & (c("t_n_words") <= 500))


def without_counts(docs: DataFrame) -> DataFrame:
    return docs.drop(*[c for c in docs.columns if c.startswith("t_")])


def is_docs_candidate(url: Column, allowed_hosts: list[str], blocked: list[str], hints: list[str]) -> Column:
    """Not blocked, and of an allowed host (or one under it) or with a hint in the address."""
    from quarry.functions.urls import host

    link, h = F.lower(F.trim(text_or_empty(url))), host(url)
    of_host = F.lit(False)
    for a in allowed_hosts:
        of_host = of_host | (h == a) | F.endswith(h, F.lit("." + a))
    return (count_parts(link, blocked) == 0) & (of_host | (count_parts(link, hints) > 0))


def count_terms_sql(x: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches({x}, '{term_pattern(t)}')::INT" for t in terms) + ")"


def count_parts_sql(x: str, parts: list[str]) -> str:
    return "(" + " + ".join(f"contains({x}, '{p}')::INT" for p in parts) + ")"
