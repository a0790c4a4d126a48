"""Control of a collection: sizes, search queries, the budgeted union of news feeds, rounds, quotas, and what to do with existing data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import text_or_empty
from quarry.functions.urls import search_query
from quarry.operators.order import positions
from quarry.operators.quality import first_wins
from quarry.schema import lookup

# Words that news queries add by domain, and those that they exclude.
NEWS_ANCHORS = {
    "healthcare": "healthcare medical clinical hospital patient public health treatment",
    "technology": "technology software cloud cybersecurity ai digital platform",
    "history": "history historical archaeology heritage archive museum unesco artifact restoration",
}
NEWS_NEGATIVES = {
    "healthcare": "-bitcoin -crypto -semiconductor -chip -nasdaq -stock",
    "history": "-live -score -match -ipl -cricket -football -soccer -nba -nfl -boxoffice -celebrity",
}
# What web searches add to keyword and domain, by source type and domain.
SEARCH_PARTS = {
    ("technical", "technology"): ["official documentation", "developer documentation", "developer guide", "api reference", "sdk", "quickstart", "tutorial", "-wikipedia", "-news", "-finance"],
    ("technical", "history"): ['("archive catalog" OR "digital collection" OR manuscript OR "historical records" OR "museum collection" OR "primary source" OR "reference guide")', "-wikipedia", "-news", "-sports"],
    ("news", "history"): ["heritage", "archive", "museum", "archaeology", "repatriation", "historical records", "policy update", "-sports", "-score", "-match", "-site:support.google.com", "-site:maps.google.com", "-site:youtube.com", "-site:netflix.com", "-site:rottentomatoes.com"],
}
# Shares of the query bank by type, and the least share of time-sensitive queries.
QUOTAS = {"factual": 0.40, "analytical": 0.35, "comparative": 0.25}
TIME_SENSITIVE = 0.20


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def academic_size(primary: Column, target: Column) -> Column:
    """Documents asked of an academic source at a time, by the target."""
    share = lambda floor, by: F.greatest(F.lit(floor), F.floor(target / by))
    return F.when(primary == "wikipedia", clamp(share(12, 85), 10, 24)).when(primary == "pubmed", clamp(share(22, 35), 18, 45)).otherwise(clamp(share(20, 45), 16, 36)).cast("int")


def technical_size(target: Column) -> Column:
    return clamp(F.greatest(F.lit(16), F.floor(target / 40)), 12, 36).cast("int")


def web_target(size: Column) -> Column:
    return clamp(F.greatest(F.lit(12), size + 4), 18, 40).cast("int")


def refill_target(docs: Column) -> Column:
    return clamp(docs + 8, 14, 48).cast("int")


# By source type, domain and primary source ('' is any), after how many keywords without growth a
# collection has reached its plateau: (at most, at least, keywords for one more).
PLATEAUS = [
    ("technical", "technology", "", 12, 6, 80), ("technical", "history", "", 24, 14, 20), ("technical", "", "", 12, 8, 25), ("news", "history", "", 20, 14, 20),
    ("news", "", "", 10, 8, 14), ("academic", "", "wikipedia", 20, 8, 25), ("academic", "", "", 20, 10, 12), ("", "", "", 40, 12, 6),
]


def plateau_limit(source_type: Column, domain: Column, primary: Column, keywords: Column) -> Column:
    """How many keywords in a row may bring nothing new before a collection stops, by the number of its keywords; the first line of PLATEAUS that fits."""
    out = None
    for kind, dom, prime, most, least, per in PLATEAUS:
        fits = F.lit(True)
        for c, v in ((source_type, kind), (domain, dom), (primary, prime)):
            fits = fits if v == "" else fits & F.coalesce(F.lower(F.trim(c)) == v, F.lit(False))
        limit = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(keywords / per))).cast("int")
        out = F.when(fits, limit) if out is None else out.when(fits, limit)
    return out


def news_query(keyword: Column, domain: Column, negatives: bool = True) -> Column:
    """Keyword, the domain's anchors and, where asked, what it excludes."""
    key = F.lower(F.trim(text_or_empty(domain)))
    parts = [F.trim(text_or_empty(keyword)), lookup(NEWS_ANCHORS, key, "")] + ([lookup(NEWS_NEGATIVES, key, "")] if negatives else [])
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " ")


def collection_query(keyword: Column, domain: Column, source_type: Column) -> Column:
    """The web search query of a collection."""
    out = None
    for (kind, name), parts in SEARCH_PARTS.items():
        made = search_query(keyword, domain, *[F.lit(p) for p in parts])
        here = (source_type == kind) & (domain == name)
        out = F.when(here, made) if out is None else out.when(here, made)
    return out.otherwise(search_query(keyword, domain, source_type))


def merged_keywords(first: Column, second: Column) -> Column:
    """Both lists in order, each keyword once; case counts."""
    return F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))))


def news_union(found: DataFrame, size: int, mode: str = "rss", queries: int = 1, history: bool = False, least: int = 3) -> DataFrame:
    """Rows of found(keyword, provider, variant, seq, key) that a keyword's budget takes, with place and provider order.

    Modes: gdelt takes that feed first and some of both RSS feeds after; rss takes both RSS feeds, query variant
    by variant; hybrid adds gdelt where these are short of size. History in rss mode adds gdelt where fewer than
    least keys are left. Within a keyword the first row of a key stays, up to the mode's limit.
    """
    by = Window.partitionBy("keyword", "provider", "variant").orderBy("seq")
    rows = found.withColumn("nth", F.row_number().over(by))
    order = lambda c: F.struct(*c)
    c = F.col
    is_feed, feed = c("provider") == "gdelt", F.when(c("provider") == "google", 0).otherwise(1)
    if mode == "gdelt":
        most, some = max(10, min(40, size)), max(6, min(18, max(4, size // 4)))
        taken = rows.where((is_feed & (c("nth") <= most)) | (~is_feed & (c("variant") == 0) & (c("nth") <= some)))
        placed = taken.withColumn("place", order([F.when(is_feed, 0).otherwise(1).alias("a"), F.lit(0).alias("v"), feed.alias("f"), c("seq").alias("s")]))
        return _first_keys(placed, max(8, min(32, size)))
    each = max(6, min(25, max(4, size // 2)))
    if queries > 1:
        each = max(5, min(14, each))
    rss = rows.where(~is_feed & (c("variant") < queries) & (c("nth") <= each))
    count = rss.groupBy(c("keyword").alias("k")).agg(F.count("*").alias("have"))
    placed = lambda d, a: d.withColumn("place", order([F.lit(a).alias("a"), c("variant").cast("int").alias("v"), feed.alias("f"), c("seq").alias("s")]))
    taken = placed(rss, 0)
    gdelt = rows.where(is_feed)
    if mode == "hybrid":
        short = gdelt.join(count, c("keyword") == c("k"), "left").withColumn("have", F.coalesce("have", F.lit(0))).where(c("have") < size)
        extra = short.where(c("nth") <= F.greatest(F.lit(6), F.least(F.lit(20), F.lit(size) - c("have")))).drop("k", "have")
        taken = taken.unionByName(placed(extra, 1))
    done = _first_keys(taken, max(8, min(32, size)))
    if mode == "rss" and history:
        kept = done.groupBy(c("keyword").alias("k")).agg(F.count("*").alias("left"))
        few = found.select("keyword").distinct().join(kept, c("keyword") == c("k"), "left").where(F.coalesce("left", F.lit(0)) < least).select("keyword")
        extra = gdelt.join(few, "keyword", "left_semi").where(c("nth") <= max(6, min(40, size)))
        again = _first_keys(taken.join(few, "keyword", "left_semi").unionByName(placed(extra, 1)), max(10, min(40, size + 8)))
        done = done.join(few, "keyword", "left_anti").unionByName(again)
    return done


def _first_keys(rows: DataFrame, limit: int) -> DataFrame:
    """The first row of each key of a keyword, the first limit of them; rank counts from 1."""
    key = F.when(F.coalesce("key", F.lit("")) != "", F.concat_ws("\u0001", "keyword", "key"))
    kept = first_wins(rows.where(key.isNotNull()), key, [F.col("place")], "first").where("first").drop("first")
    rank = F.row_number().over(Window.partitionBy("keyword").orderBy("place"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limit).select("keyword", "provider", "variant", "seq", "key", "rank")


def collect_rounds(arrivals: DataFrame, target: int, plateau: int, key: str = "key") -> DataFrame:
    """Rows of arrivals(round, seq, key) that a collection takes until its target or a plateau.

    A round takes its first 3 * target rows; a key counts in its first round. The collection ends with the
    round that reaches 2 * target keys, or that is the last of so many rounds in a row without a new key, and
    keeps the first 2 * target keys by round and seq. Rounds are few: their counts are summed in one task.
    """
    c = F.col
    nth = F.row_number().over(Window.partitionBy("round").orderBy("seq"))
    rows = arrivals.withColumn("nth", nth).where(c("nth") <= 3 * target).drop("nth")
    fresh = first_wins(rows.where(c(key).isNotNull()), c(key), [c("round"), c("seq")], "first").where("first").drop("first")
    rounds = rows.groupBy("round").agg(F.lit(0).alias("zero")).drop("zero").join(fresh.groupBy("round").agg(F.count("*").alias("new")), "round", "left")
    rounds = rounds.withColumn("new", F.coalesce("new", F.lit(0)))
    order = Window.orderBy("round")
    dry = F.sum(F.when(c("new") == 0, 1).otherwise(0)).over(order.rowsBetween(-(plateau - 1), 0))
    told = rounds.withColumns({"sum": F.sum("new").over(order), "dry": dry, "no": F.row_number().over(order)})
    stop = told.where((c("sum") >= 2 * target) | ((c("dry") == plateau) & (c("no") >= plateau))).agg(F.min("round").alias("stop"))
    taken = fresh.join(F.broadcast(stop), c("stop").isNull() | (c("round") <= c("stop"))).drop("stop")
    # places by round first, so that no round's rows have to meet another's
    before = told.select(c("round").alias("r"), (c("sum") - c("new")).alias("before"))
    place = F.row_number().over(Window.partitionBy("round").orderBy("seq"))
    return taken.withColumn("in_round", place).join(F.broadcast(before), c("round") == c("r")).withColumn("place", c("before") + c("in_round")).where(c("place") <= 2 * target).drop("r", "before", "in_round")


def existing_policy(existing: DataFrame, fresh: DataFrame, key: str, policy: str, target: int) -> DataFrame:
    """What a collection holds afterwards: skip keeps what there is, recreate takes the fresh rows, fill adds keys that are missing, auto fills only below the target."""
    from quarry.streaming.increment import fill

    if policy == "auto":
        policy = "skip" if existing.count() >= target else "fill"
    return {"skip": lambda: existing, "recreate": lambda: fresh, "fill": lambda: fill(existing, fresh, key)}[policy]()


def query_bank(candidates: DataFrame, total: int) -> DataFrame:
    """Of candidates(domain, query_id, query_type, time_sensitive, risk), each domain's quota by type, in order of a hash, with enough of them time-sensitive.

    A query's id names it within its domain and type. Where fewer than a fifth are, queries of low or medium risk are promoted, in order of the hash as well.
    """
    c = F.col
    drawn = F.md5(F.concat_ws(":", "domain", "query_id"))
    quota = lookup({k: round(v * total) for k, v in QUOTAS.items()}, c("query_type"), 0)
    # candidates of a domain may be many; the bank, of total queries a domain at most, is not
    light = positions(candidates.select("domain", "query_type", "query_id", drawn.alias("drawn")), ["domain", "query_type"], ["drawn", "query_id"], "nth")
    bank = candidates.join(light.where(c("nth") < quota).select("domain", "query_type", "query_id"), ["domain", "query_type", "query_id"], "left_semi")
    have = bank.groupBy(c("domain").alias("d")).agg((F.floor(F.count("*") * TIME_SENSITIVE) - F.count_if("time_sensitive")).alias("need"))
    able = ~c("time_sensitive") & c("risk").isin("low", "medium")
    place = F.sum(able.cast("int")).over(Window.partitionBy("domain").orderBy(drawn, "query_id").rowsBetween(Window.unboundedPreceding, 0))
    both = bank.withColumn("place", place).join(F.broadcast(have), c("domain") == c("d"))
    return both.withColumn("promoted", able & (c("place") <= c("need"))).withColumn("time_sensitive", c("time_sensitive") | c("promoted")).drop("d", "need", "place")


def final_url(rows: DataFrame, url: str, redirects: DataFrame) -> DataFrame:
    """rows with final_url: the target inside a redirecting address, then where redirects(source, target) sends it, else the address itself."""
    from quarry.functions.urls import redirect_target

    first = F.coalesce(F.nullif(redirect_target(F.col(url)), F.lit("")), F.col(url))
    known = redirects.groupBy(F.col("source").alias("__source")).agg(F.min("target").alias("__target"))
    both = rows.withColumn("__first", first).join(known, F.col("__first") == F.col("__source"), "left")
    return both.withColumn("final_url", F.coalesce(F.nullif(F.col("__target"), F.lit("")), "__first")).drop("__first", "__source", "__target")
