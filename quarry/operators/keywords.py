"""Keyword pools and sizing rules, as generator expressions over small dimension rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.urls import unique_phrases

# What pads a pool that is too small.
FILLERS = ["overview", "guide", "analysis", "reference", "methods", "examples", "comparison", "best practices", "case study", "deep dive"]
ANCHORS = {"technical": "official documentation api reference guide", "academic": "systematic review and meta analysis methodology", "news": "breaking news update and impact analysis"}


def pool(base: Column, domain: Column, short: Column, long: Column, queries: Column) -> Column:
    """Base phrases, then each with the domain and with each hint, then the domain's queries with the first four hints; each once."""
    base = unique_phrases(base)
    both = lambda a, b: F.concat(a, F.lit(" "), b)
    with_hints = lambda k, hints: F.flatten(F.transform(hints, lambda h: F.array(both(k, h), both(both(domain, k), h))))
    one = F.flatten(F.transform(base, lambda k: F.concat(F.array(both(domain, k)), with_hints(k, short))))
    two = F.flatten(F.transform(base, lambda k: with_hints(k, long)))
    asked = F.flatten(F.transform(queries, lambda q: F.concat(F.array(q), F.transform(F.slice(short, 1, 4), lambda h: both(q, h)), F.transform(F.slice(long, 1, 4), lambda h: both(q, h)))))
    whole = unique_phrases(F.concat(base, one, two, asked))
    return F.when(F.size(base) > 0, whole).otherwise(F.array().cast("array<string>"))


def padded(pool_: Column, seeds: Column, kind: Column, least: Column) -> Column:
    """The pool, filled up to least phrases by seeds and fillers in turn, numbered from 1."""
    seeds = unique_phrases(F.when(F.size(seeds) > 0, seeds).otherwise(F.array(F.lit("research"))))
    fill = F.array(*[F.lit(f) for f in FILLERS])
    made = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), least)), lambda i: F.concat_ws(" ", F.get(seeds, (i - 1) % F.size(seeds)), kind, F.get(fill, (i - 1) % len(FILLERS)), F.lit("query"), i.cast("string")))
    missing = F.greatest(F.lit(0), least - F.size(pool_))
    fresh = F.filter(made, lambda m: ~F.exists(pool_, lambda p: F.lower(p) == F.lower(m)))
    return F.concat(pool_, F.slice(fresh, F.lit(1), missing))


def anchors(base: Column, domain: Column, kind: Column) -> Column:
    lead = F.coalesce(F.get(unique_phrases(base), 0), domain)
    tail = F.lit("in depth analysis and best practices")
    for name, text in ANCHORS.items():
        tail = F.when(kind == name, text).otherwise(tail)
    return unique_phrases(F.array(lead, F.trim(F.concat_ws(" ", domain, kind)), F.concat_ws(" ", domain, lead, tail)))


def expand(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Adds expanded: target phrases of the pool in an order by hash, then the domain's extras and anchors; each once."""
    c = F.col
    least = F.lit(250) + 15 * c("round") + F.when((c("kind") == "technical") & (c("domain") == "technology"), 120).otherwise(0) + F.when((c("kind") == "news") & (c("domain") == "history"), 60).otherwise(0)
    # each step is a column, as the next one asks for it more than once
    rows = rows.withColumn("__least", least).withColumn("__pool", pool(c("base"), c("domain"), c("short"), c("long"), c("queries")))
    rows = rows.withColumn("__whole", padded(c("__pool"), F.concat(c("base"), c("queries"), F.array("domain")), c("kind"), c("__least")))
    shuffled = F.transform(F.array_sort(F.transform(c("__whole"), lambda p: F.struct(F.xxhash64(F.lit(seed), p).alias("h"), p.alias("p")))), lambda x: x["p"])
    extras = F.array(*[F.concat(c("domain"), F.lit(e)) for e in (" research", " latest developments", " review article", " case study", " analysis")])
    return rows.withColumn("expanded", unique_phrases(F.concat(F.slice(shuffled, F.lit(1), c("__least")), extras, anchors(c("base"), c("domain"), c("kind"))))).drop("__least", "__pool", "__whole")


def strict_floor(target: Column) -> Column:
    """The least count that a collection must reach: 40 % of its target and 250, but never more than the target."""
    return F.least(target, F.greatest(F.lit(250), F.floor(target * 0.4).cast("int")))


def shortfall(n: Column, least: Column) -> Column:
    return F.greatest(F.lit(0), least - n)


def progress(n: Column, target: Column) -> Column:
    """Percentage to two decimals, 100 at most."""
    return F.round(F.least(F.lit(100.0), F.when(target > 0, 100.0 * n / target).otherwise(100.0)), 2)
