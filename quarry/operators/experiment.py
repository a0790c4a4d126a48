"""From retrieved rows of queries to metrics by query and condition, and the frames that models are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import vectors
from quarry.operators.retrieval import six, stats
from quarry.schema import UNKNOWN_VOLATILITY, VOLATILITY_NAME, VOLATILITY_SCORE, conditions, lookup

#: What stands for similarities that are missing, their mean and their least.
NO_SIMILARITY, NO_LEAST = 0.1, 0.05


def diversity_index(rows: DataFrame, by: list[str], source: str) -> DataFrame:
    """(by..., sdi): Shannon entropy, in bits, of a group's sources; counts by group and source come first, so that a group is as many rows as it has sources."""
    n = rows.groupBy(*by, source).agg(F.count("*").alias("__n"))
    total = n.groupBy(*by).agg(F.sum("__n").alias("__t"), F.sum(F.col("__n") * F.log2(F.col("__n").cast("double"))).alias("__s"))
    # log2(total) less the mean of log2(count)
    return total.select(*by, six(F.log2(F.col("__t").cast("double")) - F.col("__s") / F.col("__t")).alias("sdi"))


def write_back(rows: DataFrame, measured: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """rows with measured(key..., names...) written into them, each metric only where the row has none yet; rows that were not measured stay as they are."""
    new = measured.select(*key, *[F.col(n).alias(f"__{n}") for n in names])
    both = rows.join(new, key, "left")
    filled = {n: F.coalesce(F.col(n), F.col(f"__{n}")) if n in rows.columns else F.col(f"__{n}") for n in names}
    return both.withColumns(filled).drop(*[f"__{n}" for n in names])


def existence(dimension: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, found, rows) of each key of dimension: whether rows has any, and how many, -1 where none."""
    got = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    return dimension.join(got, F.col(key) == F.col("__key"), "left").select(key, F.col("__n").isNotNull().alias("found"), F.coalesce("__n", F.lit(-1)).alias("rows"))


def fastest(timings: DataFrame, by: str, took: str) -> DataFrame:
    """(winner, mean): the group of least mean time, the first by name where it is shared; means come first, so that one row a group is compared."""
    m = timings.groupBy(by).agg(F.avg(took).alias("m"))
    return m.agg(F.min(F.struct("m", by)).alias("b")).select(F.col(f"b.{by}").alias("winner"), six(F.col("b.m")).alias("mean"))


def mean_freshness(freshness: Column) -> Column:
    """Mean over a set's rows; a missing value counts as 0."""
    return F.avg(F.coalesce(freshness, F.lit(0.0)))


def query_metrics(runs: DataFrame, k: int = 5) -> DataFrame:
    """(condition_id, query_id, precision_at_k, ndcg_at_k, avg_freshness, source_diversity, avg_similarity, min_similarity, relevant_doc_count, n_docs).

    runs has a row a retrieved document: condition_id, query_id, rank, similarity, relevant (0 to 1), freshness,
    source_name. A query holds its top documents only, so its rows fit in one group.
    """
    seen = F.sort_array(F.collect_list(F.struct("rank", F.coalesce("relevant", F.lit(0)).alias("relevant"), F.coalesce("source_name", F.lit("")).alias("source_name"))))
    g = runs.groupBy("condition_id", "query_id").agg(
        seen.alias("x"),
        six(mean_freshness(F.col("freshness"))).alias("avg_freshness"),
        six(F.coalesce(F.avg("similarity"), F.lit(NO_SIMILARITY))).alias("avg_similarity"),
        F.round(F.coalesce(F.min("similarity"), F.lit(NO_LEAST)), 6).alias("min_similarity"),
        F.count_if(F.col("relevant") >= 0.5).alias("relevant_doc_count"),
        F.count("*").alias("n_docs"),
    )
    labels = F.col("x.relevant")
    return g.select(
        "condition_id", "query_id", vectors.precision(labels, k).alias(f"precision_at_{k}"), vectors.ndcg(labels, k).alias(f"ndcg_at_{k}"), "avg_freshness",
        vectors.entropy(F.col("x.source_name")).alias("source_diversity"), "avg_similarity", "min_similarity", "relevant_doc_count", "n_docs",
    )


#: What is measured of a response.
RESPONSE = ["meteor", "hallucination_rate", "source_attribution"]


def response_metrics(pairs: DataFrame, by: list[str], response: str = "response", reference: str = "reference", passages: Column | None = None, sources: Column | None = None) -> DataFrame:
    """(by..., meteor, hallucination_rate, source_attribution) of pairs, a row a response, in one pass.

    passages is the array that claims are held against, the reference alone if not given; sources are the names
    that a response may tell, none if not given. A response that is null counts as empty.
    """
    from quarry.operators import evaluation

    rows = evaluation.meteor_batches(pairs, response, reference, "meteor")
    text = F.coalesce(F.col(response), F.lit(""))
    rate = evaluation.hallucination_rate(text, F.array(reference) if passages is None else passages)
    told = evaluation.source_attribution(text, F.array().cast("array<string>") if sources is None else sources)
    return rows.select(*by, "meteor", rate.alias("hallucination_rate"), told.alias("source_attribution"))


def condition_tree(per_query: DataFrame, names: list[str]) -> DataFrame:
    """(condition_id, n_records, metrics): metrics maps a metric's name to (mean, std, n), from one aggregate by condition."""
    parts = [c for n in names for c in stats(F.col(n), n)]
    flat = per_query.groupBy("condition_id").agg(F.count("*").alias("n_records"), *parts)
    tree = F.create_map(*[x for n in names for x in (F.lit(n), F.struct(F.col(f"{n}_mean").alias("mean"), F.col(f"{n}_std").alias("std"), F.col(f"{n}_n").alias("n")))])
    return flat.select("condition_id", "n_records", tree.alias("metrics"))


def condition_queries(bank: DataFrame) -> DataFrame:
    """(condition_id, query_id, domain): every query of bank(query_id, domain) for every condition of its domain; the twelve conditions are the side that is small."""
    dim = conditions(bank.sparkSession).select("condition_id", F.col("domain").alias("__domain"))
    return bank.join(F.broadcast(dim), F.lower(F.trim("domain")) == F.col("__domain")).select("condition_id", "query_id", "domain")  # twelve rows


def metric_mean(metric: str, tree: str = "metrics") -> Column:
    """A metric's mean out of the tree; null where the tree does not have it."""
    return F.try_element_at(F.col(tree), F.lit(metric))["mean"]


def with_metadata(rows: DataFrame) -> DataFrame:
    """rows(condition_id, ...) with domain, volatility, freshness_window and source_config of their condition; '' where it is unknown."""
    dim = conditions(rows.sparkSession).select("condition_id", "domain", lookup(VOLATILITY_NAME, F.col("domain")).alias("volatility"), F.col("freshness_label").alias("freshness_window"), F.col("source_configuration").alias("source_config"))
    both = rows.join(F.broadcast(dim), "condition_id", "left")  # twelve rows
    return both.withColumns({c: F.coalesce(c, F.lit("")) for c in dim.columns[1:]})


def condition_frame(tree: DataFrame, names: list[str]) -> DataFrame:
    """The wide frame for analysis of variance: metadata, n_records, and each metric's mean and deviation, 0 where missing."""
    part = lambda n, c: F.coalesce(F.try_element_at(F.col("metrics"), F.lit(n))[c], F.lit(0.0))
    wide = with_metadata(tree)
    return wide.select("condition_id", "domain", "volatility", "freshness_window", "source_config", "n_records", *[x for n in names for x in (part(n, "mean").alias(n), part(n, "std").alias(f"{n}_std"))])


def query_frame(per_query: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """The frame for models by query: factors, retrieval features, interactions, squares, and the targets that were measured.

    targets(condition_id, query_id, ...) are joined; one that was not measured is null and never made up.
    """
    v = lookup(VOLATILITY_SCORE, F.col("domain"), UNKNOWN_VOLATILITY).cast("double")
    rows = with_metadata(per_query).withColumn("domain_volatility", v).withColumnsRenamed({"avg_freshness": "freshness_score", "source_diversity": "source_diversity_index"})
    f, s, v = F.col("freshness_score"), F.col("source_diversity_index"), F.col("domain_volatility")
    rows = rows.withColumns({"fresh_x_diversity": f * s, "fresh_x_volatility": f * v, "source_x_volatility": s * v, "freshness_score_sq": f * f, "source_diversity_index_sq": s * s, "domain_volatility_sq": v * v})
    return rows if targets is None else rows.join(targets, ["condition_id", "query_id"], "left")


def zipped(rows: DataFrame, left: str, right: str, keep: list[str]) -> DataFrame:
    """(keep..., place, left, right): two lists side by side, as long as the shorter one."""
    n = F.least(F.size(left), F.size(right))
    both = F.arrays_zip(F.slice(F.col(left), F.lit(1), n).alias("a"), F.slice(F.col(right), F.lit(1), n).alias("b"))
    some = rows.where((F.size(left) > 0) & (F.size(right) > 0))
    return some.select(*keep, F.posexplode(both).alias("place", "x")).select(*keep, "place", F.col("x.a").alias(left), F.col("x.b").alias(right))


def stratum(domain: Column, config: Column) -> Column:
    """What folds are balanced over."""
    return F.concat(F.coalesce(domain, F.lit("")), F.lit("::"), F.coalesce(config, F.lit("")))


def encoded(rows: DataFrame, key: Column, out: str = "label") -> DataFrame:
    """rows with the number of their key among the sorted distinct keys, from 0; the keys are few."""
    from pyspark.sql import Window

    keyed = rows.withColumn("__k", key)
    number = keyed.select(F.col("__k").alias("__n")).distinct().withColumn(out, F.row_number().over(Window.orderBy("__n")) - 1)
    return keyed.join(number, F.col("__k").eqNullSafe(F.col("__n")), "left").drop("__k", "__n")


def gates(agreement: DataFrame, kappa: str, n: str, least: float = 0.70, samples: int = 480) -> DataFrame:
    """agreement with agrees (kappa reaches the bound), enough (so many samples) and passed, which is both."""
    agrees, enough = F.coalesce(F.col(kappa) >= least, F.lit(False)), F.col(n) >= samples
    return agreement.withColumns({"agrees": agrees, "enough": enough, "passed": agrees & enough})


def kappa_bundle(rows: DataFrame, a: str, b: str, by: list[str], labels: list[int]) -> DataFrame:
    """(by..., pair, n, kappa): raters against each other, each against the adjudicated score, and both pooled against it.

    Scores are cut to whole numbers; the adjudicated one is the mean, halves to even, from 1 to 5.
    """
    from quarry.operators.evaluation import adjudicated, cohen_kappa

    marked = rows.select(*by, F.col(a).cast("int").alias("x"), F.col(b).cast("int").alias("y"), adjudicated((F.col(a) + F.col(b)) / 2).alias("z"))
    pair = lambda name, p, q: marked.select(*by, F.lit(name).alias("pair"), F.col(p).alias("p"), F.col(q).alias("q"))
    every = pair("a_b", "x", "y").union(pair("a_adjudicated", "x", "z")).union(pair("b_adjudicated", "y", "z")).union(pair("pooled", "x", "z")).union(pair("pooled", "y", "z"))
    return cohen_kappa(every, "p", "q", labels, [*by, "pair"])


def profile_ranks(profiles: DataFrame, by: list[str], level: str, value: str, lower: Column) -> DataFrame:
    """profiles with their rank by metric: the largest value first, or the least where lower is better; ties by level."""
    from pyspark.sql import Window

    v = F.when(lower, F.col(value)).otherwise(-F.col(value))
    return profiles.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(v, level)))


def domain_means(frame: DataFrame, names: list[str]) -> DataFrame:
    """(domain, n_conditions, n_records, names...): means over a domain's conditions, each counting once; unknown domains are left out."""
    known = frame.where(F.col("domain") != "")
    return known.groupBy("domain").agg(F.count("*").alias("n_conditions"), F.sum("n_records").alias("n_records"), *[six(F.avg(n)).alias(n) for n in names])


def overview(frame: DataFrame, metric: str) -> DataFrame:
    """One row of all conditions: n_conditions, n_records, and the condition with the best mean of a metric, the first by id where it is shared."""
    best = F.min(F.struct((-F.col(metric)).alias("m"), F.col("condition_id").alias("id")))
    one = frame.agg(F.count("*").alias("n_conditions"), F.sum("n_records").alias("n_records"), F.countDistinct("domain").alias("n_domains"), best.alias("b"))
    return one.select("n_conditions", "n_records", "n_domains", F.col("b.id").alias("best_condition"), (-F.col("b.m")).alias(metric))
