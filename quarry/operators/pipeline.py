"""A collection from raw records to its saved final table, with counters that come from the same passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import quality
from quarry.operators.order import positions
from quarry.storage import new_path
from quarry.streaming.increment import read_stage, save_stage


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written once, so that what observes it sees each row once."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collect(raw: DataFrame, base: str, as_of: str, keywords: dict | None = None, target: int | None = None, seq: str = "seq") -> DataFrame:
    """Runs raw records through cleaning, removal of duplicates, final fields, the quality cascade and the cut to target rows a collection, and saves the cleaned and final tables under base; returns (stage, n).

    seq names a row and is the order in which records win; a collection is a domain and source type. Stages are
    raw, cleaned, deduplicated, each reason of the cascade with what it drops, quality, and final. Texts are
    written twice (cleaned, final); in between only ids, keys and reasons move, and every count is observed while
    its rows are written, so that no count is a job of its own.
    """
    counts: dict[str, int] = {}
    seen, clean = Observation("raw"), Observation("cleaned")
    n = F.count(F.lit(1)).alias("n")
    save_stage(quality.clean_data(raw.observe(seen, n), as_of, keywords).observe(clean, n), base, "cleaned")
    counts["raw"], counts["cleaned"] = seen.get["n"], clean.get["n"]
    rows = read_stage(raw.sparkSession, base, "cleaned").drop("collection")
    # a digest stands for title and start, so that texts stay where they are
    start = text.normalize_text(F.concat_ws(" ", text.text_or_empty(F.col("title")), F.substring(text.text_or_empty(F.col("text")), 1, 500)))
    keys = _kept(rows.select(seq, F.sha2(start, 256).alias("key")), "starts")
    alone = Observation("deduplicated")
    first = _kept(quality.first_wins(keys, F.col("key"), [F.col(seq)], "first").where("first").select(seq).observe(alone, n), "first")
    counts["deduplicated"] = alone.get["n"]
    # metadata was filled when the rows were cleaned
    finished = quality.with_freshness(rows.join(first, seq, "left_semi"), as_of)
    judged = Observation("quality")
    reasons = quality.quality_reasons(finished, keywords, clean=False, seq=seq).observe(judged, *[F.count_if(F.col("reason") == r).alias(r) for r in quality.REASONS], F.count_if(F.col("reason").isNull()).alias("quality"))
    reasons = _kept(reasons, "reasons")
    counts |= {k: judged.get[k] for k in (*quality.REASONS, "quality")}
    passed = reasons.where("reason IS NULL").select(seq, "domain", "source_type")
    chosen = passed if target is None else positions(passed, ["domain", "source_type"], [seq], "place").where(F.col("place") < target)
    last = Observation("final")
    save_stage(finished.join(chosen.select(seq), seq, "left_semi").observe(last, n), base, "final")
    counts["final"] = last.get["n"]
    return raw.sparkSession.createDataFrame(list(counts.items()), "stage string, n long")
