"""Hard negatives for labelled vectors by exact blocked products.

Vectors become integers, whose products and sums are exact in float64 below 2^53. Anchors lie in blocks of
bounded size in the shared folder; every task holds a tile of candidates and multiplies it with one block of
anchors after another. The first pass keeps each anchor's best rows of its label in the tile, which merge with
those of other tiles; the second keeps the best rows of other labels in the window below each positive's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import arrow_batches, new_path, staged
from quarry.llm.blocks import read_block, save_blocks

#: Rows in a tile of candidates; numbers in a block of anchors or a tile; scores that are held at a time.
TILE_ROWS, BLOCK_NUMBERS, SCORES = 16_384, 1 << 20, 1 << 22
#: Integers up to this are exact in float64.
EXACT = 1 << 53


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, relabel: int, labels: int) -> DataFrame:
    """(row, id, label, vec array<long>) of the rows that take part; row tells rows with equal ids apart."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad)
    too_large = F.exists("x", lambda v: F.abs(v) >= F.lit(float(1 << 62) / scale))
    vec = F.when(too_large, F.raise_error(F.lit("a component is too large for 64-bit integers"))).otherwise(F.transform("x", lambda v: F.floor(v * scale).cast("long")))
    label = F.when(F.col("id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", label.alias("label"), vec.alias("vec"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column as an int64 matrix; shorter vectors are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices: float64 where that is exact, else Python integers, which raise beyond 64 bits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    if most[0] * most[1] * max(1, width) < EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    exact = a.astype(object) @ b.astype(object).T if width else np.zeros((len(a), len(b)), object)
    if exact.size and max(abs(exact.max()), abs(exact.min())) >= 1 << 63:
        raise OverflowError("a score is beyond 64 bits")
    return exact.astype(np.int64)


def top_rows(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row, equal ones by rising column; fewer if there are fewer columns."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        row, column = np.nonzero(scores >= least[:, None])
    else:
        row, column = map(np.ravel, np.indices(scores.shape))
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, id, label, vectors) of tiles of at most TILE_ROWS rows and about BLOCK_NUMBERS numbers, by label and id."""
    held: list[pa.RecordBatch] = []

    def tile():
        table = pa.Table.from_batches(held)
        row, ident, label = (table.column(c).to_numpy() for c in ("row", "id", "label"))
        order = np.lexsort((row, ident, label))
        return row[order], ident[order], label[order], matrix(table.column("vec"))[order]

    rows = numbers = 0
    for batch in batches:
        a = 0
        while a < batch.num_rows:
            widest = max(1, len(batch.column(3)[a]))
            part = batch.slice(a, max(1, min(TILE_ROWS - rows, BLOCK_NUMBERS // widest)))
            held.append(part)
            a, rows, numbers = a + part.num_rows, rows + part.num_rows, numbers + len(part.column(3).flatten())
            if rows >= TILE_ROWS or numbers >= BLOCK_NUMBERS:
                yield tile()
                held, rows, numbers = [], 0, 0
    if held:
        yield tile()


def best_positives(rows: DataFrame, blocks: list[str], folder: str, k: int) -> DataFrame:
    """(anchor, place, positive_id, positive_score): each anchor's k best other rows of its label, merged over all tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ident, label, vec in _tiles(batches):
            for name in blocks:
                block = read_block(folder, name)
                anchor, anchor_label = block.column("row").to_numpy(), block.column("label").to_numpy()
                anchors = matrix(block.column("vec"))
                for value in np.intersect1d(anchor_label, label):
                    a, b = np.searchsorted(label, value), np.searchsorted(label, value, side="right")
                    same = np.flatnonzero(anchor_label == value)
                    step = max(1, SCORES // (b - a))
                    for part in (same[i : i + step] for i in range(0, len(same), step)):
                        scores = products(anchors[part], vec[a:b])
                        # one place more, as an anchor's own row may stand among its best
                        i, j = top_rows(scores, k + 1)
                        other = row[a:b][j] != anchor[part][i]
                        i, j = i[other], j[other]
                        place = np.arange(len(i)) - np.searchsorted(i, i)
                        i, j = i[place < k], j[place < k]
                        yield pa.RecordBatch.from_arrays([pa.array(anchor[part][i]), pa.array(ident[a:b][j]), pa.array(scores[i, j].astype(np.int64))], names=["anchor", "positive_id", "positive_score"])

    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = rows.mapInArrow(run, "anchor long, positive_id long, positive_score long")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def windowed(scores: np.ndarray, low: list[int], high: list[int], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(window, columns) of the k highest scores from low to high, equal ones by rising column."""
    inside = np.flatnonzero((scores >= min(low)) & (scores <= max(high)))
    order = inside[np.argsort(-scores[inside], kind="stable")]
    falling = -scores[order]
    for w, (least, most) in enumerate(zip(low, high)):
        a = np.searchsorted(falling, -most)
        yield w, order[a : min(a + k, int(np.searchsorted(falling, -least, side="right")))]


def best_negatives(rows: DataFrame, blocks: list[str], folder: str, k: int, low: int, high: int) -> DataFrame:
    """(anchor, place, rank, negative_id, negative_score): rows of other labels with low% to high% of each positive's score, the k best merged over all tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, ident, label, vec in _tiles(batches):
            order = np.lexsort((row, ident))
            ident, label, vec = ident[order], label[order], vec[order]
            for name in blocks:
                block = read_block(folder, name)
                anchors = matrix(block.column("vec"))
                step = max(1, SCORES // len(ident))
                anchor, place, negative, score = [], [], [], []
                for a in range(0, len(anchors), step):
                    scores = products(anchors[a : a + step], vec)
                    part = block.slice(a, step)
                    for i, own, asked, reach in zip(range(step), part.column("label").to_pylist(), part.column("row").to_pylist(), part.column("scores").to_pylist()):
                        bounds = [(-((-low * s) // 100), (high * s) // 100) for s in reach]
                        other = np.flatnonzero(label != own)
                        seen = scores[i, other]
                        for w, hit in windowed(seen, [x for x, _ in bounds], [x for _, x in bounds], k):
                            anchor += [asked] * len(hit)
                            place += [w + 1] * len(hit)
                            negative.append(ident[other[hit]])
                            score.append(seen[hit].astype(np.int64))
                if anchor:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(place, pa.int32()), pa.array(np.concatenate(negative)), pa.array(np.concatenate(score))], names=["anchor", "place", "negative_id", "negative_score"])

    best = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = rows.mapInArrow(run, "anchor long, place int, negative_id long, negative_score long")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_every: int = 50, relabel: int = 7, labels: int = 10, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Rows with a null id or label, a null vector, or a null or non-finite component take no part. Where id is
    divisible by relabel, label becomes (label + 1) % labels. A component x becomes floor(scale * x); a score is
    the inner product of two such vectors, missing components of the shorter one counting as 0. Anchors are rows
    whose id is divisible by anchor_every. Of each anchor the positives best other rows of its label are taken,
    and for each of them the negatives best rows of other labels whose score is at least low and at most high per
    cent of the positive's. Higher scores come first, ties by smaller id. Rows that repeat an id are rows of their
    own, as candidates and as anchors. An anchor without a positive, and a positive without a negative, has no row.
    Components beyond 64-bit integers and scores beyond them raise an error. Other columns are not read; an empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    rows = staged(quantised(vectors, id_col, vector_col, label_col, scale, relabel, labels), "vectors")
    asked = staged(rows.where(F.col("id") % anchor_every == 0), "anchors")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("width")).first()
    held = max(1, min(1024, BLOCK_NUMBERS // max(1, size["width"] or 0)))
    tasks = max(1, -(-size["n"] // held))
    folder = new_path(spark, "anchors")
    found = staged(best_positives(rows, save_blocks(asked.repartition(tasks), folder, held), folder, positives), "positives")
    lists = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("x")).select("anchor", F.col("x.positive_score").alias("scores"))
    windows = asked.join(lists, asked["row"] == lists["anchor"]).select("row", "label", "vec", "scores").repartition(tasks)
    folder = new_path(spark, "windows")
    below = best_negatives(rows, save_blocks(windows, folder, held), folder, negatives, low, high)
    done = below.join(found, ["anchor", "place"]).join(asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
