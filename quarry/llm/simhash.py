"""SimHash near-dedup by tiled exact comparison.

Fingerprints come from numpy bit sums. Equal fingerprints collapse first. The others are laid out in tiles of
like population counts (of each half of the bits); a tile is compared with every tile whose counts allow a
distance within the radius, by exclusive-or and bit counts, and no other. A tile pair passes on a spanning
forest of the links that it finds, so that a group of n copies makes fewer than n links for each pair.

near.py groups near copies by the exact similarity of their shingles, where fingerprints only propose.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import SLICE_BYTES, arrow_batches, new_path, slices, staged
from quarry.llm.components import components
from quarry.llm.warc import open_shared

ONES = np.uint64(0x0101010101010101)
#: Fingerprints in a tile: at least, and at most (512 KB).
TILE = (2048, 65536)


def shingles(text: bytes | None, width: int) -> list[bytes]:
    """Space-joined runs of width words, repeats included; the whole sequence if it is shorter, none if there is no word.

    bytes.lower() changes A-Z only, and bytes.split() splits at \\x20 and \\x09-\\x0D only.
    """
    words = (text or b"").lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints (uint64) of consecutive runs of counts hashes: a bit is 1 if set in over half of a run; an empty run gives 0."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    counts = counts[full]
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    # a byte lane holds up to 255: runs are cut to pieces of 255
    pieces = -(-counts // 255)
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    at = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    found = np.zeros(len(full), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & ONES, at)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        over = (2 * sums > counts[:, None]).astype(np.uint8)
        found |= np.ascontiguousarray(over).view(np.uint64).ravel() << np.uint64(bit)
    out[full] = found
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp long) for each row; null and empty texts have fp 0. Other columns are not read."""
    arrow_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = partial(xxhash.xxh64_intdigest, seed=seed)
        for batch in batches:
            texts = batch.column(1)
            fps = np.zeros(len(texts), np.uint64)
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), SLICE_BYTES):
                found = [list(map(digest, shingles(t, width))) for t in texts.slice(a, b - a).to_pylist()]
                counts = np.array([len(x) for x in found], np.int64)
                hashes = np.fromiter((h for x in found for h in x), np.uint64, counts.sum())
                fps[a:b] = majority(hashes, counts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, fp long").select(F.col("id").alias(id_col), "fp")


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with at most radius differing bits, in strips of bounded size."""
    rows, cols = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius)
        if len(i):
            rows.append(i + at)
            cols.append(j)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64),) * 2


def forest(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels of n nodes after joining the links (i, j) to those of label: the least node of each component."""
    while True:
        li, lj = label[i], label[j]
        if (li == lj).all():
            return label
        low = np.minimum(li, lj)
        np.minimum.at(label, li, low)
        np.minimum.at(label, lj, low)
        while not np.array_equal(up := label[label], label):
            label = up


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between tiles a and b (uint64), or within a if b is None.

    Inside a tile pair, rows are grouped by the population counts of the four quarters, and group pairs
    whose counts differ by more than the radius are skipped as well.
    """
    every = a if b is None else np.concatenate((a, b))
    label = np.arange(len(every))
    quarter = lambda x: np.bitwise_count(x[:, None] >> np.array([0, 16, 32, 48], np.uint64) & np.uint64(0xFFFF)).astype(np.int64)

    def groups(x: np.ndarray, base: int):
        counts = quarter(x)
        key = counts @ np.array([1, 17, 289, 4913])
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        parts = np.split(order, cuts)
        return [(x[p], p + base) for p in parts], np.array([counts[p[0]] for p in parts])

    if not len(every):
        return every, every
    if len(a) * len(every) <= 1 << 18:
        ga, ca = [(a, np.arange(len(a)))], np.zeros((1, 4), np.int64)
        gb, cb = (ga, ca) if b is None else ([(b, np.arange(len(b)) + len(a))], ca)
    else:
        ga, ca = groups(a, 0)
        gb, cb = (ga, ca) if b is None else groups(b, len(a))
    for k, (x, at) in enumerate(ga):
        for m in np.flatnonzero(np.abs(cb - ca[k]).sum(axis=1) <= radius):
            if b is None and m < k:
                continue
            y, to = gb[m]
            step = max(1, (1 << 21) // max(1, len(y)))
            for s in range(0, len(x), step):
                i, j = _near(x[s : s + step], y, radius)
                if len(i):
                    label = forest(len(every), at[s : s + step][i], to[j], label)
    other = np.flatnonzero(label != np.arange(len(every)))
    return every[other], every[label[other]]


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join all fingerprints of the distinct table fps(fp) within radius, a forest for each tile pair.

    The driver holds the histogram of population counts only: at most 33 x 33 rows.
    """
    spark = fps.sparkSession
    low, high = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned("fp", 32))
    cells = fps.select("fp", low.alias("lo"), high.alias("hi"))
    size = {(r["lo"], r["hi"]): r["n"] for r in cells.groupBy("lo", "hi").agg(F.count("*").alias("n")).collect()}
    if not size:
        return spark.createDataFrame([], "a long, b long")
    per = min(max(TILE[0], math.isqrt(sum(size.values())) * 4), TILE[1])
    tiles = {c: -(-n // per) for c, n in size.items()}
    base, total = {}, 0
    for c in sorted(tiles):
        base[c], total = total, total + tiles[c]
    # a cell's tiles are numbered from its base; neighbours are cells at or after it in order
    near = [(c, d) for c in sorted(tiles) for d in sorted(tiles) if d >= c and abs(c[0] - d[0]) + abs(c[1] - d[1]) <= radius]
    cell = spark.createDataFrame([(*c, base[c], tiles[c]) for c in tiles], "lo int, hi int, base long, tiles int")
    tile = (
        cells.join(F.broadcast(cell), ["lo", "hi"])
        .select((F.col("base") + F.pmod(F.xxhash64("fp"), F.col("tiles"))).alias("tile"), "fp")
        .groupBy("tile")
        .agg(F.collect_list("fp").alias("fps"))
    )
    folder = new_path(spark, "tiles")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [uuid.uuid4().hex for _ in range(batch.num_rows)]
            for name, fps in zip(names, batch.column(1)):
                with open_shared(f"{folder}/{name}", "wb") as out:
                    out.write(np.asarray(fps.values).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names)], names=["tile", "name"])

    # a file a tile; pairs name tiles, so that no tile is moved with its pairs. A repeated task's extra files are named by no row
    tile = staged(tile.mapInArrow(save, "tile long, name string"), "tile-names")
    pairs = spark.createDataFrame([(base[c], tiles[c], base[d], tiles[d]) for c, d in near], "ba long, na int, bb long, nb int")
    pairs = (
        pairs.select("ba", "na", F.explode(F.sequence(F.col("bb"), F.col("bb") + F.col("nb") - 1)).alias("tb"))
        .select(F.explode(F.sequence(F.col("ba"), F.col("ba") + F.col("na") - 1)).alias("ta"), "tb")
        .where("ta <= tb")
    )
    work = pairs.join(tile.select(F.col("tile").alias("ta"), F.col("name").alias("a")), "ta")
    work = work.join(tile.select(F.col("tile").alias("tb"), F.col("name").alias("b")), "tb")
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # a task's pairs lie by their first tile, which is then read once
    work = work.select("a", "b").repartition(spread, "a", "b").sortWithinPartitions("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(name: str) -> np.ndarray:
            with open_shared(f"{folder}/{name}", "rb") as f:
                return np.frombuffer(f.read(), np.uint64)

        last, a = None, None
        for batch in batches:
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if one != last:
                    last, a = one, read(one)
                found = tile_links(a, None if one == two else read(two), radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], names=["a", "b"])

    return work.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits), component_id (the least id reachable by links).

    Documents link if their fingerprints differ in at most radius bits. Null and empty texts have fingerprint
    zero and link like any other. Ties and repeated rows share a component; null ids never become a
    component_id unless a component holds no other. Other columns are not read; an empty table gives an empty
    result.
    """
    every = staged(fingerprints(docs, id_col, text_col, width, seed).select(F.col(id_col).alias("id"), "fp"), "fingerprints")
    distinct = staged(every.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    root = components(near_links(distinct.select("fp"), radius))
    rooted = distinct.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return every.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
