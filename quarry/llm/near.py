"""Groups of near copies: SimHash proposes, exact Jaccard similarity of shingle sets decides, and no link is lost.

Fingerprints alone would lose pairs close to the bound, so candidates come from two sides. SimHash links (the
tiled comparison of simhash.py) propose rows with equal or close fingerprints. Prefix filtering proposes every
pair that shares two of the first shingles of both sets, rare ones first, which no pair at the bound can avoid.
A count sketch of each set, some thirty times smaller than the set, bounds the shingles that a pair can share
from above; only pairs that pass it have their sets fetched and compared. Pairs are taken in rounds, at first one
a row, and what a round joins is not compared again: sets moved for a group grow with its rows, not its pairs.

A list of very many rows is not taken pair by pair: its rows are compared with one of them, which joins the
copies of one text in a single pass. Only where rows of such lists are left in different groups, these are
compared in tiles, without pairs that are joined already. A tile is a file, which its pairs name.
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
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import SLICE_BYTES, arrow_batches, new_path, slices, staged
from quarry.llm.components import components
from quarry.llm.simhash import forest, majority, near_links, shingles
from quarry.llm.warc import open_shared

#: Repeated shingles whose counts every worker holds, the longest list of rows taken pair by pair, bytes of shingle hashes in a tile.
FREQUENT, LONG, TILE_BYTES = 1 << 19, 64, 4 << 20
#: Differing bits at which fingerprints propose a pair.
RADIUS = 2
#: Bytes of text in which repeated shingles are counted at a time.
COUNT_BYTES = 16 << 20
#: Among shingles that are not known to be frequent the least hashes come first, so those below this are counted across slices, in an eighth of the rows.
COUNTED = np.uint64(1 << 62)
#: By how much the pairs of a row that a round compares grow from round to round.
MORE = 8
#: Buckets of the filter that picks the rows whose sets are fetched; 32,768 to a bitmap.
PICK_BITS = 1 << 23
#: Guards comparisons of whole numbers with a fraction of others.
HAIR = 1e-9


def shingle_set(text: bytes | None, width: int, digest) -> np.ndarray:
    """Sorted distinct hashes (uint64) of a text's shingles; that of an empty run for a text without a word."""
    found = shingles(text, width) or [b""]
    return np.unique(np.fromiter(map(digest, found), np.uint64, len(found)))


def prefix(found: np.ndarray, common: np.ndarray, count: np.ndarray, similarity: float, shared: int = 1) -> np.ndarray:
    """The first shingles of a set, rare ones first: two sets whose Jaccard similarity reaches the bound share one of them, or so many.

    common (sorted) and count name the frequent shingles; any order serves that is the same for all sets.
    """
    n = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        n = np.where(common[at] == found, count[at], 0)
    return found[np.argsort(n, kind="stable")[: len(found) - math.ceil(similarity * len(found) - HAIR) + shared]]


def leading(size: int, similarity: float, shared: int = 1) -> int:
    """How many of a set's first shingles hold the first ones, so many, that it shares with a larger or equal set of that similarity."""
    return size - math.ceil(2 * similarity / (1 + similarity) * size - HAIR) + shared


def sketch(found: np.ndarray) -> bytes:
    """Counts of a sorted set's hashes by their first bits, a byte a bucket; empty, which bounds nothing, if one does not fit."""
    bits = max(0, math.ceil(math.log2(len(found) / 4)))
    counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found), np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_similar(a: bytes, b: bytes, sizes: int, similarity: float) -> bool:
    """False only if sets with these sketches, of so many shingles together, cannot reach the similarity."""
    if not a or not b:
        return True
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        y = y.reshape(len(x), -1).sum(axis=1)
    return int(np.minimum(x, y).sum()) >= similarity / (1 + similarity) * sizes - HAIR


def list_pairs(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, leads: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of lists of at most LONG rows, of postings sorted by key.

    Sizes must allow the similarity, and the key must be among the leading shingles of the smaller set: the
    first shingle that two similar sets share is.
    """
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    start, n = edge[:-1], np.diff(edge)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in np.unique(n[(n > 1) & (n <= LONG)]).tolist():
        at = start[n == k][:, None] + np.arange(k)
        i, j = np.triu_indices(k, 1)
        step = max(1, (1 << 20) // len(i))
        for s in range(0, len(at), step):
            a, b = at[s : s + step, i].ravel(), at[s : s + step, j].ravel()
            small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            lead = np.where(sizes[a] < sizes[b], leads[a], np.where(sizes[b] < sizes[a], leads[b], leads[a] & leads[b]))
            fit = lead & (small >= similarity * large - HAIR)
            a, b = ids[a[fit]], ids[b[fit]]
            out.append((np.minimum(a, b), np.maximum(a, b)))
    return tuple(np.concatenate(x) for x in zip(*out))


def gather(batches: Iterator[tuple], similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(long, a, b) of batches (key, id, size, lead) sorted by key: list_pairs(), and stars of the lists that are longer than LONG.

    Of the last list of a batch, which may go on in the next one, at most LONG rows are held; of a longer one, its centre.
    """
    held, star = None, None
    for batch in batches:
        if not len(batch[0]):
            continue
        if star is not None:
            more = int(np.searchsorted(batch[0], star[0], side="right"))
            if more:
                yield np.ones(more, bool), np.full(more, star[1]), batch[1][:more]
            if more == len(batch[0]):
                continue
            star, batch = None, [x[more:] for x in batch]
        whole = batch if held is None else [np.concatenate(x) for x in zip(held, batch)]
        edge = np.flatnonzero(np.concatenate(([True], whole[0][1:] != whole[0][:-1], [True])))
        for s, e in zip(edge[:-1], edge[1:]):
            if e - s > LONG:
                yield np.ones(e - s - 1, bool), np.full(e - s - 1, whole[1][s]), whole[1][s + 1 : e]
        s = edge[-2]
        held = [x[s:] for x in whole]
        if len(held[0]) > LONG:
            star, held = (whole[0][s], whole[1][s]), None
        a, b = list_pairs(*(x[:s] for x in whole), similarity)
        yield np.zeros(len(a), bool), a, b
    if held is not None:
        a, b = list_pairs(*held, similarity)
        yield np.zeros(len(a), bool), a, b


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets reaches the bound."""
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared) - HAIR


def set_links(a: list[np.ndarray], b: list[np.ndarray] | None, similarity: float, roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, by position, of the pairs of sets of tiles a and b, or within a, whose Jaccard similarity reaches the bound.

    Rows of equal roots are joined already, so they are neither compared nor linked.
    """
    sets = a if b is None else a + b
    base = 0 if b is None else len(a)
    label = np.arange(len(sets))
    if roots is not None:
        _, first, group = np.unique(roots, return_index=True, return_inverse=True)
        label = first[group]
    given = label.copy()
    size = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    edge = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(len(values), np.int64)
    for i in range(len(a)):
        # what is joined already need not be compared again
        first = i + 1 if b is None else base
        j = first + np.flatnonzero(label[first:] != label[i])
        j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - HAIR]
        if not len(j):
            continue
        own = flat[edge[i] : edge[i + 1]]
        mark[own] = 1
        at = np.repeat(edge[j] - np.concatenate(([0], np.cumsum(size[j])[:-1])), size[j]) + np.arange(size[j].sum())
        shared = np.add.reduceat(mark[flat[at]], np.concatenate(([0], np.cumsum(size[j])[:-1])))
        mark[own] = 0
        j = j[shared >= similarity * (size[i] + size[j] - shared) - HAIR]
        if len(j):
            label = forest(len(sets), np.full(len(j), i), j, label)
    joined = np.flatnonzero((label != given) & (given == np.arange(len(sets))))
    return joined, label[joined]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """(start, stop, texts) of slices of a batch (id, text)."""
    for a, b in slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), SLICE_BYTES):
        yield a, b, batch.column(1).slice(a, b - a).to_pylist()


def _frequent(rows: DataFrame, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted, counts) of shingles that repeat, the most frequent of them, a fixed number at most.

    Shingles of rows(id, t) are counted where they repeat within a slice, and hashes below COUNTED across slices in an
    eighth of the rows too. Counts only make an order, and any order loses no pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = partial(xxhash.xxh64_intdigest, seed=seed)
        held, some, size = [], [], 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            told = (n > 1) | np.isin(h, np.concatenate(some)) if some else n > 1
            return pa.RecordBatch.from_arrays([pa.array(h[told].view(np.int64)), pa.array(n[told])], names=["h", "n"])

        for batch in batches:
            eighth = np.asarray(batch.column(0)).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) < np.uint64(1 << 61)
            for a, b, texts in _texts(batch):
                sets = [shingle_set(t, width, digest) for t in texts]
                held += sets
                some += [s[s < COUNTED] for s, x in zip(sets, eighth[a:b]) if x]
                size += sum(len(t or b"") for t in texts)
                if size >= COUNT_BYTES:
                    yield counted()
                    held, some, size = [], [], 0
        if held:
            yield counted()

    counts = staged(rows.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "frequent")
    # counts by an eighth of a power of two: a few hundred rows tell from which count on they fit
    sizes = counts.groupBy(F.floor(8 * F.log2(F.col("n").cast("double"))).alias("b")).agg(F.count("*").alias("k"), F.min("n").alias("least"))
    cut, room = 1 << 62, FREQUENT
    for r in sizes.orderBy(F.desc("b")).collect():
        room -= r["k"]
        if room < 0:
            break
        cut = r["least"]
    found = counts.where(F.col("n") >= cut).toArrow()
    h, n = (np.array(found.column(c).to_numpy()) for c in ("h", "n"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], n[order]


def _read(rows: DataFrame, common, width: int, similarity: float, shared: int, seed: int) -> DataFrame:
    """(id, size, fp, heads, leads, sketch) of rows(id, t): the set's size, fingerprint and first shingles, how many of these lead, and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = partial(xxhash.xxh64_intdigest, seed=seed)
        hashes, counts = common.value
        for batch in batches:
            for a, b, texts in _texts(batch):
                sets = [shingle_set(t, width, digest) for t in texts]
                size = np.array([len(s) for s in sets], np.int32)
                heads = [prefix(s, hashes, counts, similarity, shared) for s in sets]
                edge = np.concatenate(([0], np.cumsum([len(x) for x in heads]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(heads).view(np.int64)))
                leads = np.array([leading(n, similarity, shared) for n in size.tolist()], np.int32)
                fps = majority(np.concatenate(sets), size.astype(np.int64)).view(np.int64)
                columns = [batch.column(0).slice(a, b - a), pa.array(size), pa.array(fps), lists, pa.array(leads), pa.array([sketch(s) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "fp", "heads", "leads", "sketch"])

    return rows.mapInArrow(run, "id long, size int, fp long, heads array<long>, leads int, sketch binary")


def _sets(rows: DataFrame, ids: DataFrame, width: int, seed: int) -> DataFrame:
    """(id, s) of the rows(id, t) named by ids(id), and of a few others.

    A filter of fixed size picks the rows where they are read, so that the texts of all others are not moved;
    the rows that it lets through in vain are dropped by the joins with their ids.
    """
    place = F.pmod(F.xxhash64("id"), F.lit(PICK_BITS)).alias("k")
    # bitmaps count numbers from one
    bit = F.col("k") + 1
    maps = ids.select(place).groupBy(F.bitmap_bucket_number(bit).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m"))
    bits = np.zeros((PICK_BITS >> 15, 4096), np.uint8)
    for r in maps.collect():
        bits[r["n"] - 1] = np.frombuffer(bytes(r["m"]), np.uint8)
    picked = rows.sparkSession.sparkContext.broadcast(bits.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = partial(xxhash.xxh64_intdigest, seed=seed)
        bit = picked.value
        for batch in batches:
            k = np.asarray(batch.column(2))
            batch = batch.filter(pa.array((bit[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool)))
            for a, b, texts in _texts(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([shingle_set(t, width, digest).tobytes() for t in texts], pa.binary())], names=["id", "s"])

    return rows.select("id", "t", place).mapInArrow(run, "id long, s binary")


def _held(pairs: DataFrame, side: DataFrame, columns: list[str]) -> DataFrame:
    """pairs(a, b) with columns of side(id) for both, named by the side."""
    for c in "ba":
        pairs = pairs.join(side.select(F.col("id").alias(c), *[F.col(x).alias(x + c) for x in columns]), c)
    return pairs


def _verified(pairs: DataFrame, read: DataFrame, rows: DataFrame, width: int, similarity: float, seed: int) -> DataFrame:
    """Links that join what the distinct pairs(a, b) link: those whose sketches allow the similarity and whose sets reach it.

    A round takes a few pairs of each b, and more from round to round; pairs that links join already are dropped.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (c.to_pylist() for c in batch.columns[2:])
            good = [may_be_similar(x, y, m + n, similarity) for x, y, m, n in zip(a, b, na, nb)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), similarity) for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    links, most = None, 1
    while True:
        place = F.row_number().over(Window.partitionBy("b").orderBy("a"))
        now = staged(pairs.withColumn("place", place).where(F.col("place") <= most).select("a", "b"), "round-pairs")
        sketched = _held(now, read, ["sketch", "size"]).select("a", "b", "sketcha", "sketchb", "sizea", "sizeb")
        left = staged(sketched.mapInArrow(bounded, "a long, b long"), "bounded-pairs")
        sets = staged(_sets(rows, left.select(F.explode(F.array("a", "b")).alias("id")), width, seed), "sets")
        found = staged(_held(left, sets, ["s"]).select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long"), "pair-links")
        links = found if links is None else links.union(found)
        pairs = staged(pairs.join(now, ["a", "b"], "left_anti"), "other-pairs")
        if pairs.isEmpty():
            return links
        roots = components(links)
        for c in "ab":
            pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left")
        pairs = staged(pairs.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b"), "open-pairs")
        if pairs.isEmpty():
            return links
        most *= MORE


def _tiled(left: DataFrame, rows: DataFrame, width: int, similarity: float, seed: int) -> DataFrame:
    """Links between rows of left(id, place, root) of one place and different roots, a forest for each pair of tiles.

    A root with many bytes has tiles of its own, which are not compared with each other; the others share tiles.
    """
    spark = rows.sparkSession
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sets = staged(_sets(rows, left.select("id"), width, seed).join(left, "id"), "tile-sets")
    size = F.sum(F.octet_length("s"))
    own = sets.groupBy("place", "root").agg(size.alias("bytes"))
    own = staged(own.select("place", "root", "bytes", (F.col("bytes") >= TILE_BYTES).alias("big")), "tile-roots")
    other = own.where(~F.col("big")).groupBy("place").agg(F.ceil(F.sum("bytes") / TILE_BYTES).alias("shared"))
    dealt = own.join(other, "place", "left")
    number = F.when(F.col("big"), F.pmod(F.xxhash64("id"), F.ceil(F.col("bytes") / TILE_BYTES))).otherwise(F.pmod(F.xxhash64("root"), F.col("shared")))
    tile = sets.join(dealt, ["place", "root"]).select("place", F.when(F.col("big"), F.col("root")).alias("of"), number.alias("tile"), F.struct("id", "s", "root").alias("row"))
    tile = tile.groupBy("place", "of", "tile").agg(F.collect_list("row").alias("rows"))
    tile = tile.select("place", "of", F.xxhash64("place", "of", "tile").alias("n"), "rows")
    folder = new_path(spark, "set-tiles")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [uuid.uuid4().hex for _ in range(batch.num_rows)]
            for name, found in zip(names, batch.column(3)):
                found = found.values
                sets = [x.as_buffer() for x in found.field("s")]
                with open_shared(f"{folder}/{name}", "wb") as out:
                    # rows, their ids, roots and sizes, then the sets one after another
                    for x in ([len(sets)], found.field("id"), found.field("root"), [x.size // 8 for x in sets]):
                        out.write(np.asarray(x, np.int64).tobytes())
                    for x in sets:
                        out.write(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.string())], names=["place", "of", "n", "name"])

    # a file a tile; pairs name tiles, so that no tile is moved with its pairs. A repeated task's extra files are named by no row
    tile = staged(tile.mapInArrow(save, "place long, of long, n long, name string"), "tile-names")
    one, two = (tile.select("place", *[F.col(x).alias(f"{x}{c}") for x in ("of", "n", "name")]) for c in "ab")
    pairs = one.join(two, "place").where("na < nb AND NOT (ofa IS NOT NULL AND ofa <=> ofb)").select("namea", "nameb")
    alone = tile.where("of IS NULL").select("name", F.col("name"))
    # a task's pairs lie by their first tile, which is then read once
    work = pairs.union(alone).repartition(spread, "namea", "nameb").sortWithinPartitions("namea")

    def unpack(name: str) -> tuple[np.ndarray, list, np.ndarray]:
        with open_shared(f"{folder}/{name}", "rb") as f:
            data = np.frombuffer(f.read(), np.int64)
        ids, roots, sizes = data[1 : 1 + 3 * data[0]].reshape(3, -1)
        return ids, np.split(data[1 + 3 * data[0] :].view(np.uint64), np.cumsum(sizes)[:-1]), roots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if x != last:
                    last, one = x, unpack(x)
                ids, a, roots = one
                b = None
                if x != y:
                    more, b, others = unpack(y)
                    ids, roots = np.concatenate((ids, more)), np.concatenate((roots, others))
                i, j = set_links(a, b, similarity, roots)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    return staged(work.mapInArrow(run, "a long, b long"), "tile-links")


def near_duplicate_groups(docs: DataFrame, row_col: str, text_col: str = "text", width: int = 5, similarity: float = 0.8, seed: int = 42) -> DataFrame:
    """(row_col, group): rows are grouped by links; group is the least row of its component. row_col is a distinct long.

    Rows link if the Jaccard similarity of their sets of shingles (by 64-bit hash) is similarity or more; none
    is estimated and none is missed. Null, empty and blank texts have no word and are alike; texts of under
    width words are one shingle; very long texts are taken whole; repeated rows link. Other columns are not read;
    an empty table gives an empty result. The driver and workers hold a fixed number of frequent shingles, a
    filter of fixed size, and the histogram of population counts of fingerprints.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(row_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    common = spark.sparkContext.broadcast(_frequent(rows, width, seed))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # above a half, sets that share one shingle only can be alike only if both have no other; these have equal fingerprints
    shared = 2 if similarity > 0.5 else 1
    read = staged(_read(rows, common, width, similarity, shared, seed), "near-read")

    # SimHash: rows of one fingerprint with the least of them, and the least rows of close fingerprints
    least = staged(read.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "near-fingerprints")
    close = near_links(least.select("fp"), RADIUS)
    for c in "ab":
        close = close.join(least.select(F.col("fp").alias(c), F.col("least").alias(f"l{c}")), c)
    equal = read.select("id", "fp").join(least.where("n > 1"), "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    proposed = equal.union(close.select(F.least("la", "lb"), F.greatest("la", "lb")))

    # prefix filtering
    postings = read.select("id", "size", "leads", F.posexplode("heads").alias("at", "h")).select("h", "id", "size", (F.col("at") < F.col("leads")).alias("lead"))
    postings = postings.repartition(parts, "h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in gather(([c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches), similarity):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["long", "a", "b"])

    # a pair that shares fewer in lists that are taken pair by pair shares one in a long list
    met = postings.mapInArrow(run, "long boolean, a long, b long").groupBy("long", "a", "b").agg(F.count("*").alias("n"))
    candidates = staged(met.where((F.col("n") >= shared) | F.col("long")).select("long", "a", "b"), "candidates")
    stars = candidates.where("long").select("a", "b")
    pairs = staged(proposed.union(candidates.select(F.least("a", "b"), F.greatest("a", "b"))).distinct(), "near-pairs")
    links = _verified(pairs, read, rows, width, similarity, seed)

    # long lists: what lies in one of them, or in several that share rows, has one place
    if not stars.isEmpty():
        place = components(stars).select(F.col("node").alias("id"), F.col("root").alias("place"))
        member = place.join(components(links).select(F.col("node").alias("id"), "root"), "id", "left").select("id", "place", F.coalesce("root", "id").alias("root"))
        member = staged(member, "places")
        open_ = member.groupBy("place").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("place")
        left = staged(member.join(staged(open_, "open-places"), "place", "left_semi").select("id", "place", "root"), "open-rows")
        if not left.isEmpty():
            links = links.union(_tiled(left, rows, width, similarity, seed))

    roots = components(links)
    named = rows.select("id").join(roots, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))
    named = staged(named, "near-roots")
    group = staged(named.groupBy("root").agg(F.min("id").alias("group")), "near-groups")
    return named.join(group, "root").select(F.col("id").alias(row_col), "group")
