"""Token ids in binary files with Elias-Fano encoded document boundaries.

A shard is two files in the shared folder. `<name>.ids` is the concatenation of its documents' ids, little-endian,
in 2 bytes where the vocabulary allows it and 4 otherwise. `<name>.ef` has a line of JSON and two monotone
sequences in Elias-Fano form: the offset at which each document begins, with the end of the last, and the
documents' own ids. An element's low bits lie packed; its high bits are a one in a bit vector, at the high part
plus the element's place. Select finds the i-th one from a 32-bit sample of every 256th, so an offset costs
about 2 + log2(ids / documents) bits and no 64-bit table is kept.

Shards hold disjoint ascending ranges of document ids; a manifest row a shard tells its order and counts, from
which the offsets over all shards follow.
"""

from __future__ import annotations

import functools
import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm._common import arrow_batches, new_path, staged
from quarry.llm.warc import open_shared

#: Ones between two samples of a select structure; a multiple of 8, so that blocks of low bits begin at a byte.
SAMPLE = 256
#: A shard is closed beyond so many ids or documents; its offsets then fit 32-bit samples.
SHARD_IDS, SHARD_DOCS = 1 << 25, 1 << 20
#: Bytes of text that are encoded at a time, pieces that a worker remembers, bytes of a piece that is remembered.
TEXT_BYTES, PIECES, PIECE_BYTES = 8 << 20, 500_000, 64
#: Bytes of text in a partition, about.
PARTITION_BYTES = 32 << 20


class EliasFano:
    """A monotone sequence of unsigned 64-bit integers, with random access by select."""

    def __init__(self, n: int, low_bits: int, samples: np.ndarray, high: np.ndarray, low: np.ndarray):
        self.n, self.low_bits, self.samples, self.high, self.low = n, low_bits, samples, high, low

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """values: uint64, not falling; their high parts need n + max / 2**low_bits bits, fewer than 3 n + 2."""
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        # in steps, as the low bits are laid out one a byte before they are packed
        step, shifts = SAMPLE * 256, np.arange(low_bits, dtype=np.uint64)
        packed = [np.packbits(((values[a : a + step, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little") for a in range(0, n, step)] if low_bits else []
        return cls(n, low_bits, ones[::SAMPLE].astype(np.uint32), np.packbits(bits, bitorder="little"), np.concatenate([np.zeros(0, np.uint8), *packed]))

    def block(self, k: int) -> np.ndarray:
        """Elements k * SAMPLE and on, up to SAMPLE of them, as uint64."""
        a, count = k * SAMPLE, min(SAMPLE, self.n - k * SAMPLE)
        first = int(self.samples[k])
        stop = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[first >> 3 : (stop + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits[first & 7 :])[:count] + first
        high = (ones - a - np.arange(count)).astype(np.uint64)
        if not self.low_bits:
            return high
        at = a * self.low_bits >> 3
        low = np.unpackbits(self.low[at : at + (count * self.low_bits + 7) // 8], bitorder="little")[: count * self.low_bits].reshape(count, self.low_bits)
        return high << np.uint64(self.low_bits) | (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.block(i // SAMPLE)[i % SAMPLE])

    def __iter__(self) -> Iterator[np.ndarray]:
        """All elements, a block at a time."""
        return map(self.block, range(-(-self.n // SAMPLE)))

    def parts(self) -> list[bytes]:
        return [self.samples.astype("<u4").tobytes(), self.high.tobytes(), self.low.tobytes()]

    @classmethod
    def read(cls, n: int, low_bits: int, parts: list[bytes]) -> EliasFano:
        return cls(n, low_bits, np.frombuffer(parts[0], "<u4"), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], np.uint8))


def _side_tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte surely ends, and surely begins, a character that is not white space.

    White space beyond ASCII ends in the bytes left out of the first table and begins with those left out of the second.
    """
    before, after = np.zeros(256, bool), np.zeros(256, bool)
    before[0x21:0x7F] = before[0x80:] = after[0x21:0x7F] = after[0xC3:] = True
    before[[0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x80, 0x8B)]] = after[0xE1:0xE4] = False
    return before, after


BEFORE, AFTER = _side_tables()


class PieceEncoder:
    """Encodes texts with the tokenizers library, each distinct piece of a batch once.

    A space between two characters that are not white space always begins a word of a byte-level pre-tokenizer,
    so a text may be cut before it, and pieces repeat far more often than texts do. Pieces not met before are
    joined and encoded in one call; as every piece begins at a cut, the ids of the joined text fall apart into
    theirs by the bytes that ids stand for.
    """

    def __init__(self, path: str):
        # one thread a task: Spark has all cores at work
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        if any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"]):
            raise ValueError(f"special tokens must not reach over spaces: {path}")
        if any(t["content"].isalpha() for t in spec["added_tokens"]):
            raise ValueError(f"a special token of letters could stand in a word: {path}")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # the same model behind a split at spaces alone; space is the symbol that vocabulary files write for one
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.space = "\u0120"
        vocab = self.tokenizer.get_vocab(True)
        #: vocabulary files write a symbol a byte, but special tokens as they are
        special = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for s, i in vocab.items():
            self.size[i] = len(special[i].encode()) if i in special else len(s)
        self.known: dict[bytes, int] = {}
        self.begin, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ids(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(the pieces in another order, ids of all of them, number of ids of each).

        Pieces of a space and ASCII letters are one word each, so they go to the library's model without its
        pre-tokenizer; other pieces that may be joined go through all of it, and the rest one by one.
        """
        words, joined, alone = [], [], []
        for p in pieces:
            (words if p[0] == 32 and p[1:].isalpha() else joined if len(p) > 1 and p[0] == 32 and AFTER[p[1]] and BEFORE[p[-1]] else alone).append(p)
        found = []
        if words:
            found.append(self.bare.encode_batch_fast([b"".join(words).decode().replace(" ", " " + self.space)[1:]], add_special_tokens=False)[0].ids)
        if joined:
            found.append(self.tokenizer.encode_batch_fast([b"".join(joined).decode()], add_special_tokens=False)[0].ids)
        ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(x, np.uint32) for x in found]])
        whole = words + joined
        ends, cuts = np.cumsum(self.size[ids]), np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))
        upto = np.searchsorted(ends, cuts)
        if len(cuts) and (upto[-1] >= len(ends) or (ends[upto] != cuts).any()):
            raise ValueError("the ids of joined pieces do not fall apart at the pieces")
        counts = np.diff(upto + 1, prepend=0)
        if alone:
            one = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([p.decode() for p in alone], add_special_tokens=False)]
            ids, counts = np.concatenate((ids, *one)), np.concatenate((counts, [len(x) for x in one]))
        return whole + alone, ids, counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another, number of ids of each); null is empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-2] = (data[1:-1] == 32) & BEFORE[data[:-2]] & AFTER[data[2:]]
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.known]
        begin, flat, slot = self.begin, self.flat, self.known
        if new:
            new, ids, counts = self._ids(new)
            begin, flat = np.concatenate((begin, begin[-1] + np.cumsum(counts))), np.concatenate((flat, ids))
            local = dict(zip(new, range(len(self.begin) - 1, len(begin) - 1)))
            if len(slot) + len(new) <= PIECES and max(map(len, new)) <= PIECE_BYTES:
                slot.update(local)
                self.begin, self.flat = begin, flat
            else:
                # a memory that is full or would hold long pieces keeps what it can, one call of the library less next time
                fit = [p for p in new if len(p) <= PIECE_BYTES][: max(0, PIECES - len(slot))]
                rows = np.array([local[p] for p in fit], np.int64)
                sizes = begin[rows + 1] - begin[rows]
                self.flat = np.concatenate((self.flat, flat[_ranges(begin[rows], sizes)]))
                slot = {**{p: slot[p] for p in distinct if p in slot}, **local}
                self.known.update(zip(fit, range(len(self.begin) - 1, len(self.begin) - 1 + len(fit))))
                self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(sizes)))
        rows = np.fromiter(map(slot.__getitem__, distinct), np.int64, len(distinct))[pieces.indices.to_numpy()]
        sizes = begin[rows + 1] - begin[rows]
        ids = flat[_ranges(begin[rows], sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        # a text of no bytes has no piece
        return ids, np.diff(ends[np.searchsorted(cuts, offsets)])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of size[0] numbers, then those of start[1], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


class ShardWriter:
    """Writes one shard: ids as they come, and its boundaries and document ids at the end."""

    def __init__(self, folder: str, width: int):
        self.name, self.folder, self.width = uuid.uuid4().hex, folder, width
        self.out = open_shared(f"{folder}/{self.name}.ids", "wb")
        self.docs: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.ids = 0

    def add(self, docs: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.docs += docs
        self.sizes.append(sizes)
        self.ids += len(ids)

    def close(self) -> None:
        self.out.close()
        known = np.array([d for d in self.docs if d is not None], np.int64)
        base = int(known[0]) if len(known) else 0
        bounds = EliasFano.encode(np.concatenate(([0], np.cumsum(np.concatenate(self.sizes)))).astype(np.uint64))
        # differences of 64-bit integers fit 64 bits without a sign
        numbers = EliasFano.encode(known.view(np.uint64) - np.array(base, np.int64).view(np.uint64))
        parts = [x for s in (bounds, numbers) for x in s.parts()]
        head = {"width": self.width, "docs": len(self.docs), "ids": self.ids, "null_docs": len(self.docs) - len(known), "base": base, "low_bits": [bounds.low_bits, numbers.low_bits], "parts": list(map(len, parts))}
        with open_shared(f"{self.folder}/{self.name}.ef", "wb") as f:
            f.write(json.dumps(head).encode() + b"\n" + b"".join(parts))


class TokenShard:
    """A shard read back; a document's place is found by select, and only its ids are read."""

    def __init__(self, folder: str, name: str):
        self.path = f"{folder}/{name}.ids"
        with open_shared(f"{folder}/{name}.ef", "rb") as f:
            head, _, body = f.read().partition(b"\n")
        self.head = json.loads(head)
        ends = np.cumsum(self.head["parts"])
        parts = [body[b - n : b] for b, n in zip(ends.tolist(), self.head["parts"])]
        self.docs, self.nulls, self.width = self.head["docs"], self.head["null_docs"], self.head["width"]
        self.bounds = EliasFano.read(self.docs + 1, self.head["low_bits"][0], parts[:3])
        self.numbers = EliasFano.read(self.docs - self.nulls, self.head["low_bits"][1], parts[3:])

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.head["base"] + self.numbers[i - self.nulls]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, with the end id."""
        if not 0 <= i < self.docs:
            raise IndexError(i)
        start, stop = self.bounds[i], self.bounds[i + 1]
        with open_shared(self.path, "rb") as f:
            _skip(f, start * self.width)
            return np.frombuffer(f.read((stop - start) * self.width), f"<u{self.width}").astype(np.uint32)

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, offset in the shard, ids) in order, reading forward once."""
        numbers = (self.head["base"] + int(x) for block in self.numbers for x in block)
        start = None
        with open_shared(self.path, "rb") as f:
            i = 0
            for block in self.bounds:
                for stop in block.tolist():
                    if start is not None:
                        ids = np.frombuffer(f.read((stop - start) * self.width), f"<u{self.width}").astype("<u4")
                        if len(ids) != stop - start:
                            raise ValueError(f"{self.path} is shorter than its boundaries")
                        yield (None if i < self.nulls else next(numbers)), start, ids
                        i += 1
                    start = stop


def _skip(f, n: int) -> None:
    """Moves a stream forward, by a seek where it can."""
    if f.seekable():
        f.seek(n)
        return
    while n:
        n -= len(f.read(min(n, 1 << 20))) or n


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Encodes docs and writes shards in ascending order of id; returns their manifest (name, shard, first_doc, docs, ids, start).

    tokenizer is the path of a tokenizers JSON file, present on every worker; special tokens are not added, their
    strings in a text are those tokens; end_id follows each document. shard numbers the shards in order, and start
    is the number of ids before a shard's. Null ids come first; equal ids are ordered by a hash of their texts, so
    that a hot id goes over many tasks too. Null and empty texts have the end id only. Other columns are not read;
    an empty table gives an empty manifest. Files of lost or repeated tasks are named by no row.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), F.xxhash64(F.col(text_col)).alias("tie"))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // partition_bytes))
    ordered = rows.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "tie", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        width = 2 if len(encode.size) <= 1 << 16 and end_id < 1 << 16 else 4
        writer, seq, first = None, 0, None

        def closed() -> pa.RecordBatch:
            writer.close()
            cells = {"name": writer.name, "first_doc": first[0], "tie": first[1], "seq": seq, "docs": len(writer.docs), "ids": writer.ids}
            return pa.RecordBatch.from_pylist([cells], schema=pa.schema([("name", pa.string()), ("first_doc", pa.int64()), ("tie", pa.int64()), ("seq", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))

        for part in _by_bytes(batches):
            ids, sizes = encode.encode(part.column(2))
            # the end id after each document
            ids, sizes = np.insert(ids, np.cumsum(sizes), np.uint32(end_id)), sizes + 1
            at, numbers, ties = 0, part.column(0).to_pylist(), part.column(1)
            ends = np.cumsum(sizes)
            while at < len(sizes):
                if writer is None:
                    writer, first = ShardWriter(folder, width), (numbers[at], ties[at].as_py())
                before = int(ends[at - 1]) if at else 0
                # as many documents as the shard has room for; one at least, so that a longer one stands alone
                stop = int(np.searchsorted(ends, before + SHARD_IDS - writer.ids, side="right"))
                stop = min(stop, at + SHARD_DOCS - len(writer.docs))
                stop = at + 1 if stop <= at and not writer.docs else max(stop, at)
                if stop > at:
                    writer.add(numbers[at:stop], ids[before : ends[stop - 1]], sizes[at:stop])
                    at = stop
                if at < len(sizes) or writer.ids >= SHARD_IDS:
                    yield closed()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield closed()

    made = staged(ordered.mapInArrow(run, "name string, first_doc long, tie long, seq int, docs long, ids long"), "manifest")
    # one row a shard of millions of ids, so few rows meet in one task
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "tie", "seq", "name")
    start = F.coalesce(F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return staged(made.select("name", (F.row_number().over(order) - 1).alias("shard"), "first_doc", "docs", "ids", start.alias("start")), "shards")


def _by_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, tie, t) in batches of about TEXT_BYTES of text; a longer text stands alone."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(2)], np.int64)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), TEXT_BYTES - size, side="right")) + at)
            held.append(batch.slice(at, stop - at))
            size += int(sizes[at:stop].sum())
            at = stop
            if size >= TEXT_BYTES or at < batch.num_rows:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


def read_token_files(manifest: DataFrame, folder: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """One row a document of the shards of manifest: id_col, start, n_tokens, ids_crc32 and, if asked for, ids array<long>.

    start is the number of ids of all documents before; ids_crc32 is the unsigned CRC-32 of the document's ids as
    little-endian unsigned 32-bit integers. Each shard is read by one task, forward and once.
    """
    spark = manifest.sparkSession
    arrow_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs, starts, sizes, sums, ids, held = [], [], [], [], [], 0

                def out() -> pa.RecordBatch:
                    columns = [pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
                    if with_ids:
                        flat = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int64)
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat)))
                    return pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

                for doc, start, found in TokenShard(folder, name):
                    docs.append(doc)
                    starts.append(base + start)
                    sizes.append(len(found))
                    sums.append(zlib.crc32(found.tobytes()))
                    if with_ids:
                        ids.append(found)
                    held += len(found) if with_ids else 256
                    if held >= 1 << 21:
                        yield out()
                        docs, starts, sizes, sums, ids, held = [], [], [], [], [], 0
                if docs:
                    yield out()

    picked = manifest.select("name", "start")
    picked = picked.repartition(max(1, picked.count()))
    schema = "id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return picked.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def token_files_roundtrip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Writes the documents to token files in the shared folder and reads them back: id_col, start, n_tokens, ids_crc32."""
    folder = new_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, folder, id_col, text_col, end_id), folder, id_col, with_ids=False)
