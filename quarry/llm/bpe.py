"""Byte-level BPE encoding and decoding with a contiguous rank array.

A short word's parts are held as two parallel arrays: the boundaries, and the rank of each pair of
neighbouring parts. The minimum is found by scanning, a boundary is deleted, and the ranks beside it are
looked up again. Words repeat, so each worker keeps the ids of the words it has met.
"""

from __future__ import annotations

import functools
import heapq
import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._common import arrow_batches

#: Fixed value: the published pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers at most; when full it starts anew, which changes no result.
MEMORY = 400_000
NO_RANK = 1 << 60


def byte_symbols() -> dict[str, int]:
    """The printable symbol that vocabulary files write for each byte: itself if printable, else from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A tokenizer read from a tokenizers JSON file: byte-level, no normaliser, no prefix space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"not a plain byte-level BPE: {path}")
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (left id, right id) -> rank, and the id of the merged part by rank
        self.pairs, self.merged = {}, []
        for rank, (left, right) in enumerate(merges):
            a, b = raw(left), raw(right)
            self.pairs.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        self.first = [vocab[bytes([b])] for b in range(256)]
        self.bytes_of = {i: s for s, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word, by repeated scans of its rank array."""
        first, rank_of, merged = self.first, self.pairs.get, self.merged
        parts = [first[b] for b in word]
        ranks = [rank_of(p, NO_RANK) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NO_RANK:
                break
            at = ranks.index(best)
            parts[at] = left = merged[best]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], left), NO_RANK)
            if at < len(ranks):
                ranks[at] = rank_of((left, parts[at + 1]), NO_RANK)
        return parts

    def long_word(self, word: bytes) -> list[int]:
        """Ids of a word of any length in O(n log n): the same merges, the minimum from a heap over linked parts."""
        parts: list[int] = [self.first[b] for b in word]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := self.pairs.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        end = len(parts)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= end or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = self.merged[rank], -1, after[j]
            if after[i] < end:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < end and (r := self.pairs.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[b]))
        return [p for p in parts if p >= 0]

    def _chunk(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for word in self.words.findall(chunk):
            found = self.known.get(word)
            if found is None:
                raw = word.encode("utf-8", "surrogatepass")
                found = self._remember(word, self.merge(raw) if len(raw) <= 256 else self.long_word(raw))
            ids += found
        return ids

    def _remember(self, piece: str, ids: list[int]) -> list[int]:
        """Words and pieces share one memory; a word alone is cut into itself, so both mean the same."""
        if len(piece) <= 200:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def _plain(self, text: str, out: list[list[int]]) -> None:
        """Appends the ids of text, which holds no special token.

        A space between two other characters that are not white space always starts a word, so text may be
        cut there; the pieces repeat far more often than texts do.
        """
        pieces = text.split(" ")
        known = self.known
        head = True
        held = ""
        for piece in pieces:
            if head:
                held, head = piece, False
                continue
            if held and piece and not held[-1].isspace() and not piece[0].isspace():
                ids = known.get(held)
                if ids is None:
                    ids = self._learn(held)
                out.append(ids)
                held = " " + piece
            else:
                held += " " + piece
        if held:
            ids = known.get(held)
            out.append(self._learn(held) if ids is None else ids)

    def _learn(self, piece: str) -> list[int]:
        return self._remember(piece, self._chunk(piece))

    def encode(self, text: str | None) -> list[int]:
        """Ids of text; None is empty. A special token's string is that token."""
        if not text:
            return []
        out: list[list[int]] = []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append([self.special[part]])
            elif part:
                self._plain(part, out)
        return [i for ids in out for i in ids]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, ids array<int>, decoded string.

    tokenizer is the path of a tokenizers JSON file, present on every worker. Null and empty texts have no
    ids and decode to an empty text. Repeated rows and ids give a row each; other columns are not read; an
    empty table gives an empty result.
    """
    arrow_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = picked.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], names=["id", "ids", "decoded"])

    return picked.mapInArrow(run, f"id {kind.simpleString()}, ids array<int>, decoded string").select(F.col("id").alias(id_col), "ids", "decoded")


def bpe_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """As bpe_encode, but with n_tokens and the digests of the ids and of the decoded text; keep: columns to pass on.

    The digests are taken where the ids are made, so that ids and decoded texts don't travel.
    """
    arrow_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__t"), *[F.col(c) for c in keep])
    names = [f.name for f in picked.schema if f.name != "__t"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "__t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        number = [str(i) for i in range(max(bpe.bytes_of) + 1)]
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join([number[i] for i in ids]).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
            kept = [batch.column(i) for i in range(batch.num_columns) if i != 1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    done = picked.mapInArrow(run, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return done.withColumnRenamed("__id", id_col)
