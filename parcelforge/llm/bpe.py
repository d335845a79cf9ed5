"""Byte-pair encoding of a whole corpus with a rank queue of hierarchical bitmaps."""

from __future__ import annotations

import base64
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.engine import spread

VOCABULARY = os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD = 1024  # bits of a leaf of the bitmap
KEPT = 1 << 17  # pre-tokens whose ids a worker remembers
KEPT_CHARS = 48


class RankQueue:
    """Positions by rank; the lowest rank that holds any is found by two find-first-set steps."""

    __slots__ = ("top", "leaves", "buckets")

    def __init__(self, ranks: int):
        self.top = 0
        self.leaves = [0] * (ranks // WORD + 1)
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, position: int) -> None:
        held = self.buckets.get(rank)
        if held is None:
            self.buckets[rank] = [position]
            leaf = rank // WORD
            self.leaves[leaf] |= 1 << (rank % WORD)
            self.top |= 1 << leaf
        else:
            held.append(position)

    def take(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions, which leave the queue; positions that are stale by now are among them."""
        if not self.top:
            return None
        leaf = (self.top & -self.top).bit_length() - 1
        bits = self.leaves[leaf]
        low = bits & -bits
        self.leaves[leaf] = bits ^ low
        if bits == low:
            self.top ^= 1 << leaf
        rank = leaf * WORD + low.bit_length() - 1
        return rank, self.buckets.pop(rank)


class Encoder:
    """Ids of a text, without special tokens: strings that look like one are ordinary text."""

    def __init__(self, vocabulary: bytes):
        import regex

        self.ranks: dict[bytes, int] = {}
        for line in vocabulary.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.size = max(self.ranks.values(), default=0) + 1
        self.spelt = {r: b for b, r in self.ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.known: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall
        self.queue = RankQueue(self.size)

    def _rank(self, a: int, b: int) -> int:
        pair = (a, b)
        rank = self.pairs.get(pair)
        if rank is None:
            rank = self.ranks.get(self.spelt[a] + self.spelt[b], -1)
            if len(self.pairs) > 4 * KEPT:
                self.pairs.clear()
            self.pairs[pair] = rank
        return rank

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank, leftmost first, is merged until no pair has a rank.

        A merge makes only pairs of higher rank, so a taken bucket is complete; its positions are gone through from the
        left. An entry is stale if its symbol is gone or its pair has changed. Each merge costs a constant number of
        queue operations, whatever the length.
        """
        ranks, queue, rank_of = self.ranks, self.queue, self._rank
        symbols = [ranks[bytes((b,))] for b in piece]
        count = len(symbols)
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        current = [-1] * count  # rank of the pair that begins here
        for i in range(count - 1):
            r = rank_of(symbols[i], symbols[i + 1])
            if r >= 0:
                current[i] = r
                queue.put(r, i)
        while (taken := queue.take()) is not None:
            rank, positions = taken
            if len(positions) > 1:
                positions.sort()
            for i in positions:
                if current[i] != rank:
                    continue
                j = after[i]
                symbols[i] = rank
                symbols[j] = -1
                current[j] = -1
                k = after[i] = after[j]
                current[i] = -1
                if k < count:
                    before[k] = i
                    r = rank_of(rank, symbols[k])
                    if r >= 0:
                        current[i] = r
                        queue.put(r, i)
                h = before[i]
                if h >= 0:
                    r = rank_of(symbols[h], rank)
                    current[h] = r
                    if r >= 0:
                        queue.put(r, h)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known, ranks = self.known, self.ranks
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                whole = ranks.get(raw)
                ids = [whole] if whole is not None else self.merge(raw)
                if len(piece) <= KEPT_CHARS:
                    if len(known) >= KEPT:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(vocabulary: bytes) -> Encoder:
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary's bytes (under 1 MB, fixed) from the driver's copy, once per executor."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_ids(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of each text, in its row's partition; null and empty texts have the empty list."""
    import pyarrow as pa

    spelt = _vocabulary(df.sparkSession, vocabulary)

    def run(batches):
        encode = _encoder(spelt.value).encode
        for batch in batches:
            ids = [encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["_id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(f"`{id_col}`", f"`{text_col}`")).mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def token_counts(df: DataFrame, keep: list[str], text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns `keep` and tokens, the length of each text in tokens."""
    import pyarrow as pa

    spelt = _vocabulary(df.sparkSession, vocabulary)
    kinds = [df.schema[c].dataType.simpleString() for c in keep]
    places = [f"_k{i}" for i in range(len(keep))]

    def run(batches):
        encode = _encoder(spelt.value).encode
        for batch in batches:
            counts = [len(encode(t)) for t in batch.column(len(places)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(places))), pa.array(counts, pa.int64())], [*places, "tokens"])

    schema = ", ".join([*(f"{p} {k}" for p, k in zip(places, kinds)), "tokens bigint"])
    out = spread(df.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(keep, places)], F.col(f"`{text_col}`").alias("_text"))).mapInArrow(run, schema)
    return out.select(*[F.col(p).alias(c) for c, p in zip(keep, places)], "tokens")
