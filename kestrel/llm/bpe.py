"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Adjacent symbols form a linked list; the queue has one bucket of list positions
per merge rank and a three-level bitmap over the buckets, so the next rank is
three find-first-set steps away however long the text is.  Entries whose pair
has changed meanwhile are stale and skipped when their bucket is drained.  The
list holds all distinct new pre-tokens of a slice side by side (a merge never
crosses a pre-token's end), so one drained bucket is one vectorised step.

Draining a whole bucket equals merging lowest rank first, leftmost first: a
token made at rank r cannot take part in a pair of rank below r in a vocabulary
whose tokens all encode to themselves, because that pair's parts would have
merged before r.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kestrel.llm.common import by_slices, texts_of

CACHE_ENTRIES = 400_000
CACHE_CHARS = 48


def _ascending(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


class RankQueue:
    """Buckets per rank under a bitmap of three levels, 64 children a node."""

    def __init__(self, n_ranks: int) -> None:
        if n_ranks > 64 ** 3:
            raise ValueError("three levels of 64 hold 262,144 ranks")
        self.low = [0] * ((n_ranks >> 6) + 1)
        self.mid = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        heads = ranks[np.concatenate(([0], cuts))].tolist()
        edges = [0, *cuts.tolist(), len(ranks)]
        for i, rank in enumerate(heads):
            bucket = self.buckets.get(rank)
            part = positions[edges[i]:edges[i + 1]]
            if bucket is not None:
                bucket.append(part)
                continue
            self.buckets[rank] = [part]
            self.low[rank >> 6] |= 1 << (rank & 63)
            self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank with entries, and its positions."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = (self.mid[a] & -self.mid[a]).bit_length() - 1 | a << 6
        rank = (self.low[b] & -self.low[b]).bit_length() - 1 | b << 6
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Vocabulary:
    """Ranks of a tiktoken file, with the pairs that merge into each token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.n = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.n
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        keys, made = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    made.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.made = np.append(np.array(made, np.int64)[order], -1)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens; -1 where they don't merge."""
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        if not n:
            return [b""] * len(pieces)
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        starts = (ends - sizes)[sizes > 0]
        nxt[ends[sizes > 0] - 1] = -1
        prv[starts] = -1
        rank_at = np.full(n, -1, np.int64)
        rank_at[:-1] = self.pair_ranks(ids[:-1], ids[1:])
        rank_at[nxt < 0] = -1
        alive = np.ones(n, bool)
        queue = RankQueue(self.n)
        first = np.flatnonzero(rank_at >= 0)
        queue.push(rank_at[first], first)
        while (entry := queue.pop()) is not None:
            rank, pos = entry
            pos = _ascending(pos[rank_at[pos] == rank])
            if len(pos) > 1:
                chained = nxt[pos[:-1]] == pos[1:]
                if chained.any():  # a run such as "aaaa": every other position merges
                    run = np.concatenate(([True], ~chained))
                    head = np.maximum.accumulate(np.where(run, np.arange(len(pos)), 0))
                    pos = pos[(np.arange(len(pos)) - head) % 2 == 0]
            if not len(pos):
                continue
            right = nxt[pos]
            after = nxt[right]
            ids[pos] = rank
            alive[right] = False
            rank_at[right] = -1
            nxt[pos] = after
            linked = after >= 0
            prv[after[linked]] = pos[linked]
            left = prv[pos]
            touched = _ascending(np.concatenate((pos, left[left >= 0])))
            follower = nxt[touched]
            fresh = np.where(follower >= 0, self.pair_ranks(ids[touched], ids[follower]), -1)
            rank_at[touched] = fresh
            queue.push(fresh[fresh >= 0], touched[fresh >= 0])
        made = ids[alive].astype("<u4").tobytes()
        upto = np.concatenate(([0], np.cumsum(alive)))
        cut = (upto[np.concatenate(([0], ends))] * 4).tolist()
        return [made[cut[i]:cut[i + 1]] for i in range(len(pieces))]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return Vocabulary({base64.b64decode(token): int(rank) for token, rank in pairs})


class Encoder:
    """Encodes texts; pre-tokens met before come from a bounded cache."""

    def __init__(self, path: str, pattern: str) -> None:
        self.vocabulary = load(path)
        self.find = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        cache, split, seen = self.cache, [], set()
        for text in texts:
            pieces = self.find(text)
            split.append(pieces)
            seen.update(pieces)
        misses = seen.difference(cache)
        if misses:
            vocabulary, parts = self.vocabulary, []
            for piece in misses:
                data = piece.encode()
                whole = vocabulary.ranks.get(data)
                if whole is None:
                    parts.append((piece, data))
                else:
                    cache[piece] = whole.to_bytes(4, "little")
            cache.update(zip([p for p, _ in parts], vocabulary.encode_pieces([d for _, d in parts])))
        out = [b"".join(map(cache.__getitem__, pieces)) for pieces in split]
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        else:
            for piece in misses:
                if len(piece) > CACHE_CHARS:
                    del cache[piece]
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text: ``key, ids array<int>``, one row per input row.

    A null or empty text has an empty array; repeated rows and null keys stay;
    other columns are left out, so their names cannot clash.
    """
    def make():
        enc = encoder(path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = enc.encode_batch(texts_of(batch))
            flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
            at = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), flat)],
                                              names=["key", "ids"])
        return work
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(by_slices(make), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode again, and digest both: ``key, n_tokens, ids_sha256,
    decoded_sha256``, one row per input row (null text: empty).  Repeated rows have equal
    digests; an empty table gives no rows; extra columns are left out."""
    def make():
        enc = encoder(path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = enc.encode_batch(texts_of(batch))
            hexes = [hashlib.sha256(i).hexdigest() for i in ids]
            back = [hashlib.sha256(enc.vocabulary.decode(i)).hexdigest() for i in ids]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(hexes, pa.string()),
                 pa.array(back, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])
        return work
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    out = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(by_slices(make), out).withColumnRenamed("key", key)


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, data binary``: the bytes of each id array (null array: empty)."""
    def make():
        vocabulary = load(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            data = [vocabulary.decode(np.array(i or [], "<u4").tobytes()) for i in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["key", "data"])
        return work
    rows = tokens.select(tokens[key].alias("key"), tokens[ids].alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(by_slices(make, "ids"), f"key {kind}, data binary").withColumnRenamed("key", key)
