"""Encoding of a corpus with a public byte-level BPE vocabulary.

Two tiers. A pre-token (a match of the vocabulary's split pattern) that is itself a vocabulary entry is resolved by a minimal
perfect hash: one 64-bit hash, one displacement, one comparison. All others are merged with a heap of candidate pairs over a
linked list of bytes, O(n log n) in the length of the pre-token, so that a megabyte without a blank is no special case.
Python runs once per Arrow batch (``mapInArrow``); no shuffle, one narrow pass over ``text`` only.

Defined results: an empty text and a null text have the empty list (length 0). Damaged or unusual characters are encoded by
their UTF-8 bytes like all others; strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern that belongs to the byte_bpe vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens a worker remembers; beyond that it starts anew, which changes speed and no result.
MEMO = 400_000
_MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash from ``n`` distinct byte strings onto 0..n-1 (hash, displace; lone keys take a slot directly)."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        self.n = n = len(keys)
        self.buckets = b = max(1, n // per_bucket)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        if len(set(hashes)) != n:
            raise ValueError("keys must be distinct")
        groups: list[list[int]] = [[] for _ in range(b)]
        for i, h in enumerate(hashes):
            groups[h % b].append(i)
        self.shift = [0] * b
        slot_of, taken, free = [0] * n, bytearray(n), 0
        for g in sorted(range(b), key=lambda g: -len(groups[g])):
            own = groups[g]
            if not own:
                break
            if len(own) == 1:
                while taken[free]:
                    free += 1
                self.shift[g] = -1 - free
                slots = [free]
            else:
                d = 0
                while True:
                    slots = [self._mix(hashes[i], d) % n for i in own]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.shift[g] = d
            for i, s in zip(own, slots, strict=True):
                slot_of[i] = s
                taken[s] = 1
        self.keys: list[bytes] = [b""] * n
        self.ids = [0] * n
        for i, s in enumerate(slot_of):
            self.keys[s], self.ids[s] = keys[i], i

    @staticmethod
    def _mix(h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
        return ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & _MASK) >> 11

    def get(self, key: bytes) -> int:
        """Index of ``key`` in the list it was built from, -1 if it isn't in it."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -1 - d if d < 0 else self._mix(h, d) % self.n
        return self.ids[s] if self.keys[s] == key else -1


class BytePairEncoder:
    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        keys = list(self.ranks)
        self.hash = PerfectHash(keys)
        self.rank_of = [self.ranks[k] for k in keys]
        self.pattern = pattern
        self.find = regex.compile(pattern).findall

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "find"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.find = regex.compile(self.pattern).findall

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token by repeatedly joining the neighbours of lowest rank, leftmost first."""
        n, ranks = len(piece), self.ranks
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if end[i] < 0:
                continue
            j = after[i]
            if j >= n or end[j] != stop:
                continue  # one of the two has been joined with another since
            end[i], end[j] = stop, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def piece(self, token: str) -> tuple[int, ...]:
        raw = token.encode("utf-8", "surrogatepass")
        at = self.hash.get(raw)
        return (self.rank_of[at],) if at >= 0 else self.merge(raw)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.piece, self.find(text)))) if text else []


class _Memo(dict):
    """Pre-token to ids (or to their number), filled on demand and bounded."""

    def __init__(self, encoder: BytePairEncoder, counts: bool):
        self.encoder, self.counts = encoder, counts

    def __missing__(self, token: str):
        ids = self.encoder.piece(token)
        value = len(ids) if self.counts else ids
        if len(token) <= 64:  # a long run rarely comes again
            if len(self) >= MEMO:
                self.clear()
            self[token] = value
        return value


_built: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> BytePairEncoder:
    """The encoder of a vocabulary file, built once per process."""
    if (vocabulary, pattern) not in _built:
        with open(vocabulary, "rb") as f:
            _built[vocabulary, pattern] = BytePairEncoder(f.read(), pattern)
    return _built[vocabulary, pattern]


def encode_batches(batches: Iterable[pa.RecordBatch], encoder: BytePairEncoder, counts: bool, slices: int = 512) -> Iterator[pa.RecordBatch]:
    """Key column and text column in; key and ids (or their number) out, in slices that keep memory flat."""
    memo = _Memo(encoder, counts)
    get, find = memo.__getitem__, encoder.find
    for batch in batches:
        for start in range(0, batch.num_rows, slices):
            part = batch.slice(start, slices)
            names = [part.schema.field(0).name, "n_tokens" if counts else "ids"]
            texts = part.column(1).to_pylist()
            if counts:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sum(map(get, find(t))) if t else 0 for t in texts], pa.int64())], names)
                continue
            values, ends = [], np.zeros(len(texts) + 1, np.int32)
            for k, t in enumerate(texts):
                ids = np.fromiter(chain.from_iterable(map(get, find(t))), np.int32) if t else np.zeros(0, np.int32)
                values.append(ids)
                ends[k + 1] = ends[k] + len(ids)
            flat = np.concatenate(values) if values else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names)


def _mapped(df: DataFrame, key: str, text: str, vocabulary: str, counts: bool) -> DataFrame:
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(encoder(vocabulary))  # a few MB, fixed by the vocabulary and not by the corpus

    def run(batches):
        return encode_batches(batches, shared.value, counts)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens bigint" if counts else "ids array<int>"))


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, ids array<int>`` of every row, without special tokens; ``[]`` for empty and null texts. Other columns are not read."""
    return _mapped(df, key, text, vocabulary, False)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key, n_tokens bigint`` of every row; 0 for empty and null texts. Ids are never built."""
    return _mapped(df, key, text, vocabulary, True)


def size_class(n: Column) -> Column:
    """Power-of-two class of a token count, for profiles: 0, 1, 2, 4, 8 ..."""
    return F.when(n > 0, F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double")))).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
