"""Byte-level BPE: encoding by ranks and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves a pre-token that is a token as it stands, with one
probe and one comparison. Any other pre-token is merged: a heap of (rank, position) over doubly linked bytes,
lowest rank first and the leftmost of equals, in O(n log n) whatever its length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from quarry.llm.common import fold, per_row

#: Chunks whose ids a worker remembers; then it starts afresh, which changes no result.
REMEMBERED = 400_000
#: White space as Unicode has it (fixed values).
BLANK = "\t-\r \x85\xa0  -     　"
#: Text between white space, with the one space before it; or white space. Pre-tokens never cross the borders of
#: these chunks, so a chunk's ids depend on the chunk alone.
CHUNK = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
#: The split pattern for which that holds (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@dataclass(frozen=True)
class PerfectHash:
    """Hash and displace: the keys of a bucket share a displacement that sends each to a slot of its own."""

    displace: list[int]
    keys: list[bytes]
    values: list[int]

    @staticmethod
    def marks(key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF, (h >> 64) & 0xFFFFFFFF

    @staticmethod
    def slot(start, step, d, n):
        """The place of a key at displacement d < 2**24; of integers or arrays of them, always below 2**64."""
        return (((start ^ d * 0x9B) * (step | 1)) >> 20) % n

    @classmethod
    def of(cls, items: dict[bytes, int]) -> PerfectHash:
        n = len(items)
        n_buckets = max(1, n // 4)
        buckets: list[list[tuple[int, int, bytes]]] = [[] for _ in range(n_buckets)]
        for key in items:
            b, start, step = cls.marks(key)
            buckets[b % n_buckets].append((start, step, key))
        free, displace, slots = np.ones(n, bool), [0] * n_buckets, [b""] * n
        tries = np.arange(512, dtype=np.uint64)
        for b in sorted(range(n_buckets), key=lambda b: -len(buckets[b])):
            bucket = buckets[b]
            if len(bucket) == 1:  # the slots that are left over; written as a negative number
                at = int(free.argmax())
                free[at], displace[b], slots[at] = False, -at - 1, bucket[0][2]
            elif bucket:
                start, step = (np.array([x[i] for x in bucket], np.uint64)[:, None] for i in (0, 1))
                for base in range(0, 1 << 24, len(tries)):
                    places = cls.slot(start, step, tries + np.uint64(base), n)
                    fits = free[places].all(0)
                    fits[fits] = (np.diff(np.sort(places[:, fits], axis=0), axis=0) > 0).all(0)
                    if fits.any():
                        d = int(fits.argmax())
                        break
                else:
                    raise ValueError("no displacement separates these keys")
                displace[b] = d + base
                for at, (_, _, key) in zip(places[:, d].tolist(), bucket, strict=True):
                    free[at], slots[at] = False, key
        return cls(displace, slots, [items[key] for key in slots])

    def get(self, key: bytes) -> int | None:
        if not self.keys:
            return None
        h = xxhash.xxh3_128_intdigest(key)
        d = self.displace[(h & 0xFFFFFFFF) % len(self.displace)]
        at = -d - 1 if d < 0 else self.slot((h >> 32) & 0xFFFFFFFF, (h >> 64) & 0xFFFFFFFF, d, len(self.keys))
        return self.values[at] if self.keys[at] == key else None


def merge(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ranks of data's tokens."""
    n = len(data)
    parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    ends = list(range(1, n + 1))
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or ends[j] != end or parts[j] is None:
            continue
        parts[i], parts[j], ends[i] = data[i:end], None, end
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get(data[i : ends[k]])) is not None:
                heapq.heappush(heap, (rank, i, ends[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get(data[h:end])) is not None:
            heapq.heappush(heap, (rank, h, end))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Encodes texts to packed little-endian unsigned 32-bit ids, and decodes those."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash, pattern: str = SPLIT):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} bytes have no token of their own")
        self.ranks, self.table = ranks, table
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{BLANK}").replace(r"\S", f"[^{BLANK}]").replace(r"\s", f"[{BLANK}]")).findall
        self.by_chunk = pattern == SPLIT
        self.token = {rank: token for token, rank in ranks.items()}
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def word(self, pre_token: str) -> bytes:
        if (known := self.words.get(pre_token)) is not None:
            return known
        data = pre_token.encode()
        whole = self.table.get(data)
        ids = [whole] if whole is not None else merge(data, self.ranks)
        packed = np.array(ids, "<u4").tobytes()
        if len(pre_token) < 64:
            self.words[pre_token] = packed
        return packed

    def chunk(self, chunk: str) -> bytes:
        packed = b"".join(map(self.word, self.split(chunk)))
        if len(chunk) < 64:
            self.chunks[chunk] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if len(self.chunks) > REMEMBERED:
            self.chunks.clear()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        if not self.by_chunk:
            return b"".join(map(self.word, self.split(text)))
        known, make = self.chunks.get, self.chunk
        return b"".join([known(c) or make(c) for c in CHUNK.findall(text)])

    def decode(self, ids: bytes | Iterable[int]) -> bytes:
        if isinstance(ids, bytes):
            ids = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.token.__getitem__, ids))


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str = SPLIT, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 (of the packed ids), decoded_sha256 (of the decoded bytes).

    keep_ids adds ids (binary, little-endian unsigned 32-bit) and decoded (string). No shuffle; texts are taken
    whole. Null and empty texts: no tokens, digests of nothing. Repeated rows each give a row, an empty table
    an empty result; columns other than the two named are ignored.
    """
    ranks = read_ranks(ranks_path)
    table = PerfectHash.of(ranks)
    source = fold(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType

    def make():
        coder = Encoder(ranks, table, pattern)

        def act(text: str | None) -> tuple:
            ids = coder.encode(text or "")
            back = coder.decode(ids)
            row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest())
            return (*row, ids, back.decode()) if keep_ids else row

        return act

    from pyspark.sql.pandas.types import to_arrow_type

    more = [("ids", pa.binary(), "binary"), ("decoded", pa.string(), "string")] if keep_ids else []
    fields = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string"), *more]
    out = pa.schema([("doc_id", to_arrow_type(id_type)), *(f[:2] for f in fields)])
    return source.mapInArrow(per_row(out, make), ", ".join([f"doc_id {id_type.simpleString()}", *(f"{n} {t}" for n, _, t in fields)]))
