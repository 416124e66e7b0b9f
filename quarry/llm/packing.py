"""Packing documents into token sequences of a fixed capacity, with certified bin counts.

Rounds of best-fit decreasing over groups of bounded size. After each, dual-feasible functions give a lower bound of
the group's bin count. A group that meets its bound keeps all but its two worst-filled bins, one with a gap gives up
more of them; what the groups give up is dealt anew to fewer groups and packed again. A group that is alone exchanges
pieces between its own bins, until it meets its bound or exchanges gain nothing.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_ROWS, fold, spool

#: How byte-level vocabularies write bytes that aren't printable, and the split pattern they imply.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces in a group on average, and a group's bins that are given up for each bin of its gap.
GROUP_ROWS, GIVEN_UP = 8192, 24
#: Pieces that a group grows to, where groups of GROUP_ROWS keep giving up nearly all of their bins.
MOST_GROUP_ROWS = 1 << 18
#: Pieces of one exchange inside a group, and exchanges in a row that gain nothing before it is left as it is.
EXCHANGED, IDLE = 600, 12


def encoder(vocabulary: str) -> Callable[[str], list[int]]:
    """Text to ids, as the tokenizer file says, without special tokens being added.

    A plain byte-level file whose ids are its merge ranks is run by the rank encoder, which gives the same ids
    sooner; any other file by the library that the file belongs to, and so are texts on which the rank encoder's
    regular expressions give out, such as a million blanks.
    """
    library = []

    def by_library(text: str) -> list[int]:
        if not library:
            import tokenizers

            library.append(tokenizers.Tokenizer.from_str(vocabulary))
            library[0].no_truncation()
            library[0].no_padding()
        return library[0].encode(text, add_special_tokens=False).ids

    spec = json.loads(vocabulary)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    added = spec.get("added_tokens", [])
    plain = plain and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added)
    if plain:
        others = iter(range(256, 512))
        byte_of = {chr(b if b in PRINTABLE else next(others)): b for b in range(256)}
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if all(model["vocab"].get("".join(m)) == 256 + i for i, m in enumerate(merges)) and len(ranks) == 256 + len(merges):
            import tiktoken

            coder = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)

            def by_ranks(text: str) -> list[int]:
                try:
                    return coder.encode(text, allowed_special="all")
                except ValueError:  # its stack is too small for this text
                    return by_library(text)

            return by_ranks
    return by_library


def tokenised(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType
    out = pa.schema([("doc_id", to_arrow_type(id_type)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                rows, of = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    start, end = 0, (len(ids) % capacity or capacity) if len(ids) > capacity else len(ids)
                    piece = 0
                    while start < len(ids):
                        rows.append((piece, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                        of.append(i)
                        piece, start, end = piece + 1, end, end + capacity
                ids_column = part.column(0).take(pa.array(of, pa.int64())).cast(out.field(0).type)
                yield pa.RecordBatch.from_arrays([ids_column, *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(out)[1:], strict=True))], schema=out)

    return docs.mapInArrow(run, f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual-feasible functions: no packing has fewer bins."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    size = np.arange(capacity + 1)
    n, total = np.cumsum(count), np.cumsum(count * size)
    least = np.arange(capacity // 2 + 1)  # smaller ones count 0, those above capacity - least count as whole bins
    inside = total[capacity - least] - np.where(least > 0, total[least - 1], 0)
    best = int(((n[-1] - n[capacity - least]) + -(-inside // capacity)).max())
    for k in range(1, 64):
        scaled = (k + 1) * size
        weight = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # over k * capacity
        best = max(best, -(-int((count * weight).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each piece, and the bins' room. Equal lengths go in their order."""
    room: list[int] = []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = at[r].pop()
            if not at[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = left = r - size
        if left:
            if not at[left]:
                open_rooms |= 1 << left
            at[left].append(b)
    return bins, offsets, room


def _filled(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins (positions in lengths): each has the largest piece left, and of the others those that fill it best."""
    left: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        left.setdefault(int(lengths[i]), []).append(i)
    bins = []
    while left:
        size = next(iter(left))
        inside = [left[size].pop()]
        room = capacity - size
        sums, mask = [1], (1 << (room + 1)) - 1  # bit s: some of the pieces so far add up to s
        items = [(n, k) for n, some in left.items() if n <= room for k in range(min(len(some), room // n))]
        for n, _ in items:
            sums.append((sums[-1] | sums[-1] << n) & mask)
        at = sums[-1].bit_length() - 1
        for j in range(len(items) - 1, -1, -1):
            if not sums[j] >> at & 1:
                inside.append(left[items[j][0]].pop())
                at -= items[j][0]
        bins.append(inside)
        left = {n: some for n, some in left.items() if some}
    return bins


def tightened(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, room: list[int], capacity: int, bound: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The packing after exchanges: the pieces of the worst-filled bins and of some others, by chance, are packed anew.

    Ends when bound is met or IDLE exchanges in a row have gained nothing: neither a bin nor a fuller set of bins.
    """
    rng, idle = np.random.default_rng(seed), 0
    order = np.argsort(bins, kind="stable")
    held = np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)
    rooms = np.array(room)
    while len(held) > bound and idle < IDLE:
        worst = np.argsort(-rooms, kind="stable")
        first = max(2, min(len(held) // 2, GIVEN_UP))
        chosen, n = [], 0
        for b in np.concatenate([worst[:first], rng.permutation(worst[first:])[:EXCHANGED]]).tolist():
            if n + len(held[b]) > EXCHANGED and len(chosen) >= 2:
                break
            chosen.append(b)
            n += len(held[b])
        pieces = np.concatenate([held[b] for b in chosen])
        anew = [pieces[b] for b in _filled(lengths[pieces], capacity)]
        left = np.array([capacity - int(lengths[b].sum()) for b in anew])
        gains = len(chosen) - len(anew)
        idle = 0 if gains > 0 else idle + 1
        if gains > 0 or (gains == 0 and (left**2).sum() > (rooms[chosen] ** 2).sum()):
            gone = set(chosen)
            held = [h for b, h in enumerate(held) if b not in gone] + anew
            rooms = np.concatenate([np.delete(rooms, chosen), left])
    bins, offsets, room = bins.copy(), offsets.copy(), []
    for b, inside in enumerate(held):
        ends = np.cumsum(lengths[inside])
        bins[inside], offsets[inside] = b, ends - lengths[inside]
        room.append(capacity - int(ends[-1]))
    return bins, offsets, room


def _round(loose: DataFrame, groups: int, number: int, last: bool, capacity: int) -> DataFrame:
    """row, length, sequence_id, offset, settled of one round."""
    dealt = loose.withColumn("part", F.pmod(F.xxhash64("row", F.lit(number)), F.lit(groups)))

    def pack(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("row")
        lengths = t["length"].to_numpy()
        bins, offsets, room = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        if last and len(room) > bound:
            bins, offsets, room = tightened(lengths, bins, offsets, room, capacity, bound, number)
        gap = len(room) - bound
        settled = np.ones(len(room), bool)
        if not last:  # bounds are whole bins: a group that meets its own has up to one bin of room, which others may fill
            worst = np.argsort(-np.array(room), kind="stable")[: GIVEN_UP * (gap + 1) if gap > 0 else 2]
            settled[worst[np.array(room)[worst] > 0]] = False
        first = (number << 56) + (int(t["part"].iloc[0]) << 24)
        return pd.DataFrame({"row": t["row"].to_numpy(), "length": lengths, "sequence_id": first + bins, "offset": offsets, "settled": settled[bins]})

    return dealt.groupBy("part").applyInPandas(pack, "row long, length long, sequence_id long, offset long, settled boolean")


def pack(docs: DataFrame, vocabulary_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and end_id; only one longer than capacity is cut, into pieces of capacity of which
    the first may be shorter. A sequence's pieces follow one another from offset 0 without gaps. Null and empty
    texts are one piece of one id. Very long texts are taken whole, at the memory of one text. Repeated rows are
    documents of their own, pieces of equal lengths are placed in the order of their rows; an empty table gives an
    empty result; columns other than the two named are ignored.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    pieces = spool(tokenised(fold(docs, id_col, text_col), vocabulary, capacity, end_id).withColumn("row", F.monotonically_increasing_id()))
    loose = pieces.where(F.col("length") < capacity).select("row", "length")
    places, number, size, before = [], 0, GROUP_ROWS, 0
    while n := loose.count():
        # groups that gave up more than half of their pieces are too small to meet their bounds
        size = min(MOST_GROUP_ROWS, 2 * size) if 2 * n > before > 0 else size
        groups = -(-n // size)
        last = groups == 1 or (size == MOST_GROUP_ROWS and 2 * n > before > 0)
        packed = spool(_round(loose, groups, number, last, capacity))
        places.append(packed.where("settled").select(F.col("row").alias("__row"), "sequence_id", "offset"))
        if last:
            break
        loose, before, number = packed.where("NOT settled").select("row", "length"), n, number + 1
    full = F.col("length") == capacity
    whole = pieces.where(full).select("*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    result = whole.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    if places:
        every = places[0]
        for more in places[1:]:
            every = every.union(more)
        placed = pieces.where(~full).join(every, F.col("row") == F.col("__row"))
        result = result.union(placed.select(*result.columns))
    return result
