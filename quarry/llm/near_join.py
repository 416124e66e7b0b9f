"""Near-duplicate groups by a parity-sketch join on word shingles; exact for the similarity asked for.

A document is the set of hashes of its shingles. A parity sketch has a bit for each hash position, flipped once
for each element that falls there, so the Hamming distance of two sketches is at most the size of the sets'
symmetric difference. Sets that are similar enough differ by at most d elements, where d follows from their sizes.

* Candidates: sizes fall into bands. Within a band a sketch is cut into m segments, so two sets that differ by at most
  d elements agree in at least m - d segments (pigeonhole). Segments that agree are alike in all respects, so if every
  set leaves out its m - d - 1 weakest ones, in an order by contents alone, the strongest one on which two sets agree is
  given by both: a set gives d + 1 keys, d following from its own size, and segments with few elements, which sets
  share by accident, or with none are the ones left out. No pair is lost.
* Keys are sorted by ranges of keys and names, so that a key with very many sets is split over tasks.
* The candidates' short sketches must be near enough, then the sets themselves are intersected.
* Of the sets that share a segment, each is first compared with one of them, chosen by a hash; where components remain
  apart, with another one. Then only pairs of sets that lie in different components are left; those are compared in
  blocks, all of them. Pairs inside a component can't change a component.

Sets are named by 128 bits, which are soon replaced by numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import ROW, SLICE_ROWS, cut, discard, fold, has_unique, numbered, released, short_batches, small_or_shuffled, spool, without
from quarry.llm.graph import components

#: Bits of the sketch that candidates carry: the power of two from the set's size upwards, this at least.
LEAST_BITS = 512
#: Positions of a segment's bits, each with a random number; a segment's value is the exclusive or of those of its bits.
POSITIONS = 1 << 16
#: Sizes of a band lie within this factor.
BAND = 2.5
#: Segments of a band for each key that its largest sets give.
SPARE = 1.25
#: Sets whose keys a task remembers to have given; more copies than needed change no result.
REMEMBERED = 200_000
#: Words whose hashes a task remembers.
WORDS = 50_000
#: Rows of a block; a pair of blocks is compared in one task.
BLOCK = 4096


@dataclass(frozen=True)
class Measure:
    """Two sets are linked if den * intersection >= num * union."""

    width: int
    num: int
    den: int

    def furthest(self, size: int) -> int:
        """No linked sets differ by more elements if their sizes add up to size or less."""
        return (self.den - self.num) * size // (self.den + self.num)

    def spaces(self, n: int) -> Iterator[tuple[int, int, int]]:
        """Of the bands that a set of size n takes part in: number, segments, keys that it gives."""
        band, low, high = 0, 1, 2
        while n >= high:
            band, low, high = band + 1, high, self._above(high)
        largest = n * self.den // self.num  # of the sets that are near enough
        yield band, self._segments(high), self.furthest(n + min(high - 1, largest)) + 1
        while largest >= high:
            band, high = band + 1, self._above(high)
            yield band, self._segments(high), self.furthest(n + min(high - 1, largest)) + 1

    @staticmethod
    def _above(high: int) -> int:
        return max(high + 1, math.ceil(high * BAND))

    def _segments(self, high: int) -> int:
        keys = self.furthest(2 * (high - 1)) + 1
        return keys if keys == 1 else math.ceil(SPARE * keys) + 1


class Sketcher:
    """Sets, short sketches and segment values of texts."""

    def __init__(self, measure: Measure):
        self.measure = measure
        self.positions = np.random.default_rng(20).integers(1, 2**63, POSITIONS, dtype=np.uint64)
        self.words: dict[bytes, int] = {}
        self.spaces: dict[int, list[tuple[int, int, int]]] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes. Words are what lies between white space, with A-Z in lower case."""
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.words
        if len(known) > WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        width = min(self.measure.width, len(words))
        total = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            total = (total ^ h[i : i + len(total)]) * np.uint64(0x9FB21C651E98DF25)
            total ^= total >> np.uint64(29)
        return np.unique(total)

    @staticmethod
    def short(hashes: np.ndarray) -> bytes:
        bits = max(LEAST_BITS, 1 << max(0, len(hashes) - 1).bit_length())
        return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.empty(0, np.int64)
        n = len(hashes)
        if n not in self.spaces:
            self.spaces[n] = list(self.measure.spaces(n))
        top, value = hashes >> np.uint64(32), self.positions[((hashes >> np.uint64(10)) & np.uint64(POSITIONS - 1)).astype(np.int64)]
        out = []
        for band, segments, wanted in self.spaces[n]:
            segment = (top * np.uint64(segments)) >> np.uint64(32)  # rising, as the hashes are sorted
            starts = np.flatnonzero(np.diff(segment, prepend=np.uint64(segments)))
            found, at, size = np.bitwise_xor.reduceat(value, starts), segment[starts], np.diff(starts, append=n)
            if len(at) < wanted:  # segments without elements are the weakest
                missing = np.setdiff1d(np.arange(segments, dtype=np.uint64), at)
                at, found = np.concatenate([at, missing]), np.concatenate([found, np.zeros(len(missing), np.uint64)])
                size = np.concatenate([size, np.zeros(len(missing), np.int64)])
            key = (found ^ (at << np.uint64(8) | np.uint64(band))) * np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
            key *= np.uint64(0xD6E8FEB86659FD93)
            if len(key) > wanted:  # the order is that of (elements, key)
                key = key[np.lexsort((key, size))[-wanted:]]
            out.append(key.view(np.int64))
        return np.concatenate(out)


def _sketched(docs: DataFrame, measure: Measure) -> DataFrame:
    """doc_id, node, check (the two halves of the set's name; null without words), n_shingles, short sketch, keys."""
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType
    out = pa.schema([("doc_id", to_arrow_type(id_type)), ("node", pa.int64()), ("check", pa.int64()), ("n_shingles", pa.int64()), ("short", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, seen = Sketcher(measure), set()
        for batch in batches:
            for start in range(0, batch.num_rows, 8 * SLICE_ROWS):
                part = batch.slice(start, 8 * SLICE_ROWS)
                sets = [sketcher.shingles(t) for t in part.column(1).to_pylist()]
                names = [_name(s) for s in sets]
                keys = []
                for s, name in zip(sets, names, strict=True):  # a task gives the keys of equal sets once
                    keys.append(sketcher.keys(s) if name not in seen else np.empty(0, np.int64))
                    seen.add(name)
                if len(seen) > REMEMBERED:
                    seen.clear()
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(out.field(0).type),
                        *(pa.array([x[i] for x in names], pa.int64()) for i in range(2)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([Sketcher.short(s) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(offsets, np.concatenate(keys) if keys else np.empty(0, np.int64)),
                    ],
                    schema=out,
                )

    return docs.mapInArrow(released(run), f"doc_id {id_type.simpleString()}, node long, check long, n_shingles long, short binary, keys array<long>")


def _name(hashes: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    if not len(hashes):
        return None, None
    name = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (name >> 64) - 2**63, (name & 2**64 - 1) - 2**63


def _sets(docs: DataFrame, nodes: DataFrame, measure: Measure) -> DataFrame:
    """num, hashes of the wanted nodes(num, node, check, doc_id). Texts move only if the ids are too many to broadcast.

    Ids may be null or repeat: of the texts that have an id, those count whose set has the name.
    """
    wanted = nodes.select(F.col("doc_id").alias("__id"), "num", "node", "check")
    chosen = docs.join(small_or_shuffled(wanted), docs.doc_id.eqNullSafe(F.col("__id"))).select("num", "node", "check", "text")
    out = pa.schema([("num", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(measure)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                num, node, check, text = (c.to_pylist() for c in part.columns)
                rows = [(i, s.view(np.int64)) for i, *name, s in zip(num, node, check, map(sketcher.shingles, text), strict=True) if _name(s) == tuple(name)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], schema=out)

    return chosen.mapInArrow(released(run), "num long, hashes array<long>")


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, measure: Measure) -> DataFrame:
    """The pairs(a, b) of numbers whose sets are similar enough; nodes(num, node, check, doc_id)."""
    ends = pairs.select(F.col("a").alias("num")).union(pairs.select("b")).distinct()
    wanted = cut(nodes.join(ends, "num", "left_semi").select("num", "node", "check", "doc_id"))
    with short_batches(docs.sparkSession):
        sets = spool(_sets(docs, wanted, measure).dropDuplicates(["num"]))
    one, two = (sets.select(F.col("num").alias(c), F.col("hashes").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b"))
    held = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("either"))
    linked = cut(held.where(F.col("both") * measure.den >= F.col("either") * measure.num).select("a", "b"))
    discard(sets)
    return linked


def _near(pairs: DataFrame, measure: Measure) -> DataFrame:
    """Of pairs(a, b, n_a, n_b, short_a, short_b) those that may be linked."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            x, y = (np.array(batch.column(c).to_pylist(), object) for c in ("short_a", "short_b"))
            width = np.minimum([len(v) for v in x], [len(v) for v in y])
            ok = np.zeros(len(width), bool)
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                distance = np.bitwise_count(_folded(x[at], w) ^ _folded(y[at], w)).sum(1)
                ok[at] = _may_link(n_a[at], n_b[at], distance, measure)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in "ab"], schema=out)

    return pairs.mapInArrow(released(run), "a long, b long")


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches of width bytes, as rows of 64-bit words: the parts of a longer one are put together by exclusive or."""
    parts = [np.bitwise_xor.reduce(np.frombuffer(v, "<u8").reshape(-1, width // 8), axis=0) for v in sketches]
    return np.stack(parts)


def _may_link(n_a, n_b, distance, measure: Measure):
    size = n_a + n_b
    furthest = size - 2 * -(-measure.num * size // (measure.den + measure.num))
    return (distance <= furthest) & (measure.den * np.minimum(n_a, n_b) >= measure.num * np.maximum(n_a, n_b))


def _turn() -> Column:
    """A node's place among the nodes of a key: an order of its own for each key, so that documents which share many
    keys are compared with many stars, and few of those that are linked stay apart.
    """
    return F.xxhash64("num", "key")


def _shared(keyed: DataFrame) -> DataFrame:
    """Of keyed(key, node, check) the distinct rows whose key two sets or more have, and a few others.

    One shuffle, by ranges of (key, name): a key with very many sets is split over tasks like any other rows. So the
    first and the last key of a partition may go on in its neighbours, and are given in any case. A key's first row
    waits until another one follows, so that memory stays the same however many rows a key has.
    """
    columns = ["key", "node", "check"]
    ordered = keyed.repartitionByRange(*columns).sortWithinPartitions(*columns)
    out = pa.schema([(c, pa.int64()) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the last row, and whether it is given already
        done = False
        for batch in batches:
            t = [batch.column(c).to_numpy() for c in columns]
            if not len(t[0]):
                continue
            started, given_before = held is not None, done
            if started:
                t = [np.concatenate(x) for x in zip(held, t, strict=True)]
            differs = [np.concatenate([[True], x[1:] != x[:-1]]) for x in t]
            fresh = differs[0] | differs[1] | differs[2]
            t = [x[fresh] for x in t]
            starts = np.flatnonzero(differs[0][fresh])
            lengths = np.diff(starts, append=len(t[0]))
            given = np.repeat(lengths > 1, lengths)
            if not started:
                given[: lengths[0]] = True
            done = bool(given[-1] or (given_before and len(given) == 1))
            if given_before:
                given[0] = False
            held = [x[-1:] for x in t]
            yield pa.RecordBatch.from_arrays([pa.array(x[given]) for x in t], schema=out)
        if held is not None and not done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], schema=out)

    return ordered.mapInArrow(released(run), "key long, node long, check long")


def _across(rows: DataFrame, measure: Measure) -> DataFrame:
    """Candidates (a, b) among rows(key, size, num, comp, n, short) that share a key and lie in different components.

    A key's rows are dealt to blocks of about BLOCK rows and every pair of blocks meets by itself, so that no group
    has more than two blocks; what leaves it is pairs with near sketches only.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("num"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    dealt = dealt.withColumn("m", F.explode(meets)).select("key", F.col("m.i").alias("i"), F.col("m.j").alias("j"), "block", "num", "comp", "n", "short")
    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            found = _compared(t, measure)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=out)

    return dealt.mapInArrow(released(run), "a long, b long").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of consecutive whole groups; a group that ends a batch may go on in the next one."""
    held = None
    for batch in batches:
        t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "block", "num", "comp", "n")}
        t["short"] = np.empty(batch.num_rows, object)
        t["short"][:] = batch.column("short").to_pylist()
        t = t if held is None else {c: np.concatenate([held[c], t[c]]) for c in t}
        if not len(t["key"]):
            continue
        last = (t["key"] == t["key"][-1]) & (t["i"] == t["i"][-1]) & (t["j"] == t["j"][-1])
        at = int(last.argmax())
        held = {c: v[at:] for c, v in t.items()}
        if at:
            yield {c: v[:at] for c, v in t.items()}
    if held is not None:
        yield held


def _compared(t: dict[str, np.ndarray], measure: Measure) -> tuple[np.ndarray, np.ndarray]:
    change = (np.diff(t["key"]) != 0) | (np.diff(t["i"]) != 0) | (np.diff(t["j"]) != 0)
    starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(t["key"])]])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        node, comp, n, block, short = (t[c][lo:hi] for c in ("num", "comp", "n", "block", "short"))
        i, j = t["i"][lo], t["j"][lo]
        if comp.min() == comp.max():
            continue
        width = np.array([len(v) for v in short])
        for w in np.unique(width).tolist():  # a pair is compared at the smaller of its widths
            at = np.flatnonzero(width >= w)
            sketch = _folded(short[at], w)
            exact, two = width[at] == w, block[at] == j
            for r in np.flatnonzero(block[at] == i).tolist():
                other = two & (comp[at] != comp[at[r]])
                if i == j:
                    other &= node[at] > node[at[r]]
                if not exact[r]:
                    other &= exact
                others = np.flatnonzero(other)
                if len(others):
                    near = at[others[_may_link(n[at[r]], n[at[others]], np.bitwise_count(sketch[others] ^ sketch[r]).sum(1), measure)]]
                    out.append((np.maximum(node[near], node[at[r]]), np.minimum(node[near], node[at[r]])))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def near_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles (size of its set), component_id (smallest doc_id that links lead to).

    Words are runs of characters other than white space, A-Z in lower case; a document's set has its distinct runs
    of width words, or the whole sequence if it has fewer. Documents are linked if den * intersection >= num * union.
    Null, empty and blank texts have an empty set and no links. Rows with equal sets are linked whatever their
    ids; repeated rows each give a row. A null id is never the smallest unless all are null. An empty table gives
    an empty result; columns other than the two named are ignored.
    """
    measure = Measure(width, num, den)
    docs = fold(docs, id_col, text_col)
    with short_batches(docs.sparkSession):
        table = spool(_sketched(docs, measure))
    name = ["node", "check"]
    some = table.where("n_shingles > 0")
    nodes = some.groupBy(*name).agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("short").alias("short"))
    nodes = spool(nodes.withColumn("num", F.monotonically_increasing_id()))
    facts = spool(table.select("doc_id", *name, "n_shingles").join(nodes.select(*name, "num"), name, "left").drop(*name))
    rows = spool(_shared(some.select(F.explode("keys").alias("key"), *name)).join(nodes.select(*name, "num"), name).select("key", "num"))
    discard(table)
    light = nodes.select("num", "n", "short")

    def with_sketches(pairs: DataFrame) -> DataFrame:
        a, b = (light.select(F.col("num").alias(c), F.col("n").alias(f"n_{c}"), F.col("short").alias(f"short_{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b")

    def labelled(frame: DataFrame) -> DataFrame:
        found = small_or_shuffled(labels.select(F.col("node").alias("__node"), "comp"))
        return frame.join(found, frame.num == F.col("__node"), "left").withColumn("comp", F.coalesce("comp", "num")).drop("__node")

    def apart(pairs: DataFrame) -> DataFrame:
        a, b = (small_or_shuffled(labels.select(F.col("node").alias(f"__{c}"), F.col("comp").alias(f"c{c}"))) for c in "ab")
        found = pairs.join(a, F.col("a") == F.col("__a"), "left").join(b, F.col("b") == F.col("__b"), "left")
        return found.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")

    def against_stars(rows: DataFrame) -> DataFrame:
        pairs = rows.where("num <> star").select(F.greatest("num", "star").alias("a"), F.least("num", "star").alias("b")).distinct()
        return spool(_near(with_sketches(pairs), measure))

    stars = rows.groupBy("key").agg(F.min(F.struct(_turn().alias("h"), "num"))["num"].alias("star"), F.count(F.lit(1)).alias("size")).where("size > 1")
    tried = against_stars(rows.join(stars.select("key", "star"), "key"))
    links = _linked(tried, nodes, docs, measure)
    labels = components(links)
    for last in (False, True):
        # keys whose rows still lie in different components; once more with another star, then all pairs of these.
        # Of two rows one was the other's star: those are done.
        placed = labelled(rows)
        other = F.lit(None) if last else F.max(F.struct(_turn().alias("h"), "num"))["num"]
        still = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("size"), other.cast("long").alias("star"))
        still = spool(still.where("c1 < c2 AND size > 2").select(F.col("key").alias("__key"), "size", "star"))
        left = placed.join(small_or_shuffled(still), F.col("key") == F.col("__key"))
        more = _across(left.select("key", "size", "num", "comp").join(light, "num"), measure) if last else against_stars(left)
        more = spool(more.join(tried, ["a", "b"], "left_anti"))
        for one_each in (True, False):  # sets of one pair for each two components, then of the pairs still apart
            rest = apart(more)
            if one_each:
                rest = rest.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
            rest = spool(rest.select("a", "b"))
            if rest.isEmpty():
                break
            links = links.union(_linked(rest, nodes, docs, measure))
            labels = components(links)
        tried = tried.union(more)
    discard(rows)
    member = spool(labelled(facts))
    smallest = spool(member.where("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("smallest")).withColumnRenamed("comp", "__comp"))
    found = member.join(smallest, F.col("comp") == F.col("__comp"), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that with the smallest id, null ids last; of rows with that id exactly one.

    Groups are those of row numbers, so ids may repeat or be null.
    """
    if has_unique(docs, id_col):
        groups = near_groups(docs, width, num, den, id_col, text_col)
        return without(docs, groups.where("doc_id <> component_id").select("doc_id"), id_col)
    docs = numbered(docs)
    groups = near_groups(docs, width, num, den, ROW, text_col).select(F.col("doc_id").alias("row"), "component_id")
    groups = spool(groups.join(docs.select(F.col(ROW).alias("row"), F.col(id_col).alias("id")), "row"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("row").alias("row")))["row"]
    kept = groups.groupBy("component_id").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", "first")
    gone = groups.join(kept, "component_id").where("row <> first")
    return without(docs, gone.select(F.col("row").alias("doc_id")), ROW).drop(ROW)
