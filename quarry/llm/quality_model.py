"""Quality classification with a factorisation machine.

A document is a sparse vector of hashed words, statistics of its structure and its metadata. The score is

    sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j),

where the pairwise sum is half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2): linear in the number of features.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SLICE_ROWS, is_held_out, per_row, released

#: Places for hashed words; the statistics follow them.
WORD_PLACES = 1 << 14
STATISTICS = (
    "bias", "log_chars", "log_words", "mean_word", "upper_share", "digit_share", "mark_share", "pipe_share", "other_share", "stop_share",
    "distinct_share", "same_as_before", "capital_words", "marked_words", "lines_per_word", "equal_lines", "log_n_chars", "n_chars_missing", "empty",
)
PLACES = WORD_PLACES + len(STATISTICS)
MARKS = re.compile(r"[#*$%&<>@^~=+{}\[\]\\/_]")
REMEMBERED = 150_000


def place(word: str) -> int:
    return zlib.crc32(word.encode()) & (WORD_PLACES - 1)


def features(text: str | None, n_chars: int | None, places: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of one document's vector; the words' part has length 1."""
    text = text or ""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    if len(places) > REMEMBERED:
        places.clear()
    at = []
    for w in counts:
        p = places.get(w)
        if p is None:
            p = place(w.lower())
            if len(w) < 64:
                places[w] = p
        at.append(p)
    ids, where = np.unique(np.array(at, np.int64), return_inverse=True)
    values = np.log1p(np.bincount(where, weights=np.fromiter(counts.values(), np.float64, len(counts)))) if len(at) else np.empty(0)
    if len(values):
        values /= math.sqrt(float(values @ values))
    lines = text.split("\n")
    upper = sum(map(str.isupper, words))
    marks, stops = len(MARKS.findall(text)), text.count(".") + text.count("!") + text.count("?")
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words)
    same = sum(map(str.__eq__, words, words[1:]))
    structure = [
        1.0, math.log1p(len(text)) / 10, math.log1p(len(words)) / 8, min(2.0, size / n / 10), upper / n,
        sum(map(text.count, "0123456789")) / size, min(1.0, 5 * marks / size), min(1.0, 5 * text.count("|") / size),
        min(1.0, 20 * text.count("!") / size), min(1.0, 10 * stops / size), len(counts) / n, same / n,
        sum(w[0].isupper() for w in words) / n, marked / n, min(1.0, 5 * len(lines) / n), 1 - len(set(lines)) / len(lines),
        math.log1p(max(0, n_chars or 0)) / 10, float(n_chars is None), float(not words),
    ]
    return np.concatenate([ids, np.arange(WORD_PLACES, PLACES)]), np.concatenate([values, structure])


@dataclass(frozen=True)
class FactorisationMachine:
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, ids: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[ids] * x[:, None]
        total = v.sum(0)
        return float(self.weights[ids] @ x + 0.5 * (total @ total - (v * v).sum()))

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, self.margin(ids, x)))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 12, rate: float = 0.02, decay: float = 1e-5, batch: int = 256, seed: int = 7) -> FactorisationMachine:
    """Mini-batch Adam on the log loss. Without both labels the model is constant at the share of label 1."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(PLACES), rng.normal(0, 0.02, (PLACES, rank))
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = WORD_PLACES + STATISTICS.index("bias")
    w[bias] = math.log(share / (1 - share))
    if len(labels) == 0 or labels.min() == labels.max():
        return FactorisationMachine(w.astype(np.float32), np.zeros((PLACES, rank), np.float32))
    moments = [np.zeros_like(a) for a in (w, w, v, v)]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            chosen = order[at : at + batch]
            ids, x = (np.concatenate([rows[i][k] for i in chosen]) for k in (0, 1))
            lengths = np.array([len(rows[i][0]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            vx = v[ids] * x[:, None]
            total = np.add.reduceat(vx, starts)
            margin = np.add.reduceat(w[ids] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            error = (1 / (1 + np.exp(-np.clip(margin, -60, 60))) - labels[chosen]) / len(chosen)
            each = np.repeat(error, lengths) * x
            used, where = np.unique(ids, return_inverse=True)
            gv = (np.repeat(total, lengths, axis=0) - vx) * each[:, None]
            gradients = np.bincount(where, weights=each), np.stack([np.bincount(where, weights=gv[:, f]) for f in range(rank)], 1)
            step += 1
            for a, g, m, s in ((w, gradients[0], *moments[:2]), (v, gradients[1], *moments[2:])):
                g = g + decay * a[used]
                m[used] = 0.9 * m[used] + 0.1 * g
                s[used] = 0.999 * s[used] + 0.001 * g * g
                a[used] -= rate * (m[used] / (1 - 0.9**step)) / (np.sqrt(s[used] / (1 - 0.999**step)) + 1e-8)
    return FactorisationMachine(w.astype(np.float32), v.astype(np.float32))


def _rows(docs: DataFrame, id_col: str, text_col: str, n_chars_col: str | None) -> DataFrame:
    n_chars = F.col(n_chars_col).cast("long") if n_chars_col and n_chars_col in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), n_chars.alias("n_chars"))


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text",
    n_chars_col: str | None = "n_chars", label_col: str = "quality",
) -> FactorisationMachine:
    """Trained on a bounded sample: of the labelled rows that aren't held out, sample_rows with the smallest hashes of
    their ids. Vectors are made on the executors; only those of the sample, one for an id, reach the driver. Labels other
    than 0 and 1 are left out, of a document with several labels the smallest counts, of an id with several rows the
    smallest text.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = _rows(docs, id_col, text_col, n_chars_col).join(F.broadcast(sample), "doc_id")  # sample_rows rows of two numbers
    one = chosen.groupBy("doc_id", "label").agg(F.min(F.struct("text", "n_chars")).alias("d"))  # an id may have several rows
    chosen = one.select("doc_id", "d.text", "d.n_chars", "label")

    def make():
        places: dict[str, int] = {}

        def act(text, n_chars, label):
            ids, x = features(text, n_chars, places)
            return label, ids.astype("<i4").tobytes(), x.astype("<f4").tobytes()

        return act

    out = pa.schema([("doc_id", pa.string()), ("label", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())])
    got = chosen.select(F.col("doc_id").cast("string"), "text", "n_chars", "label").mapInArrow(per_row(out, make), "doc_id string, label int, ids binary, x binary").collect()
    got.sort(key=lambda r: (zlib.crc32(r.doc_id.encode()), r.doc_id, bytes(r.ids), bytes(r.x)))
    rows = [(np.frombuffer(r.ids, "<i4").astype(np.int64), np.frombuffer(r.x, "<f4").astype(np.float64)) for r in got]
    return train(rows, np.array([r.label for r in got], np.float64))


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1), predicted (1 if score >= threshold). No shuffle; whole texts.

    Null and empty texts are scored by their statistics. Without a column n_chars it counts as missing. Repeated rows
    each give a row, an empty table an empty result; columns other than those named are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    source = _rows(docs, id_col, text_col, n_chars_col)
    id_type = source.schema["doc_id"].dataType

    def make():
        places: dict[str, int] = {}

        def act(text, n_chars):
            s = model.score(*features(text, n_chars, places))
            return s, int(s >= threshold)

        return act

    out = pa.schema([("doc_id", to_arrow_type(id_type)), ("score", pa.float64()), ("predicted", pa.int32())])
    return source.mapInArrow(per_row(out, make), f"doc_id {id_type.simpleString()}, score double, predicted int")


def accepted(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.5, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The rows of docs, with all their columns, that score threshold or more. No shuffle.

    Each row is judged by itself: null and empty texts by their statistics, repeated rows alike, texts whole. Without a
    column n_chars it counts as missing; other columns may have any names. An empty table stays empty.
    """
    has_n_chars = n_chars_col in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column(text_col).to_pylist()
                lengths = part.column(n_chars_col).to_pylist() if has_n_chars else [None] * len(texts)
                yield part.filter(pa.array([model.score(*features(t, n, places)) >= threshold for t, n in zip(texts, lengths, strict=True)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
