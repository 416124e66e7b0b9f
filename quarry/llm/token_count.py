"""Exact token counts of a piece vocabulary, without encoding most of the text.

The vocabulary is a byte-pair model over characters with byte fallback, spaces written as U+2581. Two facts
are proved from the vocabulary alone, before any text is read:

* no piece has a space mark after another character, so no merge crosses the border before a run of space
  marks: a text falls into pre-tokens that encode independently;
* of the pieces, those that the merge rules rebuild from their characters as one token. A pre-token equal to
  one of them counts 1 and is never merged.

The remaining pre-tokens are cut once more between characters that stand side by side in no piece, and only
those parts that are not proven are merged, with a heap over linked symbols.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import fold, per_row

SPACE = "▁"
#: Pre-tokens whose counts a worker remembers; then it starts afresh, which changes no result.
REMEMBERED = 300_000


@dataclass(frozen=True)
class PieceModel:
    """Pieces with scores; rows of the model file that are neither control nor byte pieces."""

    scores: dict[str, float]
    bytes_fall_back: bool

    @classmethod
    def from_bytes(cls, model: bytes) -> PieceModel:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        made = cls({sp.id_to_piece(i): sp.get_score(i) for i in plain}, any(sp.is_byte(i) for i in range(n)))
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in made.scores):
            raise ValueError("a piece has a space mark inside: pre-tokens of this vocabulary don't encode independently")
        if sp.encode(f"a  {SPACE}b", out_type=str) != sp.encode("a   b", out_type=str) or sp.encode(" ", out_type=str) == []:
            raise ValueError("the model rewrites white space; this counter takes texts as they are")
        return made

    @cached_property
    def neighbours(self) -> frozenset[str]:
        """Pairs of characters that stand side by side in some piece."""
        return frozenset(p[i : i + 2] for p in self.scores for i in range(len(p) - 1))

    def merged(self, part: str) -> list[str]:
        """The pieces of one part, by merging the best-scored neighbours first and the leftmost of equals."""
        scores, symbols, n = self.scores, list(part), len(part)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-scores[pair], i, pair) for i in range(n - 1) if (pair := part[i : i + 2]) in scores]
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != made:
                continue
            symbols[i], symbols[j] = made, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (pair := made + symbols[k]) in scores:
                    heapq.heappush(heap, (-scores[pair], i, pair))
            if (h := before[i]) >= 0 and (pair := symbols[h] + made) in scores:
                heapq.heappush(heap, (-scores[pair], h, pair))
        return [s for s in symbols if s is not None]

    def proven(self) -> frozenset[str]:
        """The pieces that encode alone as the one token they are."""
        return frozenset(p for p in self.scores if self.merged(p) == [p])

    def parts(self, pre_token: str) -> list[str]:
        beside, cuts = self.neighbours, [0]
        cuts += [i for i in range(1, len(pre_token)) if pre_token[i - 1 : i + 1] not in beside]
        return [pre_token[a:b] for a, b in zip(cuts, [*cuts[1:], len(pre_token)], strict=True)]

    def cost(self, symbol: str) -> int:
        return 1 if symbol in self.scores or not self.bytes_fall_back else len(symbol.encode())


class Counts(dict):
    """Pre-token to count; the proven ones are there from the start, the others come when first met."""

    def __init__(self, model: PieceModel, proven: frozenset[str]):
        super().__init__(dict.fromkeys(proven, 1))
        self.model, self.proven, self.part_counts = model, proven, {}

    def __missing__(self, pre_token: str) -> int:
        total, known = 0, self.part_counts
        for part in self.model.parts(pre_token):
            if part in self.proven:
                total += 1
            elif (n := known.get(part)) is not None:
                total += n
            else:
                n = sum(map(self.model.cost, self.model.merged(part))) if len(part) > 1 else self.model.cost(part)
                if len(part) < 64:
                    known[part] = n
                total += n
        if len(pre_token) < 64:
            self[pre_token] = total
        return total

    def forget(self) -> None:
        if len(self) > REMEMBERED + len(self.proven):
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        if len(self.part_counts) > REMEMBERED:
            self.part_counts.clear()


#: A pre-token: a run of space marks and what follows up to the next one.
PRE_TOKEN = re.compile(f"{SPACE}+[^{SPACE}]*")


def count_tokens(text: str, counts: Counts) -> int:
    if not text:
        return 0
    if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return sum([counts[SPACE + w] for w in text.split(" ")])
    return sum([counts[w] for w in PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE))])


def token_counts(docs: DataFrame, model_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit). No shuffle.

    Null and empty texts: 0 bytes, 0 tokens. Null ids and repeated rows: each row gives its own row. An empty
    table gives an empty result. Columns other than the two named are ignored. Texts are taken whole.
    """
    with open(model_path, "rb") as f:
        model = PieceModel.from_bytes(f.read())
    proven = model.proven()
    source = fold(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType

    def make():
        counts = Counts(model, proven)

        def act(text: str | None) -> tuple[int, int, bool]:
            counts.forget()
            n = count_tokens(text or "", counts)
            return len((text or "").encode()), n, n > limit

        return act

    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema([("doc_id", to_arrow_type(id_type)), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return source.mapInArrow(per_row(out, make), f"doc_id {id_type.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
