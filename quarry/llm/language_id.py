"""Language identification by compression.

Each language has a raw-content dictionary of its own texts. A text is compressed against every dictionary and takes
the language under which it is smallest. Where the second smallest is nearly as small, the choice is marked rejected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import fold, is_held_out, per_row

UNKNOWN = "und"
#: Below this many bytes a frame may hold the text uncompressed, whatever the dictionary. Such texts follow a passage
#: of the dictionary itself, which makes every frame a compressed one.
SHORT, PRIMER = 256, 96
#: Bytes of difference in size that divide a language's weight by e.
BYTES_PER_E = 4.0


@dataclass(frozen=True)
class LanguageModel:
    dictionaries: dict[str, bytes]
    level: int
    min_margin: float

    def classifier(self):
        import zstandard

        coders = []
        for language, content in sorted(self.dictionaries.items()):
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(level=self.level)
            coder = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_content_size=False, write_checksum=False, write_dict_id=False)
            coders.append((language, coder.compress, content[-2 * PRIMER : -PRIMER]))

        def classify(text: str | None) -> tuple[str, float, float, bool]:
            """Language, score, margin (share by which the second frame is larger), rejected."""
            if not coders or not text or not any(map(str.isalpha, text)):
                return UNKNOWN, 0.0, 0.0, True
            data = f" {text.lower()} ".encode()
            short = len(data) < SHORT
            sizes = sorted((len(compress(primer + data if short else data)), language) for language, compress, primer in coders)
            best, language = sizes[0]
            margin = (sizes[1][0] - best) / best if len(sizes) > 1 else 1.0
            score = 1 / sum(math.exp(max(-700.0, (best - size) / BYTES_PER_E)) for size, _ in sizes)
            return language, score, margin, margin < self.min_margin

        return classify


def fit(
    docs: DataFrame, rows_per_language: int = 600, dictionary_bytes: int = 96_000, level: int = 9, min_margin: float = 0.01, most_languages: int = 500,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> LanguageModel:
    """Dictionaries from a bounded sample: rows_per_language rows of each language, those with the smallest hashes of
    their ids, and an excerpt of each from a place that the hash chooses. Held-out rows and null labels are left out,
    and so are languages beyond the most_languages most frequent ones (of equally frequent ones the last by name).
    The sample is found from ids and labels alone, by a bound on the hash for each language: no row moves but the few
    below it. Texts are then read for the sample only. Of an id's several texts the smallest excerpt counts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang")).where(F.col(lang_col).isNotNull() & ~is_held_out(F.col(id_col)))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "lang"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    bounds = docs.sparkSession.createDataFrame([(r["lang"], (2.0 * rows_per_language + 50) / r["count"]) for r in sizes], "lang string, share double")
    near = rows.join(F.broadcast(bounds), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share")).select("lang", "h", "doc_id").distinct()
    first = Window.partitionBy("lang").orderBy("h", "doc_id")  # 2 * rows_per_language + 50 ids a language are expected here
    sample = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= rows_per_language).select("doc_id", "lang", "h")
    width = max(200, dictionary_bytes // rows_per_language)
    text = F.col("text")
    start = F.pmod(F.col("h"), F.greatest(F.length(text) - width, F.lit(1))) + 1
    excerpts = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(sample), ["doc_id", "lang"])  # rows_per_language rows a language, ids only
        .where(text.isNotNull())
        .groupBy("lang", "h", "doc_id").agg(F.min(F.substring(text, start.cast("int"), F.lit(width))).alias("text"))
    )
    parts: dict[str, dict[str, None]] = {}
    for row in sorted(excerpts.collect(), key=lambda r: (r.lang, r.h, str(r.doc_id), r.text)):
        parts.setdefault(row.lang, {})[row.text.lower()] = None
    contents = {language: " ".join(texts).encode()[-dictionary_bytes:] for language, texts in parts.items()}
    return LanguageModel({k: v for k, v in contents.items() if len(v) >= 8}, level, min_margin)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, lang_pred, score (0 to 1), margin, rejected. No shuffle; texts are taken whole, however long.

    Null texts and texts without a letter are `und` with score 0, and so is everything if nothing was learned. Of
    languages with equal sizes the first by name is taken (and the row is rejected). Repeated rows each give a row,
    an empty table an empty result; columns other than the two named are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    source = fold(docs, id_col, text_col)
    id_type = source.schema["doc_id"].dataType
    out = pa.schema([("doc_id", to_arrow_type(id_type)), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])
    return source.mapInArrow(per_row(out, model.classifier), f"doc_id {id_type.simpleString()}, lang_pred string, score double, margin double, rejected boolean")
