"""Language identification by compression.

A text is compressed with one zstandard raw-content dictionary for each
language; the language whose dictionary gives the fewest bytes is chosen, and
the choice is rejected when the runner-up is nearly as small.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from finlark.llm.common import NO_BOUND, hash_bound, map_batches, with_fields

WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Dictionary content and count of training rows by language."""

    content: dict[str, bytes]
    rows: dict[str, int]
    level: int = 6
    chunk: int = 1 << 14

    def compressors(self) -> list[tuple[str, zstandard.ZstdCompressor]]:
        """Languages in order of training rows, most first: ties of sizes go to the first."""
        found = []
        for lang in sorted(self.content, key=lambda x: (-self.rows[x], x)):
            data = zstandard.ZstdCompressionDict(self.content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=self.level)
            found.append((lang, zstandard.ZstdCompressor(level=self.level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)))
        return found


def normal(text: str) -> str:
    """Letters only, lower case, one space between words."""
    return f" {' '.join(WORD.findall(text.lower()))} "


def window(text: Column, chars: int) -> Column:
    """At most ``chars`` characters of a text, from a place that its hash picks."""
    spare = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substring(text, (F.pmod(F.xxhash64(text, F.lit("place")), spare) + 1).cast("int"), F.lit(chars))


def least(rows: DataFrame, k: int) -> list[Row]:
    """The k different texts of each language that hash least, with their ranks."""
    order = Window.partitionBy("lang").orderBy("h", "part")
    return rows.groupBy("lang", "h").agg(F.min("part").alias("part")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).select("lang", "k", "part").collect()


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample_rows: int = 96, sample_chars: int = 700, dict_bytes: int = 1 << 16, model_bytes: int = 1 << 25) -> LanguageModel:
    """Dictionaries from a bounded sample of labelled rows.

    Of each language at most ``sample_rows`` different texts (smallest hashes first) reach the
    driver, of each a window of at most ``sample_chars`` characters at a place that its hash picks.
    They fill the dictionary in that order up to ``dict_bytes``, which the defaults just do. A language with any text has a
    dictionary, however many there are: where all would take more than ``model_bytes``, rows and bytes are cut to equal shares of these.
    Rows with a null text or language teach nothing; a text that repeats counts once.
    """
    known = docs.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), window(F.col(text), sample_chars).alias("part")).where("lang is not null and part is not null")
    found = known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("kinds")).collect()
    counts = {r.lang: r.n for r in found}
    sample_rows = max(1, min(sample_rows, model_bytes // (sample_chars * max(1, len(counts)))))
    # Texts over their language's bound go at once, so that a language's one task gets a few hundred rows from all others.
    bounds = {r.lang: hash_bound(sample_rows, r.kinds) for r in found}
    picked = least(known.where(F.col("h") <= F.create_map(*[F.lit(x) for b in bounds.items() for x in b])[F.col("lang")]), sample_rows) if bounds else []
    # The bound rests on an estimate: a language with too few texts under it is read again without one.
    got = Counter(r.lang for r in picked)
    short = [x for x, b in bounds.items() if b < NO_BOUND and got[x] < sample_rows]
    if short:
        picked = [r for r in picked if r.lang not in short] + least(known.where(F.col("lang").isin(short)), sample_rows)
    share = min(dict_bytes, model_bytes // max(1, len(counts)))
    content: dict[str, str] = {}
    for r in sorted(picked, key=lambda r: (r.lang, r.k)):
        content[r.lang] = content.get(r.lang, "") + normal(r.part)
    return LanguageModel({k: v.encode()[:share] for k, v in content.items()}, {k: counts[k] for k in content})


def classify(docs: DataFrame, model: LanguageModel, *, text: str = "text", min_margin: float = 0.005) -> DataFrame:
    """Every row with lang_pred, score (0 to 1), margin and rejected.

    Columns of those names in ``docs`` are replaced. Whole texts are encoded,
    in chunks of ``model.chunk`` bytes so that the dictionary stays in reach.
    margin: how many bytes the runner-up needs more, as a share of all it needs;
    rejected: it is under ``min_margin`` or the language is ``und``, which
    null texts, texts without letters, and all texts of an empty model get.
    """
    made = ["lang_pred", "score", "margin", "rejected"]
    rest = docs.drop(*made)
    state: list = []

    def run(batch: pa.RecordBatch) -> pa.Table:
        if not state:
            state.extend(model.compressors())
        langs, scores, margins = [], [], []
        for value in batch.column(text).to_pylist():
            words = normal(value) if value is not None else "  "
            if words == "  " or not state:
                langs.append(UNDETERMINED), scores.append(0.0), margins.append(0.0)
                continue
            data = words.encode()
            chunks = [data[i : i + model.chunk] for i in range(0, len(data), model.chunk)]
            sizes = [sum(len(c.compress(x)) for x in chunks) for _, c in state]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            others = sorted(s - sizes[best] for i, s in enumerate(sizes) if i != best)
            langs.append(state[best][0])
            scores.append(1 / (1 + sum(2.0 ** -min(60, x) for x in others)))
            margins.append(others[0] / (sizes[best] + others[0]) if others else 1.0)
        out = pa.Table.from_batches([batch])
        out = out.append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(scores, pa.float64())).append_column("margin", pa.array(margins, pa.float64()))
        return out.append_column("rejected", pa.array([x == UNDETERMINED or m < min_margin for x, m in zip(langs, margins, strict=True)], pa.bool_()))

    return map_batches(rest, run, with_fields(rest, "lang_pred string, score double, margin double, rejected boolean"))
