"""Operator 5: language identification by compression.

For each language of the labelled rows a raw-content zstandard dictionary is put together from slices of
its documents. Of dictionaries and texts only the lower-case words count: ASCII digits and marks are
blanks. A text is cut into blocks of ``BLOCK`` bytes, every block is compressed with every language's
dictionary, and the language with the smallest sum of sizes is chosen. Where a text of a single block has
a narrow margin, it is compressed again at a higher level; on a tie the first in text order is taken. The margin to the second language, as a share of the second's size, is the score; below
``MIN_MARGIN`` the choice is marked as rejected.

A dictionary holds slices of at most ``SLICE`` characters of ``PER_LANG`` documents, those with the
smallest hash of doc_id: this bounded sample is all that the fit uses. Predictions read whole texts.

Null text and text without a letter give ``und`` with score 0, and so does everything where no language
was learned; with a single language the score is 1. Null lang, null doc_id and texts without a letter
are not learned from. Repeated rows are all returned; an empty table gives no rows. Only doc_id, text
and, for the fit, lang are read.
"""

from __future__ import annotations

from functools import cache

import regex
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.llm.common import in_key, map_batches
from inkwell.llm.registry import query
from inkwell.sources.tables import read_table

#: The bounds of the fit: documents of a language, and characters of each.
PER_LANG, SLICE = 500, 600
#: Bytes that are compressed at a time, and the levels of the first and the second look.
BLOCK, LEVEL, SECOND = 1 << 14, 3, 12
MIN_MARGIN, NARROW = 0.02, 0.08
#: Languages beyond these, by number of learned documents, are refused: the dictionaries go to every worker.
MAX_LANGS = 256

_LETTER = regex.compile(r"\p{L}")
_MARKS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def words(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_MARKS).split())


def fit(docs: DataFrame, held_out: Column | None = None, per_lang: int = PER_LANG) -> dict[str, bytes]:
    """A raw dictionary for each language; at most PER_LANG * SLICE characters of each reach the driver."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if held_out is not None:
        rows = rows.where(~held_out)
    rows = rows.select("lang", F.xxhash64("doc_id").alias("h"), F.substring("text", 1, SLICE).alias("part"))
    # The rank is cut before the shuffle, so a hot language sends at most per_lang rows from a task.
    best = W.partitionBy("lang").orderBy("h", "part")
    picked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_lang)
    parts: dict[str, list[str]] = {}
    found = picked.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "part"))).alias("parts"))
    for r in found.limit(MAX_LANGS + 1).collect():
        # The best matches lie at the dictionary's end; the order is of no weight for random documents.
        parts[r.lang] = [p.part for p in r.parts]
    if len(parts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return {lang: words("\n".join(p)) for lang, p in parts.items()}


@cache
def _compressors(model: tuple[tuple[str, bytes], ...], level: int) -> list[tuple[str, zstd.ZstdCompressor]]:
    out = []
    for lang, raw in model:
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstd.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return out


def classify(text: str, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float]:
    """(language, margin) of a whole text."""
    if not model or not text or not _LETTER.search(text):
        return "und", 0.0
    raw = words(text)
    blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
    for level in (LEVEL, SECOND):
        sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in _compressors(model, level))
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        margin = 1 - sizes[0][0] / max(1, sizes[1][0])
        if len(blocks) > 1 or margin >= NARROW:
            break
    return sizes[0][1], margin


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(sorted(dictionaries.items())))

    def apply(d: dict) -> dict:
        model = sent.value
        found = [classify(t or "", model) for t in d["text"]]
        return {"doc_id": d["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found],
                "rejected": [f[1] < min_margin for f in found]}

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), apply,
                       "doc_id long, lang_pred string, score double, rejected boolean")


@query("op5_langid")
def op5_langid(spark, sf_dir):
    """Every document's language; rows with crc32(doc_id) mod 4 = 2 are held out of the fit."""
    docs = read_table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs, in_key(2, 4)))
    return out.select("doc_id", in_key(2, 4).alias("held_out"), "lang_pred", "score", "rejected")
