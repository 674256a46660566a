"""Language identification by compression with per-language dictionaries.

Each language has a raw-content dictionary of sample text. A text is compressed
with every dictionary; the language whose dictionary makes it smallest wins.
How much smaller than the runner-up it gets is the margin; a narrow margin is
reported as not confident.
"""

from __future__ import annotations

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from episodica.llm.shared import small, staged

#: Bounds of the sample a dictionary is made of: pieces per language and bytes per piece.
PIECES = 256
PIECE_CHARS = 512
#: Compression level of all texts, short or long.
LEVEL = 12
#: Margins below this are narrow.
NARROW = 0.01

_LETTER = regex.compile(r"\p{L}")


def dictionaries(labelled: DataFrame, pieces: int = PIECES, chars: int = PIECE_CHARS) -> dict[str, bytes]:
    """language -> raw content, at most ``pieces`` x ``chars`` characters each.

    ``labelled`` has (text, lang). One piece is taken of each sampled text, at a place and in an
    order that a hash of the text decides, so repeated rows add nothing and row order does not matter.
    """
    h = F.xxhash64("text")
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - F.lit(chars), F.lit(1))).cast("int") + 1
    sample = labelled.where("lang IS NOT NULL AND length(text) > 0").select(
        "lang", h.alias("h"), F.substring("text", start, F.lit(chars)).alias("piece"))
    # copies count once, before the ranking; only hashes travel for that, and pieces of the chosen texts afterwards
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    first = sample.select("lang", "h").distinct().withColumn("k", rank).where(F.col("k") <= pieces).select("lang", "h")
    chosen = sample.join(small(staged(first, "dictionary")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    chosen = chosen.groupBy("lang").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("h", "piece"))), lambda x: x["piece"]), "\n").alias("content"))
    return {r["lang"]: r["content"].encode() for r in chosen.collect()}


def _classify(content):
    def task(batches):
        langs = sorted(content.value)
        presses = {}
        for lang in langs:
            held = zstandard.ZstdCompressionDict(content.value[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            presses[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False,
                                                     write_dict_id=False)
        for batch in batches:
            out = []
            for text in batch.column(2):
                text = text.as_py()
                if text is None or not langs or not _LETTER.search(text):
                    out.append(("und", 0.0, False))
                    continue
                raw = text.lower().encode()
                sizes = sorted((len(presses[lang].compress(raw)), lang) for lang in langs)
                best = sizes[0]
                margin = 1.0 - best[0] / sizes[1][0] if len(sizes) > 1 else 1.0
                out.append((best[1], margin, margin >= NARROW))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "confident"])
    return task


def identify(spark: SparkSession, docs: DataFrame, content: dict[str, bytes]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, confident) of whole texts; ``docs`` has (doc_id, held_out, text).

    score is the margin over the runner-up, 0 to 1. Null text, text without a letter (Unicode class L), and any text when no language was
    learned give ``und``, score 0. Equal sizes give the language that sorts first, with score 0.
    """
    return docs.select("doc_id", "held_out", "text").mapInArrow(
        _classify(spark.sparkContext.broadcast(content)),
        "doc_id long, held_out boolean, lang_pred string, score double, confident boolean")


def learn_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out quarter, predict all of them.

    Held out are those with crc32(doc_id as text) mod 4 = 2. A null doc_id is not held out and not
    learned from; repeated rows are each returned; columns other than doc_id, text and lang are ignored.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
        (fold != 2).alias("learn"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return identify(docs.sparkSession, rows, dictionaries(rows.where("learn").select("text", "lang")))
