"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Runs of ``SEED`` words of the test items are looked up in all documents. Every
seed counts, however many documents hold it: a part of an item that very many
documents copy is looked at in each of them. Seeds on similar diagonals open a
window of the document. A window that holds too few of the item's words for the
score asked for is left at once, as no alignment can reach it; the others are
aligned with the item word by word. The score is the alignment's share of a
perfect one, so edited, shortened and paraphrased copies count. An item of a few
words has its start as its only seed and must stand in the document as it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.bytehash import LOWER, Ranges, column_bytes, parts, shingles, signed
from episodica.llm.shared import small, staged

SEED = 3
#: Items of fewer words count only where the whole item stands word for word.
LEAST_WORDS = 8
#: Seeds up to this number are broadcast; more are joined by a shuffle.
SEED_ROWS = 2_000_000
#: Diagonals are opened together in steps of this many words, with as many words around.
BAND = 32
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.4
_NONE = -(1 << 63)

#: Bytes inside words: ASCII letters and digits, and all bytes of other characters.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _word_values(data: np.ndarray, offsets: np.ndarray):
    """Fingerprint, row and place of every word of a slice of texts, in lower case (A-Z)."""
    solid = _INSIDE[data]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    opens[firsts] |= solid[firsts]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | opens[1:]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    return Ranges(LOWER[data]).of(starts, ends), rows, counts


def _slices(column: pa.Array):
    data, offsets = column_bytes(column)
    for lo, hi in parts(offsets):
        values, rows, counts = _word_values(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, hi, values, rows, counts


def _item_words(batches):
    for batch in batches:
        for lo, hi, values, _, counts in _slices(batch.column(1)):
            at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at), pa.array(signed(values)))], ["item_id", "words"])


def _grams(wanted, sizes):
    """(gram, doc, th, place) of the seeds in each document, which have ``sizes`` words; all of them if no seeds are given."""
    def task(batches):
        for batch in batches:
            ids, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for lo, hi, values, rows, counts in _slices(batch.column(2)):
                for size in sizes:
                    grams, owner = shingles(values, rows, hi - lo, size)
                    place = np.arange(len(grams)) - np.searchsorted(owner, owner)
                    ok = counts[owner] >= size
                    if wanted is not None:
                        seeds = wanted.value
                        ok &= (seeds[np.minimum(np.searchsorted(seeds, grams), len(seeds) - 1)] == grams) if len(seeds) else False
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(grams[ok])), pa.array(ids[lo:hi][owner[ok]]), pa.array(hashes[lo:hi][owner[ok]]), pa.array(place[ok].astype(np.int32))],
                        ["gram", "doc", "th", "place"])
    return task


def _item_grams(batches):
    """Every run of ``SEED`` words of an item; of a short item only the first, or all it has."""
    for batch in batches:
        items, lists = batch.column(0), batch.column(1)
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        at = lists.offsets.to_numpy()
        counts = np.diff(at)
        grams, owner = shingles(values[at[0] : at[-1]], np.repeat(np.arange(len(items)), counts), len(items), SEED)
        place = np.arange(len(grams)) - np.searchsorted(owner, owner)
        ok = (counts[owner] >= LEAST_WORDS) | (place == 0)
        size = np.minimum(counts[owner], SEED)[ok]
        yield pa.RecordBatch.from_arrays([pa.array(signed(grams[ok])), items.take(pa.array(owner[ok])), pa.array(place[ok].astype(np.int32)),
                                          pa.array(size.astype(np.int32))], ["gram", "item_id", "at", "size"])


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and the end (exclusive) in each."""
    step = np.arange(len(words) + 1) * -GAP
    row, best = np.zeros(len(words) + 1, np.int64), (0, 0, 0)
    for i, w in enumerate(item):
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(words == w, MATCH, MISMATCH), row[1:] + GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(new, 0) + step) - step, 0)
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i + 1, j)
    return best


def _aligned(threshold: float):
    def task(batches):
        for batch in batches:
            out = []
            texts: dict[int, np.ndarray] = {}
            for lo, hi, values, _, counts in _slices(batch.column(2)):
                at = np.concatenate([[0], np.cumsum(counts)])
                for k in range(lo, hi):
                    texts[k] = values[at[k - lo] : at[k - lo + 1]]
                for k in range(lo, hi):
                    for w in batch.column(3)[k].as_py():
                        item = np.array(w["words"], np.int64).view(np.uint64)
                        first = max(0, w["low"] - BAND)
                        part = texts[k][first : w["high"] + len(item) + BAND]
                        least = threshold if len(item) >= LEAST_WORDS else 1.0
                        # each matched word of the item gives MATCH at most
                        if np.isin(item, part).sum() / len(item) < least:
                            continue
                        score, i, j = align(item, part)
                        share = score / (MATCH * len(item))
                        if share >= least:
                            _, _, back = align(item[:i][::-1], part[:j][::-1])
                            out.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), w["item_id"], share, first + j - back, first + j))
                    texts.pop(k)
            cols = list(zip(*out)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc", "th", "item_id", "score", "first_word", "end_word"])
    return task


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, th, item_id, score, first_word, end_word) of the best alignment of each document and item that reach the threshold.

    ``doc`` is the doc_id (smallest long for null) and ``th`` a hash of the text, which tells rows of one id apart.
    """
    keyed = _keyed(docs)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = staged(items.distinct().mapInArrow(_item_words, "item_id long, words array<long>").where(F.size("words") > 0), "items")
    seeds = staged(items.mapInArrow(_item_grams, "gram long, item_id long, at int, size int"), "seeds")
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # from 1 to SEED
    kinds = seeds.select("gram").distinct()
    if kinds.count() <= SEED_ROWS:
        grams = np.sort(kinds.toPandas()["gram"].to_numpy(np.int64).view(np.uint64))
        hits = keyed.mapInArrow(_grams(docs.sparkSession.sparkContext.broadcast(grams), sizes), "gram long, doc long, th long, place int")
    else:
        hits = keyed.mapInArrow(_grams(None, sizes), "gram long, doc long, th long, place int").join(kinds, "gram", "left_semi")
    hits = staged(hits, "hits")

    met = hits.join(small(seeds.drop("size")), "gram").withColumn("low", F.col("place") - F.col("at"))
    windows = met.groupBy("doc", "th", "item_id", F.floor(F.col("low") / BAND).alias("band")).agg(
        F.min("low").cast("long").alias("low"), F.max("low").cast("long").alias("high"))
    windows = staged(windows, "windows")
    opened = windows.join(small(items), "item_id").groupBy("doc", "th").agg(
        F.collect_list(F.struct("item_id", "low", "high", "words")).alias("windows"))
    ids = small(windows.select("doc").distinct())
    texts = keyed.join(ids, "doc", "left_semi").join(opened, ["doc", "th"])
    found = texts.select("doc", "th", "text", "windows").mapInArrow(
        _aligned(threshold), "doc long, th long, item_id long, score double, first_word long, end_word long")
    best = found.groupBy("doc", "th", "item_id").agg(F.max(F.struct("score", (-F.col("first_word")).alias("first"), "end_word")).alias("b"))
    return best.select("doc", "th", "item_id", F.col("b.score").alias("score"), (-F.col("b.first")).alias("first_word"), F.col("b.end_word").alias("end_word"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): documents with a copy of a test item, edited or not.

    Words are stretches of ASCII letters, digits and other characters, in lower case. Defined cases: null and empty texts and
    null items match nothing, nor do items without a word; an item below ``LEAST_WORDS`` words matches only as a whole; equal rows give one row; a null
    doc_id is kept as null; an empty table on either side gives no row.
    """
    found = matches(docs, benchmark, threshold)
    return found.select(F.when(F.col("doc") != _NONE, F.col("doc")).alias("doc_id"), "item_id", F.round("score", 6).alias("score"), "first_word", "end_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without a copy of a test item, with their own columns."""
    bad = staged(matches(docs, benchmark, threshold).select(F.col("doc").alias("_d_doc"), F.col("th").alias("_d_th")).distinct(), "contaminated")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))
    th = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(small(bad), (doc == F.col("_d_doc")) & (th == F.col("_d_th")), "left_anti")
