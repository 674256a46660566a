"""How far the sources of a language differ in their terms, by a token-start pointer sort.

A shard of documents is one buffer of bytes per slice. Pointers to all term starts are
sorted by a multikey quicksort whose characters are eight bytes: pointers are ordered
by the character at the current depth, equal ones go on to the next
character until their terms end. Equal runs of the result are the terms; within a
run the pointers stay in text order and texts lie in group order, so each run
yields, per group, how often the term occurs and in how many documents. Spark adds
these up over all slices, map-side first, so a term or a source with a third of all
rows is one row per task.

Probabilities are integers in billionths with two added to every count. The divergence of a
term is (p - q)^2 / (p + q), rounded down; all sums are of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.bytehash import LOWER, column_bytes, parts
from episodica.llm.shared import BROADCAST_ROWS, staged

LEAST_DOCUMENTS = 10
TOP = 10
#: Bytes of text in one slice (a longer text is a slice of its own), and bytes of a term that are compared as numbers.
SLICE_BYTES, NUMERIC_BYTES = 8 << 20, 64

_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MASKS = np.array([(~0 << 8 * (8 - k)) & (1 << 64) - 1 for k in range(9)], np.uint64)

_COUNTS = "lang string, source string, term string, n long, documents long"


def term_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every term and the byte after it; terms do not cross rows."""
    solid = _TERM[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    opens[firsts] |= solid[firsts]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | opens[1:]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def pointer_sort(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their terms, in text order among equal terms, and where each run of equal terms begins."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))

    def character(at: np.ndarray, depth: int) -> np.ndarray:
        left = np.clip(ends[at] - starts[at] - depth, 0, 8)
        return eight[np.minimum(starts[at] + depth, len(data))].astype(np.uint64) & _MASKS[left]

    order = np.arange(len(starts))
    opens = np.zeros(len(starts), bool)  # places where a term differs from the one before
    opens[:1] = True
    places, segment, depth = order.copy(), np.zeros(len(order), np.int64), 0  # places still unresolved, by segments of equal beginnings
    while len(places) and depth < NUMERIC_BYTES:
        keys = character(order[places], depth)
        by = np.argsort(keys, kind="stable") if depth == 0 else np.lexsort((keys, segment))
        keys, segment = keys[by], segment[by]
        order[places] = order[places[by]]
        new = np.ones(len(places), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (segment[1:] != segment[:-1])
        opens[places] |= new
        run = np.cumsum(new) - 1
        at = order[places]
        # what goes on: runs of several pointers of which one's term reaches further; a term that ends here comes first there
        more = ((np.bincount(run) > 1) & (np.bincount(run, ends[at] - starts[at] > depth + 8) > 0))[run]
        places, segment, depth = places[more], run[more], depth + 8
    # beginnings that stay equal for long: compared as whole byte strings
    for chunk in np.split(places, np.flatnonzero(np.diff(segment)) + 1) if len(places) else ():
        terms = [(data[starts[i] : ends[i]].tobytes(), i) for i in order[chunk].tolist()]
        terms.sort()
        order[chunk] = [i for _, i in terms]
        opens[chunk[1:]] |= np.array([a[0] != b[0] for a, b in zip(terms[1:], terms)], bool)
    return order, np.flatnonzero(opens)


def _slice_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """Occurrences and documents of every term of a slice by group, and each group once without a term."""
    groups = pa.StructArray.from_arrays([lang, source], ["lang", "source"])
    codes = pa.array([f"{len(g['lang'])} {g['lang']}{g['source']}" for g in groups.to_pylist()]).dictionary_encode()
    group = codes.indices.to_numpy(zero_copy_only=False)
    by = np.argsort(group, kind="stable")
    group = group[by]
    text = text.take(pa.array(by))
    data, offsets = column_bytes(text)
    data = LOWER[data]
    starts, ends = term_starts(data, offsets)
    order, opens = pointer_sort(data, starts, ends)
    row = np.searchsorted(offsets, starts, "right")[order] - 1
    run = np.zeros(len(order), np.int64)
    run[opens] = 1
    run = np.cumsum(run) - 1
    owner = group[row]
    # a run's pointers are in text order, so rows and groups within a run are in order too
    new_row = np.ones(len(order), bool)
    new_row[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    new_cell = np.ones(len(order), bool)
    new_cell[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    cells = np.flatnonzero(new_cell)
    n = np.diff(np.append(cells, len(order)))
    documents = np.add.reduceat(new_row, cells, dtype=np.int64) if len(cells) else np.zeros(0, np.int64)
    spelled = pa.array([data[a:b].tobytes().decode() for a, b in zip(starts[order[opens]].tolist(), ends[order[opens]].tolist())], pa.string())
    first = np.flatnonzero(np.diff(group, prepend=-1))  # a row of each group
    owner_row = np.concatenate([by[first[owner[cells]]], by[first]])
    none = len(first)
    return pa.RecordBatch.from_arrays([
        lang.take(pa.array(owner_row)), source.take(pa.array(owner_row)),
        pa.concat_arrays([spelled.take(pa.array(run[cells])), pa.nulls(none, pa.string())]),
        pa.array(np.concatenate([n, np.zeros(none, np.int64)])), pa.array(np.concatenate([documents, np.zeros(none, np.int64)])),
    ], ["lang", "source", "term", "n", "documents"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source, text = (c.fill_null("") for c in batch.columns)
        for lo, hi in parts(column_bytes(text)[1], SLICE_BYTES, 1 << 20):
            yield _slice_counts(*(c.slice(lo, hi - lo) for c in (lang, source, text)))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents): occurrences and documents of every term in every group; a null term marks the group itself."""
    rows = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _billionths(part: Column, whole: Column) -> Column:
    """floor(10^9 * part / whole) in longs, for wholes up to 9 * 10^13: five digits, then four."""
    first = 100_000 * part
    return _div(first, whole) * 10_000 + _div(10_000 * (first % whole), whole)


def _probability(n: Column, total: Column, kept: Column) -> Column:
    return 1 + _billionths(n + 2, total + 2 * kept)


def _divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _sized(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Mark for broadcast if the table of groups, from which ``df`` comes, is counted small."""
    return F.broadcast(df) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Divergence sums of all pairs of a language's sources over the task's terms: one small matrix per language."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        base, at, p = batch.column(1), batch.column(2), batch.column(3)
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero(codes == code)
            absent = np.array(base[int(rows[0])].as_py(), np.int64)
            total = sums.setdefault(lang, np.zeros((len(absent), len(absent)), np.int64))
            step = max(1, (1 << 19) // len(absent))
            for lo in range(0, len(rows), step):
                some = pa.array(rows[lo : lo + step])
                held = at.take(some)
                dense = np.tile(absent, (len(some), 1))
                dense[np.repeat(np.arange(len(some)), held.value_lengths().to_numpy(zero_copy_only=False)), held.flatten().to_numpy()] = p.take(some).flatten().to_numpy()
                for g in range(len(absent) - 1):
                    gap, both = dense[:, g + 1 :] - dense[:, g : g + 1], dense[:, g + 1 :] + dense[:, g : g + 1]
                    total[g, g + 1 :] += (gap * gap // both).sum(0)
    for lang, total in sums.items():
        one, other = np.triu_indices(len(total), 1)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(one), pa.string()), pa.array(one), pa.array(other), pa.array(total[one, other])],
                                         ["lang", "one", "other", "value"])


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs`` (text, lang, source).

    Part ``pair`` has the divergence to every other source of the language over the terms that are in at least
    ``least_documents`` documents of the language, part ``term`` the ``top`` terms that the source has more often than the
    language. Defined cases: null text, lang and source are ''; a group without terms and a language without kept terms
    still have their pairs (value 0 without kept terms); repeated rows are documents of their own; equal values rank by item;
    a term may be of any length; further columns are ignored; an empty table gives an empty result.

    Sources of a language are the sides of a matrix in every task, as they are of the result.
    """
    counts = staged(term_counts(docs), "terms")
    known = counts.where("term IS NOT NULL")
    kept = known.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("documents").alias("documents"))
    kept = staged(kept.where(F.col("documents") >= least_documents).select("lang", "term", "n_lang"), "kept")
    held = staged(known.select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "held")

    group = Window.partitionBy("lang")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("total_lang"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "total_lang")])
    groups = staged(groups.withColumn("at", F.row_number().over(group.orderBy("source")) - 1), "groups")

    p = _probability(F.col("n"), F.col("total"), F.col("kept"))
    q = _probability(F.col("n_lang"), F.col("total_lang"), F.col("kept"))
    cells = held.join(_sized(groups, groups), ["lang", "source"]).select("lang", "source", "term", "at", p.alias("p"), q.alias("q"))

    # of a term that a source lacks, p is the same for all terms
    absent = groups.where("kept > 0").select("lang", "at", _probability(F.lit(0).cast("long"), F.col("total"), F.col("kept")).alias("p"))
    absent = absent.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "p"))).alias("base")).select("lang", F.col("base.p").alias("base"))
    terms = cells.groupBy("lang", "term").agg(F.collect_list(F.struct("at", "p")).alias("cells"))
    terms = terms.join(_sized(absent, groups), "lang").select("lang", "base", F.col("cells.at").alias("at"), F.col("cells.p").alias("p"))
    sums = terms.mapInArrow(_pair_sums, "lang string, one long, other long, value long").groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))

    # every pair of sources of a language, with or without kept terms: as many rows as the result has
    names = groups.groupBy("lang").agg(F.collect_list(F.struct("at", "source")).alias("others"))
    pairs = groups.join(_sized(names, groups), "lang").select("lang", "source", "at", F.explode("others").alias("o")).where("o.at != at")
    pairs = pairs.select("lang", "source", F.col("o.source").alias("item"), F.least("at", "o.at").cast("long").alias("one"), F.greatest("at", "o.at").cast("long").alias("other"))
    pairs = pairs.join(sums, ["lang", "one", "other"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    tops = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(ranked)
