"""Similarity self-join on word shingles by a token-group matrix.

Documents are put into groups of similar ones; the matrix holds, per token and
group, that some member has the token, with the best position and the range of
set sizes of these members. A query document that meets a group in the matrix
gets an upper bound of its overlap with any member; only groups whose bound
reaches the threshold are opened, and only opened members are compared exactly.

* Tokens have one global order: rare tokens first (by hash), tokens of more than
  T documents last. Two sets with Jaccard >= t share a token among the first
  n - ceil(t n) + 1 of either, so the matrix needs these prefixes only. If the first
  shared token stands at places i and j, the i + j tokens before it are not shared;
  that bounds the overlap of a document with another, or with a group by its
  smallest place.
* T grows with the corpus so that there are at most ``HOT_TOKENS`` tokens above
  it; that proven bound allows them to be broadcast. The order affects cost only.
* Documents with equal sets are one class and take part once, by their smallest id.
* Groups come from a first round in which the documents of a token are compared with
  one leader each (the most central one), never with each other; in the second
  round the documents of a group are not compared again. A family of thousands of
  near copies so costs a comparison per document, not per pair.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.bytehash import LOWER, Ranges, column_bytes, mix, parts, shingles, signed, words
from episodica.llm.components import components
from episodica.llm.shared import dropped, small, staged, text_rows

#: Most tokens that may rank as frequent: 8 MB as sorted longs.
HOT_TOKENS = 1 << 20
#: Leading bits of a token in the filter of tokens that some documents share (8 MB).
BITMAP = 26
#: Bits of a document's parity marks. Each token that two sets do not share changes one bit at most, so the
#: number of different bits is a lower bound of the number of such tokens, close to it for similar sets.
MARKS = 2048
#: Parity marks of a document in an opened pair: at least so many bits per token, so that long sets do not fill them.
WIDE = 4
#: Longs to which the marks are folded for the matrix; folding keeps the bound.
FOLDED = 4
#: A token of fewer documents never ranks as frequent.
HOT_LEAST = 16


def _prefix(n: np.ndarray, t: Fraction) -> np.ndarray:
    return n - -(-n * t.numerator // t.denominator) + 1


def _sets(batch: pa.RecordBatch, size: int):
    """For slices of a batch (doc, text): documents, sorted distinct tokens as one array, and where each document's begin."""
    data, offsets = column_bytes(batch.column(1))
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    for lo, hi in parts(offsets):
        at = offsets[lo : hi + 1] - offsets[lo]
        text = LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, rows = words(text, at)
        tokens, owner = shingles(Ranges(text).of(starts, ends), rows, hi - lo, size)
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        tokens, owner = tokens[fresh], owner[fresh]
        yield ids[lo:hi], tokens, np.searchsorted(owner, np.arange(hi - lo + 1))


def _lists(tokens: np.ndarray, begin: np.ndarray, count: np.ndarray) -> pa.ListArray:
    """The first ``count`` tokens of each document as a list column."""
    at = np.concatenate([[0], np.cumsum(count)])
    take = np.arange(at[-1]) - np.repeat(at[:-1], count) + np.repeat(begin, count)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(signed(tokens[take])))


def _sketch(size: int, t: Fraction):
    def task(batches):
        for batch in batches:
            for ids, tokens, at in _sets(batch, size):
                n = np.diff(at)
                sums = []
                for salt in (1, 2):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens + np.uint64(salt)), dtype=np.uint64)])
                    sums.append(total[at[1:]] - total[at[:-1]])
                wide = np.where(n > 0, np.minimum(n, 2 * _prefix(n, t)), 0)
                spot = np.repeat(np.arange(len(n)), n) * MARKS + (tokens & np.uint64(MARKS - 1)).astype(np.int64)
                odd = (np.bincount(spot, minlength=len(n) * MARKS) & 1).astype(np.uint8)
                marks = np.packbits(odd, bitorder="little").view(np.int64)
                ends = np.arange(len(n) + 1, dtype=np.int32) * (MARKS // 64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), pa.array(n), pa.array(signed(sums[0])), pa.array(signed(sums[1])), _lists(tokens, at[:-1], wide),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(marks))],
                    ["doc", "n", "sig1", "sig2", "head", "marks"])
    return task


_SKETCH = "doc long, n long, sig1 long, sig2 long, head array<long>, marks array<long>"


def _full_sets(size: int):
    def task(batches):
        for batch in batches:
            for ids, tokens, at in _sets(batch, size):
                yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(tokens, at[:-1], np.diff(at))], ["doc", "tokens"])
    return task


def _wide_marks(size: int):
    """Parity marks of each document, a power of two of longs with ``WIDE`` to 2 * ``WIDE`` bits a token."""
    def task(batches):
        for batch in batches:
            for ids, tokens, at in _sets(batch, size):
                n = np.diff(at)
                longs = 1 << np.ceil(np.log2(np.maximum(n * WIDE / 64, 1))).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(longs)])
                spot = np.repeat(ends[:-1] * 64, n) + (tokens & np.repeat(longs * 64 - 1, n).astype(np.uint64)).astype(np.int64)
                odd = (np.bincount(spot, minlength=ends[-1] * 64) & 1).astype(np.uint8)
                marks = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), marks], ["doc", "m", "marks"])
    return task


def _held(sorted_tokens: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    if not len(sorted_tokens):
        return np.zeros(len(tokens), bool)
    return sorted_tokens[np.minimum(np.searchsorted(sorted_tokens, tokens), len(sorted_tokens) - 1)] == tokens


def _ordered_prefixes(batch: pa.RecordBatch, t: Fraction, often: np.ndarray):
    """Per row (doc, n, tokens): its prefix in the global order, or None if the tokens given do not decide it."""
    ids, sizes, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
    at = lists.offsets.to_numpy()
    tokens = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    common = _held(often, tokens)
    need = _prefix(sizes, t)
    for k in range(len(ids)):
        own, flag = tokens[at[k] : at[k + 1]], common[at[k] : at[k + 1]]
        rare = own[~flag]
        known = len(rare) >= need[k] or len(own) == sizes[k]
        yield ids[k], sizes[k], np.concatenate([rare, own[flag]])[: need[k]] if known else None, len(rare)


def _undecided(t: Fraction, hot):
    def task(batches):
        for batch in batches:
            ids = [d for d, _, own, _ in _ordered_prefixes(batch, t, hot.value) if own is None]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["doc"])
    return task


def _prefix_rows(t: Fraction, hot, bits):
    """(token, doc, n, place, last) of each prefix; ``bits`` leaves out tokens that no other document can share.

    ``last`` is the order of the prefix's last token.
    """
    def task(batches):
        for batch in batches:
            token, place, many, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
            for d, size, own, rare in _ordered_prefixes(batch, t, hot.value):
                if own is None:
                    continue
                at = np.arange(len(own))
                if bits is not None:
                    spot = own >> np.uint64(64 - BITMAP)
                    at = at[(bits.value[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) == 1]
                token.append(own[at])
                place.append(at)
                many.append(len(at))
                # rare tokens in unsigned order below zero, frequent ones after them
                rows.append((d, size, (int(own[-1]) >> 1) - (1 << 63 if len(own) <= rare else 0)))
            doc, n, last = (np.repeat(np.array(c, np.int64), many) for c in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(token))), pa.array(doc), pa.array(n.astype(np.int32)),
                 pa.array(np.concatenate(place).astype(np.int32)), pa.array(last)], ["token", "doc", "n", "place", "last"])
    return task


_ROWS = "token long, doc long, n int, place int, last long"


def _bitmap(tokens: DataFrame) -> np.ndarray:
    """A bit per leading ``BITMAP`` bits of the tokens: a filter of fixed size, merged before it reaches the driver."""
    spot = F.shiftrightunsigned("token", 64 - BITMAP)
    words = tokens.groupBy(F.shiftrightunsigned(spot, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - BITMAP}) & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _possible(t: Fraction, i: str, j: str, nx: str, ny: str) -> str:
    """SQL: documents whose first shared token stands at i and j may reach the threshold."""
    num, den = t.numerator, t.denominator
    return (f"({i} + {j}) * {den + num}L <= ({nx} + {ny}) * {den - num}L "
            f"AND least({nx}, {ny}) * {den}L >= greatest({nx}, {ny}) * {num}L")


def _bounded(met: DataFrame, t: Fraction) -> DataFrame:
    """Pairs from rows (x, y, i, j, nx, ny, lx, ly), one per shared prefix token, that may still reach the threshold.

    With k shared prefix tokens, the last at i and j, all but k of the prefix that ends first are not shared, nor are
    all but k of the other's tokens up to its last shared one.
    """
    num, den = t.numerator, t.denominator
    pairs = met.groupBy("x", "y", "nx", "ny", "lx", "ly").agg(F.count(F.lit(1)).alias("k"), F.max("i").alias("i"), F.max("j").alias("j"))
    size = "n{0} - ceil(n{0} * {1}L / {2}) + 1"
    apart = f"CASE WHEN lx <= ly THEN {size.format('x', num, den)} + j + 1 ELSE {size.format('y', num, den)} + i + 1 END - 2 * k"
    return pairs.where(f"({apart}) * {den + num}L <= (nx + ny) * {den - num}L").select("x", "y").distinct()


def _close(t: Fraction, na: str, nb: str, a: str, b: str) -> str:
    """SQL: the parity marks leave it open that two sets reach the threshold."""
    num, den = t.numerator, t.denominator
    return (f"least({na}, {nb}) * {den}L >= greatest({na}, {nb}) * {num}L AND "
            f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v) * {den + num}L <= ({na} + {nb}) * {den - num}L")


def _of_pairs(pairs: DataFrame, docs: DataFrame, task, schema: str, name: str) -> DataFrame:
    """What ``task`` makes of the texts of all documents in the pairs."""
    involved = staged(pairs.select(F.col("x").alias("doc")).union(pairs.select(F.col("y").alias("doc"))).distinct(), "involved")
    out = staged(docs.join(small(involved), "doc", "left_semi").mapInArrow(task, schema), name)
    dropped(involved)
    return out


def _folded(marks: str) -> str:
    """SQL: wide marks folded to ``longs`` longs. As the place of a token is its last bits, folding gives the marks of that length."""
    return (f"transform(sequence(0, longs - 1), i -> aggregate(sequence(0, cast(size({marks}) / longs as int) - 1), 0L, "
            f"(s, k) -> s ^ {marks}[i + k * longs]))")


def _links(pairs: DataFrame, docs: DataFrame, size: int, t: Fraction) -> DataFrame:
    """The pairs (x, y) that reach the threshold, compared on whole sets.

    A set moves once for each pair it is in, so marks as wide as the sets need go first, at a sixteenth of the size at
    most: long sets fill the fixed marks, which then exclude none of their pairs.
    """
    num, den = t.numerator, t.denominator
    pairs = staged(pairs, "pairs")
    wide = _of_pairs(pairs, docs, _wide_marks(size), "doc long, m long, marks array<long>", "wide")
    both = pairs.join(wide.selectExpr("doc AS x", "m AS mx", "marks AS bx"), "x").join(wide.selectExpr("doc AS y", "m AS my", "marks AS by"), "y")
    both = both.selectExpr("*", "least(size(bx), size(by)) AS longs")
    close = staged(both.where(_close(t, "mx", "my", _folded("bx"), _folded("by"))).select("x", "y").distinct(), "close")
    dropped(pairs, wide)
    sets = _of_pairs(close, docs, _full_sets(size), "doc long, tokens array<long>", "sets")
    both = close.join(sets.select(F.col("doc").alias("x"), F.col("tokens").alias("a")), "x").join(
        sets.select(F.col("doc").alias("y"), F.col("tokens").alias("b")), "y")
    shared = F.size(F.array_intersect("a", "b"))
    both = both.select("x", "y", shared.alias("c"), (F.size("a") + F.size("b")).alias("s"))
    links = staged(both.where(f"c * {den}L >= (s - c) * {num}L").select("x", "y").distinct(), "links")
    dropped(close, sets)
    return links


def similar_groups(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id): the links of all documents, as connected components.

    Two documents link when the Jaccard similarity of their sets of ``size``-word shingles is at
    least ``threshold`` (exactly, as the decimal fraction given). Words are lower-cased (A-Z).

    Defined cases: null, empty or wordless text has no shingle and links with nothing; a text of
    fewer words than ``size`` has its whole sequence as its only shingle; a null doc_id links with
    nothing and has component_id null; rows of equal doc_id are one document for linking, each row is
    returned with its own size; further columns are ignored.
    """
    t = Fraction(str(threshold))
    spark = docs.sparkSession
    rows = text_rows(docs)
    keyed = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    sketch = staged(keyed.mapInArrow(_sketch(size, t), _SKETCH), "sketch")
    full = sketch.where("n > 0")
    classes = full.groupBy("sig1", "sig2", "n").agg(F.min("doc").alias("rep"))
    member = staged(sketch.select("doc", "n", "sig1", "sig2").join(classes, ["sig1", "sig2", "n"], "left"), "member")

    totals = full.agg(F.sum(F.size("head"))).first()[0] or 0
    often = max(HOT_LEAST, totals // HOT_TOKENS)
    counts = staged(full.select(F.explode("head").alias("token")).groupBy("token").count().where("count > 1"), "counts")
    hot = counts.where(F.col("count") > often).select("token").toPandas()["token"].to_numpy(np.int64)
    hot = spark.sparkContext.broadcast(np.sort(hot.view(np.uint64)))

    # prefixes: from the heads, or from whole sets where a head has too few rare tokens
    heads = full.select("doc", "n", "head")
    poor = heads.mapInArrow(_undecided(t, hot), "doc long").distinct()
    poor = staged(poor, "poor")
    whole = keyed.join(small(poor), "doc", "left_semi").mapInArrow(_full_sets(size), "doc long, tokens array<long>")
    whole = whole.select("doc", F.size("tokens").cast("long").alias("n"), "tokens").where("n > 0")
    whole = staged(whole.mapInArrow(_prefix_rows(t, hot, None), _ROWS), "whole")
    bits = spark.sparkContext.broadcast(_bitmap(counts.select("token").union(whole.select("token"))))
    firsts = classes.select(F.col("rep").alias("doc"), F.col("n").cast("int").alias("n"))
    rows_of = heads.mapInArrow(_prefix_rows(t, hot, bits), _ROWS).union(whole)
    prefixes = staged(rows_of.join(firsts, ["doc", "n"], "left_semi").distinct().select("token", "doc", "n", "place", "last"), "prefix")
    hot.destroy()
    bits.destroy()
    marks = staged(full.join(firsts, ["doc", "n"], "left_semi").select("doc", F.col("n").alias("m"), "marks"), "marks")
    # each stage goes as soon as all that is made of it is kept
    dropped(sketch, counts, poor, whole)

    # round 1: each document of a token against the token's leader
    lead = F.min(F.struct("place", "doc", "n", "last")).alias("lead")
    lists = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("docs"), lead).where("docs > 1")
    shared = staged(prefixes.join(lists, "token"), "shared")
    dropped(prefixes)
    star = shared.where("doc != lead.doc AND " + _possible(t, "place", "lead.place", "n", "lead.n")).selectExpr(
        "doc AS x", "lead.doc AS y", "place AS i", "lead.place AS j", "n AS nx", "lead.n AS ny", "last AS lx", "lead.last AS ly")
    one = marks.selectExpr("doc AS x", "m AS mx", "marks AS bx")
    two = marks.selectExpr("doc AS y", "m AS my", "marks AS by")
    tried = _bounded(star, t).join(one, "x").join(two, "y").where(_close(t, "mx", "my", "bx", "by")).select("x", "y").distinct()
    near = _links(tried, keyed, size, t)
    groups = components(near, "x", "y").select(F.col("node").alias("doc"), F.col("component"))

    # round 2: the matrix of tokens and groups; queries open the groups whose bound holds
    fold = [F.aggregate(F.array(*[F.col("marks")[k + FOLDED * i] for i in range(MARKS // 64 // FOLDED)]), F.lit(0).cast("long"),
                        lambda s, x: s.bitwiseXOR(x)).alias(f"m{k}") for k in range(FOLDED)]
    placed = shared.select("token", "doc", "n", "place").join(groups, "doc", "left").join(marks.select("doc", *fold), "doc")
    placed = staged(placed.withColumn("own", F.coalesce("component", "doc")).drop("component"), "placed")
    dropped(shared)
    folds = range(FOLDED)
    matrix = placed.groupBy("token", F.col("own").alias("other")).agg(
        F.min("place").alias("best"), F.min("n").alias("least"), F.max("n").alias("most"),
        *[F.min(f"m{k}").alias(f"a{k}") for k in folds], *[F.max(f"m{k}").alias(f"b{k}") for k in folds])
    num, den = t.numerator, t.denominator
    # where all members share their marks, as in a group of one, these bound the overlap too
    alike = " AND ".join(f"a{k} = b{k}" for k in folds)
    apart = " + ".join(f"bit_count(m{k} ^ a{k})" for k in folds)
    opened = placed.join(matrix, "token").where(
        f"own > other AND (place + best) * {den + num}L <= (n + most) * {den - num}L "
        f"AND n * {den}L >= least * {num}L AND most * {den}L >= n * {num}L "
        f"AND (NOT ({alike}) OR ({apart}) * {den + num}L <= (n + most) * {den - num}L)").select(F.col("doc").alias("x"), "other").distinct()
    members = placed.select(F.col("doc").alias("y"), F.col("own").alias("other")).distinct().join(two, "y")
    pairs = opened.join(one, "x").join(members, "other").where(_close(t, "mx", "my", "bx", "by")).select("x", "y").distinct()
    far = _links(pairs, keyed, size, t)
    dropped(placed, marks)

    reps = member.where("rep IS NOT NULL").groupBy("doc").agg(F.min("rep").alias("x"), F.max("rep").alias("y"))
    split = member.where("rep IS NOT NULL").join(reps.where("x != y").select("doc", "x"), "doc").select("x", F.col("rep").alias("y"))
    whole = components(near.union(far).union(split), "x", "y").withColumnRenamed("node", "rep")
    out = member.join(whole, "rep", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc").alias("component_id"))
    if "doc_id" in docs.columns and docs.schema["doc_id"].nullable:
        lost = rows.where("doc_id IS NULL").select(F.lit(0).cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
        lost = lost.mapInArrow(_sketch(size, t), _SKETCH)
        out = out.union(lost.select(F.lit(None).cast("long"), "n", F.lit(None).cast("long")))
    return out
