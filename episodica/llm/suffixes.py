"""Exact removal of repeated byte strings by distributed prefix doubling.

A position's rank at length L names the L bytes that start there. Ranks double
from ``ANCHOR`` bytes to ``threshold`` bytes; a position whose rank is unique
cannot repeat at any greater length and leaves after the first sort, so nearly
all text is settled there.

1. Rank at the anchor length. Not every position is sorted: each window of
   ``threshold`` bytes is represented by the smallest anchor inside it, a choice
   that depends on the window's bytes alone, so equal windows choose equal
   anchors. Neighbouring windows with one anchor form a run. Spark deals the runs
   by anchor rank and sorts them by (rank, context, document, position).
   Runs with a unique anchor rank end here. Of runs with equal whole contexts
   all but the first are repeats.
2. Rerank at the full length. Where one anchor rank has different contexts, the
   first run of each context is opened: every window in it gets the pair (rank of
   its first half, rank of its second half). Runs are sorted by (anchor rank,
   document, position), so windows whose pair was met before are repeats. A group
   of more than ``GROUP_ROWS`` contexts is dealt by pair instead of by anchor.

Ranks are 64-bit fingerprints rather than dense numbers, so that a task can form
the pair for an offset from the text it holds and no rank table is joined back.
Copies within a batch are settled before the shuffle, so a passage that a third
of all documents share arrives as a row per batch.

Defined cases: null text counts as empty; a text shorter than the threshold
keeps all bytes; a null doc_id sorts before all others; rows of equal doc_id and
equal text are one document and get the same result, rows of equal doc_id and
other text are ordered by a hash of the text; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.bytehash import Ranges, column_bytes, mix, signed
from episodica.llm.shared import BROADCAST_ROWS, narrowed, staged, text_rows

#: Bytes of the first rank. A window of the threshold holds threshold - ANCHOR + 1 of them.
ANCHOR = 36
#: Contexts of one anchor that a single task may open (about 2 MB); larger groups are dealt by window.
GROUP_ROWS = 10_000
_NONE = -(1 << 63)


def _first_flags(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True for rows that are certainly not the first (smallest doc, at) of their key."""
    order = np.lexsort((at, doc, *keys))
    new = np.ones(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] &= k[1:] == k[:-1]
    new = ~new
    new[:1] = True
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    late = (doc[order] != doc[order][first]) | (at[order] != at[order][first])
    out = np.zeros(len(order), bool)
    out[order] = late
    return out


def _window_runs(data: np.ndarray, threshold: int):
    """Runs of windows with one anchor: anchor rank, context rank, first window, windows, anchor's place in it."""
    wide = threshold - ANCHOR + 1
    n = len(data) - threshold + 1
    ranges = Ranges(data)
    ranks = ranges.rolling(ANCHOR)
    bits = np.uint64(22)
    low = (ranks >> bits << bits) | np.arange(len(ranks), dtype=np.uint64)
    step, m = 1, low
    while step * 2 <= wide:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < wide:
        m = np.minimum(m[: n], m[wide - step : wide - step + n])
    anchor = (m[:n] & np.uint64((1 << 22) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    lo = np.concatenate([[0], cut])
    hi = np.concatenate([cut, [n]])
    at = anchor[lo]
    context = ranges.of(lo, hi + threshold - 1) + mix(((at - lo) * 131 + (hi - lo)).astype(np.uint64))
    return ranks[at], context, lo, hi - lo, at - lo


def _runs(threshold: int, chunk: int = 1 << 20):
    def task(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(2))
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            found = []
            for row in np.flatnonzero(np.diff(offsets) >= threshold):
                a, b = int(offsets[row]), int(offsets[row + 1])
                for c in range(a, b - threshold + 1, chunk):
                    rank, context, lo, count, off = _window_runs(data[c : min(c + chunk + threshold - 1, b)], threshold)
                    place = (np.uint64(tags[row]) << np.uint64(46)) | ((lo + (c - a)).astype(np.uint64) << np.uint64(14)) \
                        | (count.astype(np.uint64) << np.uint64(7)) | off.astype(np.uint64)
                    found.append((rank, context, np.full(len(lo), ids[row], np.int64), place))
            if not found:
                continue
            rank, context, doc, place = (np.concatenate(x) for x in zip(*found))
            late = _first_flags([rank, context], doc, place)
            short = (rank >> np.uint64(32)).astype(np.uint32).view(np.int32)
            # settled rows are dealt by document, so that a very common passage does not meet in one task
            deal = np.where(late, (mix(doc.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32), short)
            yield pa.RecordBatch.from_arrays(
                [pa.array(deal), pa.array(late), pa.array(signed(context)), pa.array(doc), pa.array(signed(place))],
                ["deal", "late", "context", "doc", "place"])
    return task


def _opened(threshold: int):
    """For each opened run its bytes, dealt by anchor; runs of very large groups as single windows, dealt by rank."""
    half = threshold // 2

    def task(batches):
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            out: list[tuple] = []
            for row, (packed, runs) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                text = zstandard.decompress(packed.as_py())
                tag = int(tags[row]) << 46
                for place, (deal, large) in sorted({r["place"]: (r["deal"], r["large"]) for r in runs}.items()):
                    lo, count = place >> 14 & 0xFFFFFFFF, place >> 7 & 127
                    run = text[lo : lo + count + threshold - 1]
                    if not large:
                        out.append((deal, ids[row], tag | lo << 14, run))
                        continue
                    at = np.arange(count)
                    ranges = Ranges(np.frombuffer(run, np.uint8))
                    ranks = mix(ranges.of(at, at + half) * np.uint64(3) + ranges.of(at + half, at + threshold))
                    out += [(int(x), ids[row], tag | lo + k << 14, run[k : k + threshold]) for k, x in enumerate(signed(ranks))]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    ["deal", "doc", "place", "run"])
    return task


def _repeats(threshold: int):
    """Windows that are not the first of their rank pair, from rows sorted by (deal, doc, place)."""
    half = threshold // 2

    def task(batches):
        last, seen, before = None, np.zeros(0, np.uint64), None
        for batch in batches:
            deal, doc, place = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(deal):
                continue
            again = np.zeros(len(deal), bool)  # the same document twice
            again[1:] = (deal[1:] == deal[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
            again[0] = before == (deal[0], doc[0], place[0])
            before = (deal[-1], doc[-1], place[-1])
            lengths = pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
            data, starts = column_bytes(batch.column(3).cast(pa.large_binary()).view(pa.large_string()))
            count = np.where(again, 0, lengths - threshold + 1)
            row = np.repeat(np.arange(len(deal)), count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            ranges, at = Ranges(data), starts[row] + step
            rank = mix(ranges.of(at, at + half) * np.uint64(3) + ranges.of(at + half, at + threshold))
            key, owner, where = deal[row], doc[row], place[row] + (step << 14)
            late = _first_flags([key.view(np.uint64), rank], owner, where)
            if last is not None:
                carried = key == last
                late[carried] |= np.isin(rank[carried], seen)
            fresh = rank[key == deal[-1]]
            seen = np.unique(np.concatenate([seen, fresh]) if last == deal[-1] else fresh)
            last = deal[-1]
            # neighbouring windows of one row leave as one run
            hit = np.flatnonzero(late)
            if len(hit):
                new = np.ones(len(hit), bool)
                new[1:] = (np.diff(hit) > 1) | (row[hit][1:] != row[hit][:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(hit)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owner[hit[first]]), pa.array(where[hit[first]]), pa.array(n.astype(np.int32))], ["doc", "place", "n"])
    return task


def _packed(batches):
    """Texts travel compressed."""
    for batch in batches:
        press = zstandard.ZstdCompressor(level=3)
        packed = [press.compress((x.as_py() or "").encode()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary()), *batch.columns[3:]],
                                         ["doc", "tag", "packed", *batch.schema.names[3:]])


def _late(rows: DataFrame, *keys: str) -> DataFrame:
    """Mark rows that are not the first of their key; ``deal`` already holds the rank."""
    rows = rows.repartition("deal")
    spec = "PARTITION BY deal, late, {} ORDER BY doc, place".format(", ".join(keys))
    return rows.withColumn("late", F.col("late") | (F.expr(f"rank() OVER ({spec})") > 1))


def repeated_spans(docs: DataFrame, threshold: int = 100) -> DataFrame:
    """(doc, tag, spans): the byte ranges of each document that earlier text repeats.

    ``spans`` packs start and end (exclusive) of covered ranges, start * 2^32 + end; ranges may overlap.
    ``doc`` is the doc_id (the smallest long for null) and ``tag`` a hash of the text.
    """
    if not ANCHOR < threshold <= ANCHOR + 100:
        raise ValueError(f"threshold must lie in {ANCHOR + 1}..{ANCHOR + 100}")
    keyed = keyed_docs(docs)
    runs = keyed.mapInArrow(_runs(threshold), "deal int, late boolean, context long, doc long, place long")
    marked = _late(runs, "context").withColumn("contexts", F.expr("count(1) OVER (PARTITION BY deal, late)"))
    marked = marked.where("late OR contexts > 1").select("deal", "late", "doc", "place", (F.col("contexts") > GROUP_ROWS).alias("large"))
    marked = staged(marked, "runs")

    openings = (
        marked.where("NOT late")
        .groupBy("doc", F.shiftright("place", 46).alias("tag"))
        .agg(F.collect_list(F.struct("deal", "place", "large")).alias("runs"))
    )
    texts = narrowed(keyed, marked.where("NOT late").select("doc").distinct(), "doc").select("doc", "tag", "text")
    opened = texts.mapInArrow(_packed, "doc long, tag long, packed binary").join(openings, ["doc", "tag"])
    opened = opened.select("doc", "tag", "packed", "runs").mapInArrow(_opened(threshold), "deal long, doc long, place long, run binary")
    repeats = opened.repartition("deal").sortWithinPartitions("deal", "doc", "place").mapInArrow(
        _repeats(threshold), "doc long, place long, n int")
    whole = marked.where("late").select("doc", "place", (F.shiftright("place", 7).bitwiseAND(127)).cast("int").alias("n"))
    begin = F.shiftright("place", 14).bitwiseAND((1 << 32) - 1)
    return (
        whole.union(repeats)
        .select("doc", F.shiftright("place", 46).alias("tag"),
                (F.shiftleft(begin, 32) + begin + F.col("n") + (threshold - 1)).alias("span"))
        .groupBy("doc", "tag").agg(F.collect_list("span").alias("spans"))
    )


def keyed_docs(docs: DataFrame) -> DataFrame:
    """(doc, tag, text, doc_id) with no null in the key."""
    text = F.coalesce("text", F.lit(""))
    return text_rows(docs).select(
        F.coalesce("doc_id", F.lit(_NONE)).alias("doc"),
        F.shiftrightunsigned(F.xxhash64(text), 49).alias("tag"), text.alias("text"), "doc_id")


def _merged(spans: list[int] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x in sorted(spans or ()):
        a, b = x >> 32, x & 0xFFFFFFFF
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _cut(batches):
    for batch in batches:
        rows = []
        for text, packed in zip(batch.column(1), batch.column(2)):
            text = text.as_py()
            text = memoryview(text.encode() if isinstance(text, str) else zstandard.decompress(text))
            spans = _merged(packed.as_py())
            kept, last = [], 0
            for a, b in spans:
                kept.append(text[last:a])
                last = b
            kept.append(text[last:])
            left = b"".join(kept)
            rows.append((len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(left).hexdigest(), left))
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, threshold: int = 100, with_bytes: bool = True) -> DataFrame:
    """One row per document: byte counts, number of removed runs, digest and (if asked for) the bytes that stay.

    Removing can cut inside a character, so the rest is binary.
    """
    spans = staged(repeated_spans(docs, threshold), "spans")
    keyed, touched = keyed_docs(docs), spans.select("doc").distinct()
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(texts: DataFrame) -> DataFrame:
        packed = texts.select("doc", "tag", "text", "doc_id").mapInArrow(_packed, "doc long, tag long, packed binary, doc_id long")
        return packed.join(spans, ["doc", "tag"], "left").select("doc_id", "packed", "spans").mapInArrow(_cut, schema)

    if touched.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # only texts that lose bytes meet their spans in a shuffle
        touched = F.broadcast(touched)
        plain = keyed.join(touched, "doc", "left_anti").select("doc_id", "text", F.lit(None).cast("array<long>").alias("spans"))
        out = cut(keyed.join(touched, "doc", "left_semi")).union(plain.mapInArrow(_cut, schema))
    else:
        out = cut(keyed)
    return out if with_bytes else out.drop("kept")
