"""Bounded-space online packing of tokenised documents into sequences.

Every task keeps a fixed number of open windows. A document goes to the open
window that it fills best; when none has room, the fullest window takes as much
of the document's head as fits and is emitted. What is open at a task's end is
merged afterwards, whole windows at a time, so the work left is a fixed
number of windows per task.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.shared import small, staged

WINDOW = 4096
OPEN_WINDOWS = 64
#: A document is not cut to fill a window for fewer tokens than this.
LEAST_PIECE = 16
#: Windows that one task merges at most.
MERGED = 20_000
#: Words and parts of words together whose ids a worker remembers.
REMEMBERED = 700_000
#: Texts that a worker takes apart at a time.
TEXTS = 128

_KEPT = "episodica_worker_encoders"


class Encoder:
    """Token ids of whole texts as little-endian bytes.

    The tokenizer parts texts at white space, and then into runs of letters, single digits and runs of other
    characters, before it merges anything; so each stretch between ASCII spaces is encoded once and remembered, and
    so is each part of a stretch of plain Latin characters. Only new parts reach the tokenizer, and stretches with other
    characters, apostrophes or special tokens as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # a part that stands alone is a word of the same ids
        self._words: dict[str, bytes] = {"": b""}
        self._parts = self._words

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_stretches(t) for t in texts]
        fresh = set().union(*split).difference(self._words)
        new = self._learn(fresh)
        get = self._words.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        # what came first is most frequent; later words leave again once the memory is full
        if len(self._words) > REMEMBERED:
            for w in fresh.union(new):
                del self._words[w]
        return out

    def _learn(self, fresh: set[str]) -> list[str]:
        plain = {w: _PART.findall(w.lower()) for w in fresh if _PLAIN.fullmatch(w) and "<|" not in w}
        other = [w for w in fresh if w not in plain]
        for w, e in zip(other, self._tokenizer.encode_batch_fast(other, add_special_tokens=False)):
            self._words[w] = np.array(e.ids, "<u4").tobytes()
        new = list(set().union(*plain.values()).difference(self._words))
        for k in range(0, len(new), 1024):
            some = new[k : k + 1024]
            joined = self._tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids, owner = np.array(joined.ids, "<u4"), np.array(joined.word_ids, np.int64)
            ends = np.searchsorted(owner, np.arange(1, len(some) + 1))
            starts = np.concatenate([[0], ends[:-1]])
            raw = ids.tobytes()
            for p, i, j in zip(some, (4 * starts).tolist(), (4 * ends).tolist()):
                self._parts[p] = raw[i:j]
        get = self._parts.__getitem__
        for w, parts in plain.items():
            self._words[w] = get(parts[0]) if len(parts) == 1 else b"".join(map(get, parts))
        return new


def _stretches(text: str) -> list[str]:
    """The text between white space. Python counts four control characters to it that the tokenizer does not."""
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ")
    return text.split()


# Printable ASCII without the apostrophe, and Latin letters whose lower case is one letter; then the parts of their lower case.
_PLAIN = re.compile("[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_PART = re.compile("[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u017f]+")


def encoder(path: str) -> Encoder:
    """One per worker process. This package travels with every task anew, so the encoder is kept in a module that stays."""
    kept = sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


class Windows:
    """The open windows of one task: best fit among at most ``most``, the fullest leaves when none fits."""

    def __init__(self, first: int, size: int, most: int):
        self._next, self._size, self._most = first, size, most
        self._rooms: list[tuple[int, int]] = []  # (room, window), sorted

    def place(self, length: int):
        """Yield (start, length, window, offset) of the pieces of a document."""
        start = 0
        while start < length:
            rest = length - start
            if rest >= self._size:
                yield start, self._size, self._open(), 0
                start += self._size
                continue
            k = bisect_left(self._rooms, (rest, -1))
            if k < len(self._rooms):
                room, window = self._rooms.pop(k)
                yield start, rest, window, self._size - room
                self._keep(room - rest, window)
                return
            if len(self._rooms) == self._most:
                room, window = self._rooms.pop(0)
                if room >= LEAST_PIECE and rest - room >= LEAST_PIECE:
                    yield start, room, window, self._size - room
                    start += room
                continue
            window = self._open()
            yield start, rest, window, 0
            self._keep(self._size - rest, window)
            return

    def _open(self) -> int:
        self._next += 1
        return self._next - 1

    def _keep(self, room: int, window: int) -> None:
        if room:
            insort(self._rooms, (room, window))

    def left(self) -> list[tuple[int, int]]:
        """(window, tokens in it) of what is still open."""
        return [(w, self._size - room) for room, w in self._rooms]


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long"


def _pack(path: str, end_id: int, size: int, most: int):
    tail = int(end_id).to_bytes(4, "little")

    def task(batches):
        windows = Windows(TaskContext.get().partitionId() << 40, size, most)
        encode = encoder(path).encode
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), TEXTS):
                rows = []
                for doc, tokens in zip(ids[lo : lo + TEXTS], encode([x or "" for x in texts.slice(lo, TEXTS).to_pylist()])):
                    tokens = memoryview(tokens + tail)
                    n = len(tokens) // 4
                    for start, length, window, offset in windows.place(n):
                        rows.append((doc, start, length, zlib.crc32(tokens[4 * start : 4 * (start + length)]), n, window, offset))
                yield _batch(rows)
        # the worker stays for later tasks: what it no longer needs goes back
        batch = texts = None
        pa.default_memory_pool().release_unused()
        # what is left open: a row without document
        yield _batch([(None, 0, used, 0, -1, window, 0) for window, used in windows.left()])

    return task


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in _PIECES.split(", ")])


def _merge(size: int):
    """Best fit, largest first, of whole windows; a sequence is named by its first window."""
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        rooms: list[tuple[int, int]] = []
        out = []
        for window, used in pdf.sort_values(["used", "window"], ascending=[False, True])[["window", "used"]].itertuples(index=False):
            k = bisect_left(rooms, (used, -1))
            room, into = rooms.pop(k) if k < len(rooms) else (size, window)
            out.append((window, into, size - room))
            if room > used:
                insort(rooms, (room - used, into))
        return pd.DataFrame(out, columns=["window", "into", "base"])
    return group


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row per piece.

    ``tokenizer`` is the path of a tokenizer file that every worker can read. Defined cases: null and empty texts
    are the end id alone; repeated rows and null ids are each packed; longer documents than a window are cut; further columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = staged(rows.mapInArrow(_pack(tokenizer, end_id, window, open_windows), _PIECES), "pieces")
    opened = pieces.where("doc_tokens < 0").select("window", F.col("length").alias("used"))
    tasks = opened.count() // MERGED + 1
    group = F.pmod(F.xxhash64("window"), F.lit(tasks))
    merged = opened.withColumn("g", group).groupBy("g").applyInPandas(_merge(window), "window long, into long, base long")
    out = pieces.where("doc_tokens >= 0").join(small(staged(merged, "merged")), "window", "left")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                      F.coalesce("into", "window").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
