"""Byte-pair encoding and decoding by a deterministic automaton over tokens.

The automaton accepts exactly the token sequences that the merges produce, so a
word has one accepted sequence, and so has each of its prefixes. It is built by
one gadget per merge (u, v), in order of priority: the state behind u is split,
the new state is a copy that lacks the arc v and takes all u arcs, and wherever u
could be read the merged token can be read too and leads where v led. Three
properties keep the tables small:

* all arcs of one token lead to one state, so targets are an array by token;
* a merged token may be read in exactly those states that allow its left part
  at that time or later, so what a state forbids are subtrees of the forest
  (token -> its left part);
* with children numbered latest first, the part of a subtree born after a merge
  is an interval of numbers, so a state's forbidden tokens are few intervals.

Encoding reads a word byte by byte. A second table, of the ends that words and tokens
share, names the tokens that end at each place; exactly one of them is an arc of the state
where it begins, and following these arcs backwards gives the tokens. Time is linear
in the word. Decoding emits the bytes of each arc's token.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.bytehash import column_bytes, parts
from episodica.llm.shared import text_rows

#: Pre-split words that a worker remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 400_000, 64
#: Words that are encoded together; longer ones than LONGEST bytes are encoded one by one.
_TOGETHER = 16_384

# Fixed value: the split of byte-level tokenizers.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes no Unicode version of the last years has changed; texts with others are split by the tokenizers library.
_SETTLED = regex.compile("[\u0000-ԯ‐-⁞ぁ-ゖァ-ヺ一-鿯가-힣\U0001f300-\U0001f64f]*")


class Automaton:
    """The transition tables of a list of merges.

    ``merges`` are (left, right, merged) token ids in order of priority and ``labels`` the bytes of every token. Tokens that
    are nobody's merge are single bytes; a merge that can never apply leaves its token without arcs.
    """

    def __init__(self, labels: dict[int, bytes], merges: Sequence[tuple[int, int, int]]):
        merged = {uv for _, _, uv in merges}
        if len(merged) != len(merges):
            raise ValueError("two merges give one token")
        self.labels = labels
        base = [t for t, label in labels.items() if t not in merged and len(label) == 1]
        if len({labels[t] for t in base}) != len(base):
            raise ValueError("two tokens stand for one byte")
        born = dict.fromkeys(base, -1)
        children: dict[int, list[int]] = {}  # by birth
        state = dict.fromkeys(base, 0)  # token -> the state its arcs lead to
        split: list[tuple[int, int, int]] = [(-1, -1, -1)]  # state -> (state it copies, arc it lacks, merge)
        for k, (u, v, uv) in enumerate(merges):
            if u not in born or v not in born or not self._allows(split, born, merges, state[u], v):
                continue
            q, target = state[u], state[v]
            split.append((q, v, k))
            state[u] = len(split) - 1
            state[uv] = target
            born[uv] = k
            children.setdefault(u, []).append(uv)
        number, last = self._numbered(base, children)
        # what a state lacks: what the state it copies lacks, and the arc with all that was born of it since
        lacking: dict[int, list[tuple[int, int]]] = {0: []}
        ends = {t: [last[c] for c in kids] for t, kids in children.items()}
        births = {t: [born[c] for c in kids] for t, kids in children.items()}

        def intervals(s: int) -> list[tuple[int, int]]:
            chain = []
            while s not in lacking:
                chain.append(s)
                s = split[s][0]
            for s in reversed(chain):
                source, v, k = split[s]
                since = bisect_right(births.get(v, ()), k - 1)
                end = ends[v][since] if since < len(births.get(v, ())) else number[v]
                lacking[s] = _united(lacking[source], number[v], end)
            return lacking[chain[0]] if chain else lacking[s]

        live = {s: i for i, s in enumerate(sorted({0, *state.values()}))}
        rows = [intervals(s) for s in live]
        if len(base) < 256:
            raise ValueError("a byte has no token")
        size = max(labels) + 1
        #: By token: the row of its state, its number and its length; by row: where its limits (from, to, from, ...) begin.
        self._row, self._number, self._length = (np.zeros(size, np.int64) for _ in range(3))
        for t, s in state.items():
            self._row[t], self._number[t], self._length[t] = live[s], number[t], len(labels[t])
        self._starts = np.array([0, *accumulate(2 * len(row) for row in rows)], np.int64)
        self._width = size + 1
        #: Limits of all rows, each in its row's own range of numbers, so that one sorted array answers for every row.
        self._limits = np.array([r * self._width + x for r, row in enumerate(rows) for lo, hi in row for x in (lo, hi + 1)], np.int64)
        self._matcher(number, size)

    def _matcher(self, tokens: Iterable[int], size: int) -> None:
        """Tables that give, after each byte of a word, the longest token that ends there, and for each token the next shorter one."""
        step: dict[int, int] = {}  # (node, byte) -> node
        token, parent, depth = [-1], [(0, 0)], [0]
        for t in tokens:
            node = 0
            for b in self.labels[t]:
                key = node << 8 | b
                if key not in step:
                    step[key] = len(token)
                    token.append(-1)
                    parent.append((node, b))
                    depth.append(depth[node] + 1)
                node = step[key]
            token[node] = t
        fall = [0] * len(token)  # the longest proper end of the node's bytes that is a node
        self._shorter = np.zeros(size, np.int64)
        for node in sorted(range(1, len(token)), key=depth.__getitem__):
            up, b = parent[node]
            if up:
                f = fall[up]
                while f and (f << 8 | b) not in step:
                    f = fall[f]
                fall[node] = step.get(f << 8 | b, 0)
            if token[node] >= 0:
                self._shorter[token[node]] = token[fall[node]]
            else:
                token[node] = token[fall[node]]
        self._fall, self._longest = np.array(fall), np.array(token)
        self._step, self._steps, self._lists = step, _Table(step), None

    @staticmethod
    def _allows(split, born, merges, s: int, t: int) -> bool:
        """May ``t`` be read in state ``s``, with the tables as far as they are built?"""
        while True:
            source, lacks, k = split[s]
            if born[t] >= k and born[t] >= 0:
                t = merges[born[t]][0]
            elif s == 0:
                return True
            elif t == lacks:
                return False
            else:
                s = source

    @staticmethod
    def _numbered(roots: Iterable[int], children: dict[int, list[int]]) -> tuple[dict[int, int], dict[int, int]]:
        """Preorder number of every token, latest child first, and the last number below it."""
        number, last, n = {}, {}, 0
        for root in roots:
            stack = [(root, False)]
            while stack:
                t, done = stack.pop()
                if done:
                    last[t] = n - 1
                    continue
                number[t] = n
                n += 1
                stack.append((t, True))
                stack.extend((c, False) for c in children.get(t, ()))
        return number, last

    @property
    def size(self) -> tuple[int, int]:
        """States that can be reached, and intervals of forbidden tokens of all of them."""
        return len(self._starts) - 1, len(self._limits) // 2

    def _forbidden(self, rows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self._limits, rows * self._width + self._number[tokens], "right")
        return ((at - self._starts[rows]) & 1).astype(bool)

    def allowed(self, before: int | None, token: int) -> bool:
        """May ``token`` follow ``before`` (None: at the start)?"""
        row = 0 if before is None else int(self._row[before])
        return not self._forbidden(np.array([row]), np.array([token]))[0]

    def encode(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words one after another, and how many each word has.

        Words of common length go forward together, a byte at a time; longer ones one by one.
        """
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        ids, counts = [np.zeros(0, np.int32)] * len(words), np.zeros(len(words), np.int64)
        long = int(np.count_nonzero(lengths > LONGEST))
        for i in order[:long].tolist():
            ids[i] = self._alone(words[i])
            counts[i] = len(ids[i])
        for lo in range(long, len(words), _TOGETHER):
            some = order[lo : lo + _TOGETHER]
            found, many = self._together([words[i] for i in some], lengths[some])
            for i, part in zip(some.tolist(), np.split(found, np.cumsum(many)[:-1])):
                ids[i] = part
            counts[some] = many
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), counts

    def _alone(self, word: bytes) -> np.ndarray:
        """One word, with the same tables read one entry at a time."""
        if self._lists is None:
            tables = (self._fall, self._longest, self._shorter, self._length, self._row, self._number, self._starts)
            self._lists = (*[t.tolist() for t in tables], array("q", self._limits.tobytes()))
        fall, longest, shorter, length, row, number, starts, limits = self._lists
        step, width = self._step.get, self._width
        came, rows, node, e = array("i"), array("i", [0]), 0, 0
        for b in word:
            e += 1
            to = step(node << 8 | b)
            while to is None:
                node = fall[node]
                to = step(node << 8 | b)
            node = to
            t = longest[node]
            while True:
                r = rows[e - length[t]]
                lo = starts[r]
                if not (bisect_right(limits, r * width + number[t], lo, starts[r + 1]) - lo) & 1:
                    break
                t = shorter[t]
            came.append(t)
            rows.append(row[t])
        out = array("i")
        while e:
            out.append(came[e - 1])
            e -= length[came[e - 1]]
        return np.array(out, np.int32)[::-1]

    def _together(self, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words from the longest to the shortest."""
        data = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(lengths) - lengths
        shape = (len(words), int(lengths[0]) + 1)
        came, rows = np.zeros(shape, np.int32), np.zeros(shape, np.int32)  # the token that ends at each place, and the state behind it
        node = np.zeros(len(words), np.int64)
        for e in range(1, shape[1]):
            live = int(np.searchsorted(-lengths, -e, "right"))
            node[:live] = self._forward(node[:live], data[first[:live] + e - 1])
            todo, t = np.arange(live), self._longest[node[:live]]
            while len(todo):
                bad = self._forbidden(rows[todo, e - self._length[t]].astype(np.int64), t)
                here, good = todo[~bad], t[~bad]
                came[here, e], rows[here, e] = good, self._row[good]
                todo, t = todo[bad], self._shorter[t[bad]]
        ends = np.zeros(shape, bool)
        at, word = lengths.copy(), np.arange(len(words))
        while True:
            word = word[at[word] > 0]
            if not len(word):
                break
            ends[word, at[word]] = True
            at[word] -= self._length[came[word, at[word]]]
        return came[ends], ends.sum(1)

    def _forward(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        to = self._steps.get(node << 8 | byte)
        while True:
            lost = np.flatnonzero(to < 0)
            if not len(lost):
                return to
            node = node.copy()
            node[lost] = self._fall[node[lost]]
            to[lost] = self._steps.get(node[lost] << 8 | byte[lost])


class _Table:
    """A fixed mapping of non-negative integers, looked up by whole arrays (open addressing)."""

    def __init__(self, items: dict[int, int]):
        bits = max(4, (4 * len(items)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys, values = np.array(list(items), np.int64), np.array(list(items.values()), np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self._keys[slot] < 0
            self._keys[slot[free]] = keys[free]  # of several at one slot the last stays
            done = self._keys[slot] == keys
            self._values[slot[done]] = values[done]
            keys, values, slot = keys[~done], values[~done], (slot[~done] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        slot = self._slot(keys)
        seen = self._keys[slot]
        out = np.where(seen == keys, self._values[slot], -1).astype(np.int64)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self._mask
            seen = self._keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self._values[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


def _united(ranges: list[tuple[int, int]], lo: int, hi: int) -> list[tuple[int, int]]:
    """Sorted disjoint ranges with one more; neighbours grow together."""
    out = []
    for a, b in ranges:
        if b < lo - 1:
            out.append((a, b))
        elif a > hi + 1:
            break
        else:
            lo, hi = min(lo, a), max(hi, b)
    return [*out, (lo, hi), *(r for r in ranges if r[0] > hi + 1)]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in files of byte-level tokenizers: itself if it can be seen, else the next free one."""
    seen = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """Encodes and decodes whole texts with the automaton of a tokenizer file.

    The file must hold a byte-level BPE without normalizer, prefix space, dropout or post-processing. Its added tokens are
    found in the text first, the longest at a place, as the tokenizers library does by default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split, added = spec["model"], spec["pre_tokenizer"] or {}, spec.get("added_tokens") or []
        plain = (model["type"] == "BPE" and not any(model.get(k) for k in
                 ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")))
        if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        if any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added tokens with conditions: {path}")
        letters, vocab = _byte_letters(), model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        special = {a["content"]: a["id"] for a in added}
        labels = {t: bytes(letters[c] for c in s) for s, t in vocab.items() if s not in special}
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.automaton = Automaton(labels, merges)
        self._emit = labels | {t: s.encode() for s, t in special.items()}
        self._special = special
        self._parts = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self._split = regex.compile(SPLIT).findall
        self._known: dict[str, bytes] = {s: np.array([t], "<i4").tobytes() for s, t in special.items()}
        self._library = None

    def _words(self, text: str) -> list[str]:
        if _SETTLED.fullmatch(text):
            return self._split(text)
        if self._library is None:
            from tokenizers import pre_tokenizers

            self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[i:j] for _, (i, j) in self._library.pre_tokenize_str(text)]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Token ids of every text as little-endian 32-bit integers."""
        split = []
        for text in texts:
            pieces = self._parts.split(text) if self._parts else [text]
            split.append([w for p in pieces if p for w in ((p,) if p in self._special else self._words(p))])
        known = self._known
        new = list({w for words in split for w in words if w not in known})
        ids, counts = self.automaton.encode([w.encode() for w in new])
        raw, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
        known.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends))))
        get = known.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        # what comes first is most frequent; later words leave again once the memory is full
        room = len(known) <= REMEMBERED
        for w in new:
            if not room or len(w.encode()) > LONGEST:
                del known[w]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The bytes of all tokens as text; what is not UTF-8 becomes the replacement character."""
        return b"".join(map(self._emit.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per worker process."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _sliced(path: str, column: str, work: Callable[[Codec, pa.Array], pa.Array]):
    """A task that works on a few rows at a time, by their bytes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path)
        for batch in batches:
            cells = batch.column(1)
            for lo, hi in parts(_sizes(cells)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), work(made, cells.slice(lo, hi - lo))], ["doc_id", column])

    return task


def _sizes(cells: pa.Array) -> np.ndarray:
    if pa.types.is_list(cells.type):
        return np.concatenate([[0], np.cumsum(4 * cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
    return column_bytes(cells)[1]


def _encoded(made: Codec, texts: pa.Array) -> pa.Array:
    ids = made.encode([x.as_py() or "" for x in texts])
    ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _decoded(made: Codec, ids: pa.Array) -> pa.Array:
    return pa.array([made.decode(x.values.to_numpy().tolist()) if x.is_valid else "" for x in ids], pa.string())


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text.

    ``tokenizer`` is the path of a tokenizer file that every worker can read. Defined cases: null and empty texts have no
    ids; repeated rows and null ids are each encoded; a word of any length takes linear time; further columns are ignored;
    an empty table gives an empty result. Encoding is a function of the text alone, so there are no ties.
    """
    return text_rows(docs).mapInArrow(_sliced(tokenizer, "ids", _encoded), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids), special tokens included.

    Null and empty lists give the empty text; ids that the tokenizer does not have fail; further columns are ignored.
    """
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(_sliced(tokenizer, "text", _decoded), "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text): every text encoded and decoded again, in one pass over the rows. Cases as in ``encode``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi in parts(_sizes(texts)):
                ids = _encoded(made, texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids, _decoded(made, ids)], ["doc_id", "ids", "text"])

    return text_rows(docs).mapInArrow(task, "doc_id long, ids array<int>, text string")
