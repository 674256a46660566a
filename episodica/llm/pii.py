"""Personal data: formats that always count, and further spans chosen by boosted trees.

High-recall generators propose overlapping candidate spans (digit clusters and
the runs of digit groups inside them, as numbers may stand side by side;
written-out or bracketed addresses, near misses of the basic formats). Every
candidate gets features of its format and of the text around it. Boosted trees
score them, trained on one half of all candidates of the corpus; the score
is calibrated on the whole other half, and a threshold per kind
is the lowest one with the precision asked for. Spans of the basic formats stay
whatever the score. Features are cut into bins, and candidates with equal bins
become one row with a weight; trees grow from sums over these rows.

Nobody labels the corpus: a candidate that a basic rule confirms is a positive,
one of the same shape that fails its checks is a negative, and each positive also
gives a negative with a damaged digit. Confirmed numbers are also shown beside
another number, and parts of a card as what is no phone, with a quarter of the weight. Other
candidates are scored, not learned from.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.shared import staged
from episodica.llm.trees import BINS, Rows, Trees, binned, boosted, calibrated, cuts_of

KINDS = ("email", "ip", "card", "phone")
#: Different rows of bins up to which the sums that trees grow from are taken on the driver; beyond it by tasks, with the same result.
LOCAL_ROWS = 50_000
#: Weight of numbers shown beside another one, so that what is learned is mostly what the corpus has.
SHOWN = 0.25
#: Precision that the threshold of each kind must have on the calibration half.
PRECISION = 0.99
#: Candidates of a text that are scored together.
BLOCK = 4096

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# candidates beyond the basic formats
_CLUSTER = re.compile(r"[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}")
_GROUP = re.compile(r"[0-9]+")
_DIGIT_BEFORE, _DIGIT_AFTER = re.compile(r"[0-9][\x20().\-/]{0,2}$"), re.compile(r"[\x20().\-/]{0,2}[0-9]")
_WRITTEN = re.compile(r"(?<=[A-Za-z0-9])\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])\x20@\x20(?=[A-Za-z0-9])")
_WRITTEN_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]+)+")
_DEFANGED = re.compile(r"[0-9]{1,3}(?:\x20?[\[(]\.[\])]\x20?[0-9]{1,3}){3}")
_CUES = {
    "email": re.compile(r"e-?mail|contact|write|address|@", re.I), "ip": re.compile(r"\bip\b|host|server|addr", re.I),
    "card": re.compile(r"card|visa|credit|payment|konto", re.I), "phone": re.compile(r"tel|phone|call|fax|mobil", re.I),
}
_NOT = re.compile(r"version|license|v\.?\s*$|isbn|token|key|password|id\b", re.I)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 3 or len(s) == 3 and s <= "255"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address format, from each @ outwards: linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def _quads(text: str) -> list[tuple[int, int]]:
    """Matches of four digit groups with single dots, whatever their values."""
    out = []
    for m in _DOTTED.finditer(text):
        groups, at = m.group().split("."), m.start()
        k, starts = 0, []
        for g in groups:
            starts.append(at)
            at += len(g) + 1
        while k + 4 <= len(groups):
            if all(groups[k : k + 4]):
                out.append((starts[k], starts[k + 3] + len(groups[k + 3])))
                k += 4
            else:
                k += 1
    return out


def _valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(_octet(p) for p in s.split("."))
    if kind == "card":
        d = _digits(s)
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(_digits(s)) <= 15
    return True


def shaped(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, passes) of every match of the basic formats."""
    found = [("email", a, b, True) for a, b in emails(text)]
    if _DIGIT.search(text):
        for kind, spans in (("ip", _quads(text)), ("card", ((m.start(), m.end()) for m in _CARD.finditer(text))),
                            ("phone", ((m.start(), m.end()) for m in _PHONE.finditer(text)))):
            found += [(kind, a, b, _valid(kind, text[a:b])) for a, b in spans]
    return found


def _runs(text: str, a: int, b: int):
    """(start, end, digits) of the runs of neighbouring digit groups in a cluster that have 7 to 19 digits; at most 19 from each group."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, a, b)]
    for i, (start, _) in enumerate(groups):
        while start > a and text[start - 1] in "+(":
            start -= 1
        n = 0
        for x, end in groups[i : i + 19]:
            n += end - x
            if n > 19:
                break
            if n >= 7:
                yield start, end, n


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans beyond the basic formats that might be personal data; they may overlap."""
    out = set()
    if _DIGIT.search(text):
        for m in _CLUSTER.finditer(text):
            for a, b, n in _runs(text, m.start(), m.end()):
                if n <= 15:
                    out.add(("phone", a, b))
                if n >= 13:
                    out.add(("card", a, b))
        out |= {("ip", m.start(), m.end()) for m in _DEFANGED.finditer(text)}
    for m in _WRITTEN.finditer(text) if "@" in text or "at" in text or "AT" in text else ():
        start = m.start()
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        tail = _WRITTEN_DOMAIN.match(text, m.end())
        if tail and start < m.start():
            out.add(("email", start, tail.end()))
    return sorted(out, key=lambda c: (c[1], c[2], c[0]))


def features(text: str, kind: str, a: int, b: int, s: str | None = None) -> list[float]:
    """Format of the span (or of ``s`` in its place) and context."""
    s = text[a:b] if s is None else s
    before, after = text[max(0, a - 32) : a], text[b : b + 8]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    return [
        *(float(kind == k) for k in KINDS), len(s), len(d), len(groups), max(sizes), min(sizes),
        float(bool(d) and luhn(d)), float(s.startswith("+")), s.count("(") + s.count("["), s.count("."), s.count("-"), s.count(" "),
        float(all(_octet(g) for g in groups)), len(set(d)), sum(c.isalpha() for c in s), float("@" in s),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "=\"'#:/"), float(after[:1] in "\"'%/"),
        float(bool(_CUES[kind].search(before))), float(bool(_NOT.search(before))),
        float(bool(_DIGIT_BEFORE.search(before))), float(bool(_DIGIT_AFTER.match(after))),
    ]


def _damaged(kind: str, s: str) -> str | None:
    """The same span made wrong: a check digit, an octet or too few digits."""
    if kind == "card":
        return s[:-1] + str((int(s[-1]) + 1) % 10)
    if kind == "ip":
        return "7" + s[s.index(".") - 2 if s.index(".") > 1 else 0 : s.index(".")] + "9" + s[s.index(".") :]
    if kind == "phone":
        return s[: max(4, len(s) // 2)]
    return None


def _side_by_side(text: str, kind: str, a: int, b: int, ok: bool) -> list[tuple[list[float], float]]:
    """(features, label) of a confirmed number beside another one, and of the parts of a card, which are no phones."""
    s, rows = text[a:b], []
    if ok and kind in ("card", "phone"):
        before, after = text[max(0, a - 32) : a], text[b : b + 8]
        # in lists phones also go without the plus
        for one in (s, s[1:]) if kind == "phone" else (s,):
            row = f"{before}{one} {one}{after}"
            first, second = len(before), len(before) + len(one) + 1
            rows += [(features(row, kind, at, at + len(one)), 1.0) for at in (first, second)]
    whole = len(_digits(s))
    if kind == "card" and 14 <= whole <= 19:
        rows += [(features(text, "phone", x, y), 0.0) for x, y, n in _runs(text, a, b) if n <= 15 and n < whole]
    return rows


def _learnable(batches):
    for batch in batches:
        rows = []
        for text in batch.column(0):
            text = text.as_py()
            if not text:
                continue
            for kind, a, b, ok in shaped(text):
                around = hashlib.blake2b(text[max(0, a - 8) : b + 8].encode(), digest_size=8).digest()
                h = int.from_bytes(around, "big", signed=True)
                rows.append((h, features(text, kind, a, b), float(ok), 1.0))
                wrong = _damaged(kind, text[a:b]) if ok else None
                if wrong is not None and not _valid(kind, wrong):
                    rows.append((h ^ 1, features(text, kind, a, b, wrong), 0.0, 1.0))
                # the changed bits leave the half that calibrates as it is
                rows += [(h ^ k << 2, x, y, SHOWN) for k, (x, y) in enumerate(_side_by_side(text, kind, a, b, ok), 1)]
        cols = list(zip(*rows)) or [()] * 4
        types = pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["h", "x", "y", "n"])


def _binned(cuts):
    """Rows of bins as bytes, with the number of the kind."""

    def task(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, len(cuts))
            bins = np.ascontiguousarray(binned(x, cuts))
            keys = pa.array([r.tobytes() for r in bins], pa.binary())
            kind = pa.array(x[:, : len(KINDS)].argmax(axis=1), pa.int32())
            yield pa.RecordBatch.from_arrays([keys, kind, *[batch.column(k) for k in (1, 2, 3)]], ["bins", "kind", "held", "y", "n"])

    return task


def _rows(batch: pa.RecordBatch | pa.Table) -> Rows:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return Rows(bins, batch.column("y").to_numpy(), batch.column("n").to_numpy())


def _summed(start, trees, feature, cut, depth):
    """The sums of a task as one row of bytes."""

    def task(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + _rows(batch).sums(start, trees, feature, cut, depth)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return task


def _grow(rows: DataFrame, cuts: list[np.ndarray], share: float, local: int) -> Trees:
    """Trees from rows of bins: many are added up by tasks, once for each level of a tree."""
    rows = rows.select("bins", "y", "n")
    if rows.limit(local + 1).count() <= local:
        return boosted(cuts, share, _rows(rows.toArrow().combine_chunks()).sums)
    rows = staged(rows, "learned")

    def sums(*state) -> np.ndarray:
        found = rows.mapInArrow(_summed(*state), "sums binary").collect()  # a table of the model's size for each task
        return sum(np.frombuffer(r["sums"]) for r in found).reshape(3, 2 ** state[-1], len(cuts), BINS + 1)

    return boosted(cuts, share, sums)


def _scores(trees: Trees, cuts: list[np.ndarray]):
    """Log-odds of rows of bins."""
    edges = [np.append(c, np.inf) for c in cuts]

    def task(batches):
        for batch in batches:
            # the cut above a bin lies in the same bin, so it stands for all its values
            bins = _rows(batch).bins if batch.num_rows else np.empty((0, len(cuts)), np.uint8)
            x = np.stack([e[bins[:, k]] for k, e in enumerate(edges)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(trees.raw(x)), *[batch.column(c) for c in ("kind", "y", "n")]], ["raw", "kind", "y", "n"])

    return task


def _covered(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover together, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _apart(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Of (start, end, kind, weight) the spans without overlaps whose weights have the largest sum."""
    spans = sorted(spans, key=lambda s: (s[1], s[0]))
    ends, best, back = [s[1] for s in spans], [0.0], []
    for i, (a, _, _, w) in enumerate(spans):
        j = bisect_right(ends, a, 0, i)
        back.append(j if best[j] + w > best[i] else -1)
        best.append(max(best[i], best[j] + w))
    out, i = [], len(spans)
    while i:
        if back[i - 1] >= 0:
            out.append(spans[i - 1][:3])
            i = back[i - 1]
        else:
            i -= 1
    return out


class Detector:
    """Trained trees with a threshold per kind; small enough to travel with every task."""

    def __init__(self, trees: Trees | None, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def spans(self, text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
        """(basic spans, all spans), each sorted by start and then by kind as listed."""
        base = [(a, b, kind) for kind, a, b, ok in shaped(text) if ok]
        more = candidates(text) if self.trees is not None else []
        added: list[tuple[int, int, str]] = []
        if more:
            starts, ends = _covered(base)
            p = np.concatenate([self.trees.probability(np.array([features(text, *c) for c in more[k : k + BLOCK]])) for k in range(0, len(more), BLOCK)])
            likely = []
            for (kind, a, b), q in zip(more, p.tolist()):
                i = bisect_left(starts, b)
                if q >= self.thresholds[kind] and (i == 0 or ends[i - 1] <= a):
                    likely.append((a, b, kind, q * sum(c.isalnum() for c in text[a:b])))
            added = _apart(likely)
        key = lambda s: (s[0], KINDS.index(s[2]), s[1])
        return sorted(base, key=key), sorted(base + added, key=key)


def train(docs: DataFrame, rows: int = LOCAL_ROWS, precision: float = PRECISION) -> Detector:
    """Fit on all candidates of all texts: by hash one half grows the trees, the other calibrates them and sets the thresholds.

    ``rows`` only decides where sums are taken; the result does not depend on it, nor on how documents are dealt.
    """
    drawn = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_learnable, "h long, x array<double>, y double, n double")
    # copies of one candidate and its surroundings count once, or a text of very many copies would outweigh all others
    drawn = staged(drawn.groupBy("h", "y").agg(F.min("x").alias("x"), F.max("n").alias("n")), "candidates")
    # by hash, so that repeated candidates lie in one half and only there
    drawn = drawn.withColumn("held", F.shiftright("h", 1).bitwiseAND(F.lit(1)) == 1)
    sizes = {(r["held"], r["y"]): r["n"] for r in drawn.groupBy("held", "y").agg(F.sum("n").alias("n")).collect()}
    if len({y for _, y in sizes}) < 2:
        return Detector(None, {})
    if len(sizes) < 4:
        drawn, sizes = drawn.withColumn("held", F.lit(False)), {(False, y): sum(n for (_, z), n in sizes.items() if z == y) for _, y in sizes}
    both = len(sizes) == 4
    learned = drawn.where("NOT held")
    # the values of a feature are digits, lengths and flags: few, whatever the number of candidates
    values = learned.select("n", F.posexplode("x").alias("k", "v")).groupBy("k", "v").agg(F.sum("n").alias("n")).toPandas()
    cuts = [cuts_of(own["v"].to_numpy(), own["n"].to_numpy()) for _, own in values.groupby("k")]
    counted = drawn.select("x", "held", "y", "n").mapInArrow(_binned(cuts), "bins binary, kind int, held boolean, y double, n double")
    counted = staged(counted.groupBy("bins", "kind", "held", "y").agg(F.sum("n").alias("n")), "binned")
    share = sizes[False, 1.0] / (sizes[False, 0.0] + sizes[False, 1.0])
    trees = _grow(counted.where("NOT held").groupBy("bins", "y").agg(F.sum("n").alias("n")), cuts, share, rows)
    checked = counted.where("held") if both else counted
    scores = checked.select("bins", "kind", "y", "n").mapInArrow(_scores(trees, cuts), "raw double, kind int, y double, n double")
    # log-odds have three digits, so their table has a bounded size
    table = scores.groupBy("raw", "kind", "y").agg(F.sum("n").alias("n")).orderBy("raw", "kind", "y").toPandas()
    kinds = [table["kind"].to_numpy() == k for k in range(len(KINDS))]
    trees, thresholds = calibrated(trees, *(table[c].to_numpy() for c in ("raw", "y", "n")), kinds, precision)
    return Detector(trees, dict(zip(KINDS, thresholds)))


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """Counts of the basic formats, digest of their spans and all spans, per document.

    Null and empty texts have none. Repeated rows are each returned, null ids stay null, further
    columns are ignored. A base span is never dropped; an added span does not overlap one, and of
    overlapping candidates those are added that together cover most, weighted by their probability.
    """
    own = detector or train(docs)

    def task(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = own.spans(text.as_py() or "")
                kinds = [s[2] for s in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(every),
                             len(every) - len(base)))
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(task, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named by the first."""
    merged: list[list] = []
    for a, b, kind in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b, kind])
    out, last = [], 0
    for a, b, kind in merged:
        out += [text[last:a], f"<{kind.upper()}>"]
        last = b
    return "".join(out) + text[last:]


def redact(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """The same rows and columns with personal data replaced in ``text``; null texts stay null."""
    own = detector or train(docs)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redacted(t, own.spans(t)[1]) if t else t)

    return docs.withColumn("text", clean(F.col("text").cast("string")))
