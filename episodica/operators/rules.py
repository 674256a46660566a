"""Rule-based flags over hierarchical code text (``'a|b|c'``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.functions.columns import any_of

#: Rules whose flags one long carries.
BITS = 62


def _like(code: Column, pattern: str) -> Column:
    """LIKE whose fixed start and end are tested first: few texts reach the regular expression.

    The fixed parts end at the first and begin after the last of ``%``, ``_`` and the escape.
    """
    wild = [i for i, c in enumerate(pattern) if c in "%_\\"]
    if not wild:
        return code == pattern
    test = code.like(pattern)
    head, tail = pattern[: wild[0]], "" if pattern[wild[-1]] == "\\" else pattern[wild[-1] + 1 :]
    if tail:
        test = code.endswith(tail) & test
    return code.startswith(head) & test if head else test


@dataclass(frozen=True)
class CodeRule:
    """One flag and the code texts that raise it.

    ``prefixes`` match the start of the text, ``patterns`` are LIKE patterns
    with inner wildcards, ``exact`` match the whole text with its whitespace.
    A text that starts with one of ``veto`` never raises the flag itself,
    although another event of the same episode still may.
    """

    flag: str
    prefixes: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    exact: tuple[str, ...] = ()
    veto: tuple[str, ...] = ()

    def positive(self, code: Column) -> Column:
        tests = [code.startswith(p) for p in self.prefixes]
        tests += [_like(code, p) for p in self.patterns]
        if self.exact:
            tests.append(code.isin(*self.exact))
        return any_of(tests)

    def hit(self, code: str | Column) -> Column:
        """0/1 for one event; 0 for a NULL code."""
        code = F.col(code) if isinstance(code, str) else code
        positive = F.when(self.positive(code), 1).otherwise(0)
        if not self.veto:
            return positive
        return F.when(any_of([code.startswith(p) for p in self.veto]), 0).otherwise(positive)


def rule_mask(code: str | Column, rules: Sequence[CodeRule], first_bit: int = 0) -> Column:
    """All rules of one event as bits of a long: rule i sets bit ``first_bit + i``."""
    if first_bit + len(rules) > BITS:
        raise ValueError(f"at most {BITS} flags fit one mask; event_flags takes as many masks as it needs")
    mask = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules, first_bit):
        mask = mask.bitwiseOR(F.when(rule.hit(code) == 1, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return mask


def _masks(code: str | Column, rules: Sequence[CodeRule]) -> list[Column]:
    """As many masks as the rules need, 62 rules each."""
    return [rule_mask(code, rules[i : i + BITS]).alias(f"_mask{i // BITS}") for i in range(0, len(rules), BITS)]


def _flags(masks: DataFrame, key: str, rules: Sequence[CodeRule]) -> DataFrame:
    return masks.select(key, *[mask_flag(f"_mask{i // BITS}", i % BITS).alias(r.flag) for i, r in enumerate(rules)])


def mask_flag(mask: str | Column, bit: int) -> Column:
    """0/1 of one bit; a missing mask has no bits."""
    mask = F.col(mask) if isinstance(mask, str) else mask
    return F.coalesce(F.shiftright(mask, bit).bitwiseAND(F.lit(1)), F.lit(0)).cast("int")


def event_flags(events: DataFrame, key: str, code: str, rules: Sequence[CodeRule]) -> DataFrame:
    """Any-match flags per key in one pass.

    All flags of an event travel as one long, so the map-side combine and the
    shuffle carry a key and a mask, however many rules there are.
    """
    masks = events.select(key, *_masks(code, rules))
    names = [c for c in masks.columns if c != key]
    return _flags(masks.groupBy(key).agg(*[F.bit_or(c).alias(c) for c in names]), key, rules)


def classify_codes(codes: DataFrame, code: str, rules: Sequence[CodeRule]) -> DataFrame:
    """Flags of each distinct code text, for codes that raise at least one."""
    flags = [r.hit(code).cast("int").alias(r.flag) for r in rules]
    known = codes.select(code).where(F.col(code).isNotNull()).distinct().select(code, *flags)
    return known.where(F.greatest(*[F.col(r.flag) for r in rules], F.lit(0)) > 0)


def event_flags_by_dictionary(
    events: DataFrame, key: str, code: str, rules: Sequence[CodeRule]
) -> DataFrame:
    """The same flags with each distinct code classified once and joined back.

    Pays a second scan of the code column to test every rule once per distinct
    text. The join carries no broadcast hint: adaptive execution broadcasts the
    dictionary when its measured size allows and splits hot codes otherwise.
    Keys whose events raise nothing are absent; ``flags_for_all`` adds them.
    """
    dictionary = classify_codes(events, code, rules)
    masks = []
    for first in range(0, len(rules), BITS):
        bits = F.lit(0).cast("bigint")
        for i, r in enumerate(rules[first : first + BITS]):
            bits = bits.bitwiseOR(F.shiftleft(F.col(r.flag).cast("bigint"), i))
        masks.append(bits.alias(f"_mask{first // BITS}"))
    merged = (
        events.select(key, code)
        .join(dictionary.select(code, *masks), code)
        .groupBy(key)
        .agg(*[F.bit_or(f"_mask{k}").alias(f"_mask{k}") for k in range(len(masks))])
    )
    return _flags(merged, key, rules)


def flags_for_all(base: DataFrame, flags: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Every key of ``base`` with its flags; a key without events has 0."""
    keys = base.select(key).distinct()
    return keys.join(flags, key, "left").select(
        key, *[F.coalesce(F.col(n), F.lit(0)).cast("int").alias(n) for n in names]
    )


@dataclass(frozen=True)
class Source:
    """Events of a table that mean an exposure. Sources of one frame share its scan."""

    frame: DataFrame
    condition: Column | None = None


def exposure_flags(
    base: DataFrame, key: str, exposures: Mapping[str, Sequence[Source | DataFrame]]
) -> DataFrame:
    """One 0/1 column per exposure: does any source hold an event of the key?

    A source is a frame of qualifying events, or a frame with a condition. Every frame is read once: an event carries all
    exposures that it means as bits, events without any are dropped at the scan, and the bits of
    all frames are merged in one aggregation, so several sources never multiply each other's rows.
    """
    names = list(exposures)
    scans: dict[int, tuple[DataFrame, dict[int, list[Column]]]] = {}
    for bit, sources in enumerate(exposures.values()):
        for source in sources:
            source = source if isinstance(source, Source) else Source(source)
            _, tests = scans.setdefault(id(source.frame), (source.frame, {}))
            tests.setdefault(bit, []).append(F.lit(True) if source.condition is None else F.coalesce(source.condition, F.lit(False)))
    masks = range(0, len(names), BITS)
    stacked = None
    for frame, tests in scans.values():
        hits = {bit: any_of(found) for bit, found in tests.items()}
        bits = [
            _or_all([F.when(hit, F.lit(1 << (bit - first))).otherwise(F.lit(0)).cast("bigint") for bit, hit in hits.items() if first <= bit < first + BITS])
            .alias(f"_mask{first // BITS}") for first in masks
        ]
        part = frame.where(any_of(list(hits.values()))).select(key, *bits)
        stacked = part if stacked is None else stacked.unionByName(part)
    merged = stacked.groupBy(key).agg(*[F.bit_or(f"_mask{m // BITS}").alias(f"_mask{m // BITS}") for m in masks])
    flags = merged.select(key, *[mask_flag(f"_mask{i // BITS}", i % BITS).alias(n) for i, n in enumerate(names)])
    return flags_for_all(base, flags, key, names)


def _or_all(masks: Sequence[Column]) -> Column:
    out = F.lit(0).cast("bigint")
    for m in masks:
        out = out.bitwiseOR(m)
    return out


def exclude_flagged(base: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` whose key is not among the flagged keys."""
    return base.join(flagged.select(key), key, "left_anti")
