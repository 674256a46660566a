"""Flags of many code rules through an index of their fixed parts.

A rule begins, ends or is a fixed text. These texts are rows of a table, and a
distinct code looks its own beginnings and ends up there, one for each length that
occurs among them. So a code costs as many lookups as it has such beginnings,
however many rules there are, and only patterns whose fixed part it shares are matched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.operators.rules import BITS, CodeRule, _flags

WHOLE, HEAD, TAIL = "whole", "head", "tail"
ENTRY_SCHEMA = "rule int, side string, anchor string, pattern string, veto boolean"
#: Rule entries up to this number are broadcast to the distinct codes; more are joined by a shuffle.
BROADCAST_ENTRIES = 200_000


def _pattern_entry(pattern: str) -> tuple[str, str, str | None]:
    """Side, fixed text and, where that does not decide alone, the pattern to match.

    The longer fixed end is the anchor; the fixed parts end at the first and begin after the last wildcard or escape.
    """
    wild = [i for i, c in enumerate(pattern) if c in "%_\\"]
    if not wild:
        return WHOLE, pattern, None
    head, tail = pattern[: wild[0]], "" if pattern[wild[-1]] == "\\" else pattern[wild[-1] + 1 :]
    single = pattern.strip("%") in (head, tail) and len(pattern) - len(pattern.strip("%")) == len(wild)
    if single and not (head and tail) and (pattern[: 1] == "%") != (pattern[-1:] == "%"):
        return (HEAD, head, None) if head else (TAIL, tail, None)
    return (HEAD, head, pattern) if len(head) >= len(tail) else (TAIL, tail, pattern)


def entries(rules: Sequence[CodeRule]) -> list[tuple[int, str, str, str | None, bool]]:
    """(rule, side, anchor, pattern, veto) of all rules."""
    out = []
    for i, r in enumerate(rules):
        out += [(i, HEAD, p, None, False) for p in r.prefixes]
        out += [(i, WHOLE, p, None, False) for p in r.exact]
        out += [(i, *_pattern_entry(p), False) for p in r.patterns]
        out += [(i, HEAD, p, None, True) for p in r.veto]
    return sorted(set(out), key=lambda e: (e[0], e[1], e[2], e[3] or "", e[4]))


def code_rules(codes: DataFrame, code: str, rules: Sequence[CodeRule]) -> DataFrame:
    """(code, rule): the numbers of the rules that each distinct code raises. NULL codes raise none."""
    listed = entries(rules)
    index = codes.sparkSession.createDataFrame(listed, ENTRY_SCHEMA)
    if len(listed) <= BROADCAST_ENTRIES:
        index = F.broadcast(index)
    known = codes.select(F.col(code).alias("code")).where("code IS NOT NULL").distinct()
    size = F.length("code")
    starts = {
        WHOLE: lambda n: F.col("code"),
        HEAD: lambda n: F.substring(F.col("code"), F.lit(1), n),
        TAIL: lambda n: F.substring(F.col("code"), size - n + F.lit(1), n),
    }
    parts = []
    for side, text in starts.items():
        lengths = sorted({len(e[2]) for e in listed if e[1] == side})
        if lengths:
            fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n == size if side == WHOLE else n <= size)  # noqa: B023
            parts.append(F.transform(fitting, lambda n: F.struct(F.lit(side).alias("side"), text(n).alias("anchor"))))  # noqa: B023
    if not parts:
        return known.select("code", F.lit(0).alias("rule")).limit(0)
    keys = known.select("code", F.explode(F.concat(*parts)).alias("k")).select("code", "k.side", "k.anchor")
    met = keys.join(index, ["side", "anchor"]).where(F.col("pattern").isNull() | F.like("code", F.col("pattern")))
    found = met.groupBy("code", "rule").agg(F.bool_or("veto").alias("vetoed"))
    return found.where(~F.col("vetoed")).select("code", "rule")


def raised_flags(events: DataFrame, key: str, code: str, rules: Sequence[CodeRule]) -> DataFrame:
    """(key, flag) of every flag that an event of the key raises, for rule sets of any size.

    Equal flags of several rules are one flag. The join of events with their codes carries no broadcast hint: adaptive execution
    broadcasts the coded texts if their measured size allows, and splits hot codes otherwise.
    """
    names = F.array(*[F.lit(r.flag) for r in rules]) if rules else F.array().cast("array<string>")
    flags = code_rules(events, code, rules).groupBy("code").agg(F.collect_set(F.get(names, F.col("rule"))).alias("_flags"))
    hits = events.select(key, F.col(code).alias("code")).join(flags, "code")
    return hits.select(key, F.explode("_flags").alias("flag")).distinct()


def event_flags_by_index(events: DataFrame, key: str, code: str, rules: Sequence[CodeRule]) -> DataFrame:
    """One 0/1 column per rule for keys with at least one hit, as ``event_flags_by_dictionary`` gives them."""
    found = code_rules(events, code, rules)
    masks = []
    for first in range(0, len(rules), BITS):
        inside = F.col("rule").between(first, min(first + BITS, len(rules)) - 1)
        bit = F.expr(f"shiftleft(1L, rule - {first})")
        masks.append(F.coalesce(F.bit_or(F.when(inside, bit)), F.lit(0).cast("bigint")).alias(f"_mask{first // BITS}"))
    dictionary = found.groupBy("code").agg(*masks)
    hits = events.select(key, F.col(code).alias("code")).join(dictionary, "code")
    merged = hits.groupBy(key).agg(*[F.bit_or(f"_mask{k}").alias(f"_mask{k}") for k in range(len(masks))])
    return _flags(merged, key, rules)
