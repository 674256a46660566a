"""Column expressions shared by the operators. All are JVM built-ins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES_PER_HOUR = 60
MINUTES_PER_DAY = 24 * MINUTES_PER_HOUR

Limits = tuple[float, float]


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Sequence[Column]) -> Column:
    """OR of several conditions."""
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def member(c: str | Column, values: Sequence) -> Column:
    """Null-safe membership: NULL is not a member."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def keyword_code(c: str | Column, words: Sequence[tuple[str, int]]) -> Column:
    """Code of the first word that occurs in the lowered text, else NULL."""
    text = F.lower(as_col(c))
    out = None
    for word, code in words:
        hit = text.contains(word)
        out = F.when(hit, F.lit(code)) if out is None else out.when(hit, F.lit(code))
    return out.cast("int")


def vital_status(c: str | Column) -> Column:
    """0 for text with 'alive', 1 for 'expired', else NULL."""
    return keyword_code(c, [("alive", 0), ("expired", 1)])


def sex_code(c: str | Column) -> Column:
    """0 for 'female', 1 for 'male', else NULL. 'female' contains 'male', so it is tested first."""
    return keyword_code(c, [("female", 0), ("male", 1)])


def whole_hours(minutes: str | Column) -> Column:
    """Minutes as hours, rounded half away from zero."""
    return F.round(as_col(minutes) / F.lit(MINUTES_PER_HOUR))


def keep_range(value: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """The value if it lies inside the inclusive limits, else NULL."""
    v = as_col(value)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (v >= F.lit(low))
    if high is not None:
        ok = ok & (v <= F.lit(high))
    return F.when(ok, v)


def keep_range_by_name(name: str | Column, value: str | Column, limits: Mapping[str, Limits]) -> Column:
    """Range rule per measurement name; names without a rule keep their value."""
    n, v = as_col(name), as_col(value)
    out = None
    for key, (low, high) in limits.items():
        inside = F.when((v >= F.lit(low)) & (v <= F.lit(high)), v)
        out = F.when(n == key, inside) if out is None else out.when(n == key, inside)
    return v if out is None else out.otherwise(v)


def guarded_ratio(num: str | Column, den: str | Column, zero_den: float | None = None) -> Column:
    """num / den; a zero divisor becomes ``zero_den``, or the result NULL."""
    d = F.nullif(as_col(den), F.lit(0).cast("double"))
    if zero_den is not None:
        d = F.when(as_col(den) == 0, F.lit(float(zero_den))).otherwise(d)
    return as_col(num) / d


def recode(c: str | Column, mapping: Mapping) -> Column:
    """Replace listed values, keep the others."""
    v = as_col(c)
    out = None
    for old, new in mapping.items():
        out = F.when(v == old, F.lit(new)) if out is None else out.when(v == old, F.lit(new))
    return v if out is None else out.otherwise(v)


def numeric_text(c: str | Column, special: Mapping[str, str] | None = None) -> Column:
    """Text to double; listed texts are replaced first, unreadable text gives NULL."""
    return recode(c, special or {}).try_cast("double")


def mass_index(weight_kg: str | Column, height_cm: str | Column) -> Column:
    """Weight over squared height in metres; NULL for height 0."""
    metres = as_col(height_cm) / F.lit(100.0)
    return as_col(weight_kg) / F.nullif(metres * metres, F.lit(0.0))


def left_closed_bin(value: str | Column, breaks: Sequence[float], labels: Sequence) -> Column:
    """Label of the bin [a, b) that holds the value; outer bins are open-ended."""
    if len(labels) != len(breaks) + 1:
        raise ValueError("need one label more than breaks")
    v = as_col(value)
    out = F.when(v < F.lit(breaks[0]), F.lit(labels[0]))
    for upper, label in zip(breaks[1:], labels[1:-1]):
        out = out.when(v < F.lit(upper), F.lit(label))
    return out.when(v.isNotNull(), F.lit(labels[-1]))


def bin_ordinal(value: str | Column, breaks: Sequence[float]) -> Column:
    """1-based number of the left-closed bin."""
    return left_closed_bin(value, breaks, list(range(1, len(breaks) + 2))).cast("int")


def level_ordinal(c: str | Column, levels: Sequence[str]) -> Column:
    """1-based position in an ordered level list, NULL for other values."""
    pos = F.array_position(F.array(*[F.lit(x) for x in levels]), as_col(c))
    return F.nullif(pos, F.lit(0)).cast("int")


def merge_levels(c: str | Column, members: Sequence[str], target: str) -> Column:
    """Replace several levels by one."""
    v = as_col(c)
    return F.when(v.isin(list(members)), F.lit(target)).otherwise(v)


def either_flag(a: str | Column, b: str | Column) -> Column:
    """1 if one flag is 1, 0 if both are known and not 1, NULL if that is unknown."""
    hit = (as_col(a) == 1) | (as_col(b) == 1)
    return F.when(hit, 1).when(~hit, 0).cast("int")


def override_where(target: str | Column, condition: Column, value) -> Column:
    """Overwrite where the condition holds; an unknown condition changes nothing."""
    t = as_col(target)
    return F.when(condition, F.lit(value)).otherwise(t)


def labelled(c: str | Column, labels: Mapping[str, str]) -> Column:
    """Display text of a name; names without a label stay as they are."""
    pairs = [F.lit(x) for kv in labels.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_col(c)), as_col(c))


def present(c: str | Column) -> Column:
    """1 where the value is known, else 0."""
    return F.when(as_col(c).isNotNull(), 1).otherwise(0).cast("int")
