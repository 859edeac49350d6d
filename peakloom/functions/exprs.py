"""Column expressions over compositions (``array<int>`` in block order) and masses.

Everything here is a Catalyst expression: no UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ADDUCT_MASS, MASS_UNIT, REDUCTION_MASS


def doubles(values: Sequence[float] | Column) -> Column:
    if isinstance(values, Column):
        return values
    return F.array(*[F.lit(float(v)) for v in values]) if len(values) else F.array().cast("array<double>")


def strings(values: Sequence[str] | Column) -> Column:
    if isinstance(values, Column):
        return values
    return F.array(*[F.lit(v) for v in values]) if len(values) else F.array().cast("array<string>")


def bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), place)


def block_bits(counts: Column) -> Column:
    """A mask of the blocks that are counted."""
    return F.aggregate(F.transform(counts, lambda n, i: F.when(n > 0, bit(i)).otherwise(0)), F.lit(0), lambda a, x: a + x)


def total(array: Column, kind: str = "int") -> Column:
    return F.aggregate(array, F.lit(0).cast(kind), lambda a, x: a + x)


def l1(array: Column) -> Column:
    return total(F.transform(array, F.abs))


def dot(counts: Column, masses: Column) -> Column:
    """Sum of counts times masses, added in block order."""
    return total(F.zip_with(counts, masses, lambda n, m: n * m), "double")


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def common_mass(composition: dict[str, int], masses: dict[str, float], label: float = 0.0, mode: str | None = None, reduction: str | None = None) -> float:
    """The shared mass. Names the dictionary lacks are ignored; unknown modes and reductions add nothing."""
    blocks = sum(n * masses[b] for b, n in composition.items() if b in masses)
    return blocks + label + ADDUCT_MASS.get(mode, 0.0) + REDUCTION_MASS.get(reduction, 0.0)


def common_masses(names: Column, counts: Column, masses: dict[str, float], label: float, mode: Column, reduction: Column) -> Column:
    """P1 for each row: common_mass() of its own composition, mode and reduction."""
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    of = lambda d, key: F.coalesce(F.try_element_at(table(d), key), F.lit(0.0))
    return total(F.zip_with(names, counts, lambda b, n: n * of(masses, b)), "double") + F.lit(label) + of(ADDUCT_MASS, mode) + of(REDUCTION_MASS, reduction)


def counted(names: Column, counts: Column) -> Column:
    """The parts 3Hex, 2HexNAc of what is counted."""
    return F.filter(F.zip_with(names, counts, lambda b, n: F.when(n > 0, F.concat(n.cast("string"), b))), lambda p: p.isNotNull())


def composition_name(names: Column, counts: Column) -> Column:
    """3Hex+2HexNAc; Common where nothing is counted."""
    parts = counted(names, counts)
    return F.when(F.size(parts) > 0, F.array_join(parts, "+")).otherwise("Common")


def merged_structure(common: dict[str, int], block_names: Sequence[str], counts: Column) -> Column:
    """Common and own counts together, blocks in order, then what else the common part has; null for a null composition."""
    rest = [b for b in common if b not in block_names]
    sums = F.zip_with(counts, F.array(*[F.lit(common.get(b, 0)) for b in block_names]), lambda x, y: x + y)
    sums = F.concat(sums, F.array(*[F.lit(common[b]) for b in rest])) if rest else sums
    parts = counted(strings([*block_names, *rest]), sums)
    return F.when(counts.isNotNull(), F.when(F.size(parts) > 0, F.array_join(parts, " + ")).otherwise("(core only)"))


def nearest_multiple(value: Column, base: float = MASS_UNIT) -> Column:
    """Half-even rounding to a multiple."""
    return F.rint(value / base) * base


def multiple_distance(value: Column, base: float = MASS_UNIT) -> Column:
    """P5."""
    return F.abs(value - nearest_multiple(value, base))


def formula(common_name: str, names: Column, counts: Column) -> Column:
    """Common + 2Hex + 1dHex."""
    return F.array_join(F.concat(F.array(F.lit(common_name)), counted(names, counts)), " + ")


def bic(n: Column, rss: Column, k: Column) -> Column:
    """P9."""
    return n * F.log(F.greatest(rss, F.lit(1e-10)) / n) + k * F.log(n)


def adjusted_bic(raw: Column, n: Column, masses: Column) -> Column:
    """P10: 2 n ln(300 / max(m, 1)) for each new mass; infinite without a finite BIC."""
    penalty = total(F.transform(masses, lambda m: 2 * n * F.log(F.lit(300.0) / F.greatest(m, F.lit(1.0)))), "double")
    return F.when(raw.isNull() | (raw == float("inf")), F.lit(float("inf"))).otherwise(raw + penalty)


def is_multiple(residual: Column, mass: Column, tolerance: float) -> Column:
    """Whether a residual is about a positive whole multiple of a mass."""
    k = F.rint(residual / mass)
    return (k >= 1) & (F.abs(residual - k * mass) < tolerance)


def transition_kind(delta: Column) -> Column:
    """Identity, mixed, clean, skip or multi; mixed is tested before clean."""
    size, up, down = l1(delta), F.exists(delta, lambda x: x > 0), F.exists(delta, lambda x: x < 0)
    blocks = F.size(F.filter(delta, lambda x: x != 0))
    return F.when(size == 0, "identity").when(up & down, "mixed").when(size == 1, "clean").when(blocks == 1, "skip").otherwise("multi")


def transition_penalty(delta: Column) -> Column:
    """Of P12: 2, 2 L1, 0, L1 - 1 and L1 - 1."""
    size, kind = l1(delta).cast("double"), transition_kind(delta)
    return F.when(kind == "identity", 2.0).when(kind == "mixed", 2 * size).otherwise(size - 1)


def canonical_step(a: Column, b: Column) -> Column:
    """The larger of b - a and a - b; null unless 1 <= L1 <= 2."""
    d = minus(b, a)
    return F.when(l1(d).between(1, 2), F.greatest(d, minus(a, b)))


def delta_label(names: Column, delta: Column) -> Column:
    """+2Hex -dHex in block order; ±0 without a change."""
    one = lambda b, n: F.when(n != 0, F.concat(F.when(n > 0, "+").otherwise("-"), F.when(F.abs(n) > 1, F.abs(n).cast("string")).otherwise(""), b))
    parts = F.filter(F.zip_with(names, delta, one), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("±0")


def addition_label(names: Column, delta: Column) -> Column:
    """A pure loss reads as the addition that undoes it; other steps as they are."""
    loss = ~F.exists(delta, lambda n: n > 0)
    return delta_label(names, F.when(loss, F.transform(delta, lambda n: -n)).otherwise(delta))


def composition_label(names: Column, counts: Column) -> Column:
    """Hex×3 dHex×1; (empty) for nothing."""
    parts = F.filter(F.zip_with(names, counts, lambda b, n: F.when(n > 0, F.concat_ws("×", b, n.cast("string")))), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise("(empty)")


def block_count(text: Column) -> Column:
    """A count from text, truncated; 0 for anything else."""
    return F.coalesce(text.try_cast("double").try_cast("int"), F.lit(0))


def job_name(text: Column) -> Column:
    """Letters, digits and -_. stay."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}\-_.]", "_")


def masked(counts: Column, allowed: Column, names: Column) -> Column:
    """P20: counts of blocks outside the model become 0."""
    return F.zip_with(counts, names, lambda n, b: F.when(F.array_contains(allowed, b), n).otherwise(0))


def reordered_label(label: Column, order: Column) -> Column:
    """A model label's parts in biosynthetic order, unknown parts last; consensus labels stay."""
    parts = F.split(label, r"\+")
    place = lambda p: F.when(F.array_contains(order, p), F.array_position(order, p)).otherwise(F.size(order) + 1)
    keyed = F.array_sort(F.transform(parts, lambda p, i: F.struct(place(p).alias("o"), i.alias("i"), p.alias("p"))))
    return F.when(label.contains("Consensus"), label).otherwise(F.array_join(F.transform(keyed, lambda x: x["p"]), "+"))
