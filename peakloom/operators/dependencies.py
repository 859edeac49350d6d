"""Dependencies between blocks, inferred from which models use them.

Sets of blocks are bit masks: an intersection over models is a bit_and aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bit, block_bits, strings
from .compare import WORD, kept_masks, packed_words, perfect_masks, perfect_words


def block_usage_across_models(fits: DataFrame, n_blocks: int, tolerance: float) -> DataFrame:
    """Per sample and block, models with it, models that use it (some GOOD peak has a copy), and prerequisites: the other
    blocks that all using models share, none if no model uses it."""
    used = block_bits(F.col("composition"))
    return _usage(fits.groupBy("sample_id", "mask").agg(F.coalesce(F.bit_or(F.when(F.col("error") < tolerance, used)), F.lit(0)).alias("used")), n_blocks)


def block_usage_of_peaks(explained: DataFrame, n_blocks: int) -> DataFrame:
    """block_usage_across_models() over the models that contain no other perfect one, from compare.explained_peaks(). A sample's peaks are reduced to a few words: a bit for each perfect model,
    and n_blocks bits for each model's used blocks."""
    k, each = n_blocks, WORD // n_blocks
    good, blocks = F.col("good"), 2**n_blocks - 1
    perfect = {f"__p{w}": c for w, c in enumerate(perfect_words(good, k))}
    used = {f"__u{w}": c for w, c in enumerate(packed_words(good, lambda f: block_bits(f["composition"]), k, k))}
    rows = explained.select("sample_id", *(c.alias(n) for n, c in (perfect | used).items()))
    rows = rows.groupBy("sample_id").agg(*(F.bit_and(n).alias(n) for n in perfect), *(F.bit_or(n).alias(n) for n in used))
    rows = rows.withColumn("mask", F.explode(kept_masks(perfect_masks([F.col(n) for n in perfect], k), k)))
    word = F.get(F.array(*used), F.floor(F.col("mask") / each).cast("int"))
    return _usage(rows.select("sample_id", "mask", F.call_function("shiftright", word, F.col("mask") % each * k).bitwiseAND(F.lit(blocks)).cast("int").alias("used")), k)


def _usage(models: DataFrame, n_blocks: int) -> DataFrame:
    """models: (sample_id, mask, used), a row for each model."""
    each = models.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).where(F.getbit("mask", F.col("block")) == 1)
    is_used = F.getbit("used", F.col("block")) == 1
    others = F.col("mask").bitwiseAND(F.bitwise_not(bit(F.col("block"))))
    return each.groupBy("sample_id", "block").agg(
        F.count(F.lit(1)).alias("n_with"), F.count_if(is_used).alias("n_used"), F.count_if(~is_used).alias("n_not_used"), F.coalesce(F.bit_and(F.when(is_used, others)), F.lit(0)).alias("prerequisites")
    )


def direct_dependencies(usage: DataFrame) -> DataFrame:
    """Prerequisites less those of the prerequisites, in one pass: two blocks that need each other keep their edges."""
    every = F.collect_list(F.struct("block", "prerequisites")).over(Window.partitionBy("sample_id"))  # a row for each block
    needs = lambda b: F.getbit(F.col("prerequisites"), b["block"]) == 1
    indirect = F.aggregate("__every", F.lit(0), lambda a, b: a.bitwiseOR(F.when(needs(b), b["prerequisites"]).otherwise(0)))
    return usage.withColumn("__every", every).withColumn("direct", F.col("prerequisites").bitwiseAND(F.bitwise_not(indirect))).drop("__every")


def topological_order(direct: Sequence[int]) -> list[int]:
    """Block positions with all direct dependencies first, the earliest position among the free ones; what a cycle holds comes last."""
    done: list[int] = []
    waiting = list(range(len(direct)))
    while free := [b for b in waiting if not any(direct[b] >> p & 1 for p in waiting)]:
        done.append(free[0])
        waiting.remove(free[0])
    return done + waiting


def block_orders(dependencies: DataFrame) -> DataFrame:
    """sample_id, ordering array<int>: one row of at most a few dozen masks for each sample goes through the helper above."""

    @F.pandas_udf("array<int>")
    def ordered(direct: pd.Series) -> pd.Series:
        return direct.map(topological_order)

    masks = F.transform(F.array_sort(F.collect_list(F.struct("block", "direct"))), lambda x: x["direct"])
    return dependencies.groupBy("sample_id").agg(masks.alias("masks")).select("sample_id", ordered("masks").alias("ordering"))


def dependency_report(dependencies: DataFrame, block_names: Sequence[str] | Column) -> DataFrame:
    """K6: a row for each block in biosynthetic order. block_names: of all samples, or a column of dependencies."""
    named = lambda mask: F.filter(F.transform(strings(block_names), lambda b, i: F.when(F.getbit(mask, i) == 1, b)), lambda b: b.isNotNull())
    show = lambda mask, none: F.when(mask == 0, none).otherwise(F.array_join(F.array_sort(named(mask)), "+"))
    rows = dependencies.join(block_orders(dependencies), "sample_id")
    return rows.select(
        "sample_id", F.get(strings(block_names), F.col("block")).alias("block"), show(F.col("prerequisites"), "(none)").alias("prerequisites"), show(F.col("direct"), "(root)").alias("direct_dependencies"),
        F.array_position("ordering", F.col("block")).cast("int").alias("biosynthetic_order"), "n_with", "n_used", "n_not_used",
    )


def dependency_edges(dependencies: DataFrame, block_names: Sequence[str]) -> DataFrame:
    """(parent, child) in order of the parents."""
    rows = dependencies.join(block_orders(dependencies), "sample_id").withColumn("p", F.explode(F.filter("ordering", lambda i: F.getbit(F.col("direct"), i) == 1)))
    name = lambda c: F.get(strings(block_names), F.col(c))
    return rows.select("sample_id", name("p").alias("parent"), name("block").alias("child"), F.array_position("ordering", F.col("p")).cast("int").alias("parent_order"))


def tree_lines(report: list[dict]) -> list[str]:
    """K7: one sample's report rows as an indented tree, children in biosynthetic order; a block with several parents shows under each."""
    order = {r["block"]: r["biosynthetic_order"] for r in report}
    parents = {r["block"]: [] if r["direct_dependencies"] == "(root)" else r["direct_dependencies"].split("+") for r in report}
    lines: list[str] = []

    def show(block: str, indent: str, last: bool, above: tuple) -> None:
        lines.append(f"{indent}{'└── ' if last else '├── '}{block}")
        kids = sorted((b for b in parents if block in parents[b] and b not in above), key=order.get)
        for kid in kids:
            show(kid, indent + ("    " if last else "│   "), kid == kids[-1], (*above, kid))

    roots = sorted((b for b in parents if not parents[b]), key=order.get)
    for root in roots:
        show(root, "", root == roots[-1], (root,))
    return lines
