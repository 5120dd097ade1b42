"""Mixing sources to target weights by hierarchical token budgets.

Documents hang on the leaves of a tree given by a path of columns, such as domain, language
and source.  The token budget goes down the tree by the weights of siblings.  A node that
cannot use its share, because all its documents repeat at most ``epochs`` times, leaves the
rest to its siblings; only what no sibling can use is left to the siblings of the parent, since
a parent never asks for more than its children can hold.  Each leaf takes whole epochs of its
documents and then a prefix of one more epoch, in an order seeded by epoch and document.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.sources.stages import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the order key that one step of the prefix search resolves, and its steps.
_DIGITS, _STEPS = 2, 3
_RESERVED = frozenset(
    "row k n o n_tokens n_taken epoch supply granted capacity weight budget used passed all share full rest part prefix left before cut_key cut_tokens _o".split()
)


@dataclass(frozen=True)
class Level:
    """One level of the tree: the node's name and its whole-number weight among its siblings."""

    name: str
    value: Column
    weight: Column


def _same(a: Sequence[str], left: DataFrame, right: DataFrame) -> Column:
    condition = F.lit(True)
    for c in a:
        condition = condition & left[c].eqNullSafe(right[f"_r_{c}"])
    return condition


def _beside(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on columns that may be null; the columns of ``left``, then the other new ones."""
    other = right.select(*(F.col(c).alias(f"_r_{c}" if c in on else c) for c in right.columns))
    return left.join(other, _same(on, left, other)).drop(*(f"_r_{c}" for c in on))


def budgets(leaves: DataFrame, levels: Sequence[Level], budget: int, epochs: int) -> DataFrame:
    """``leaves`` (names, ``supply``) with ``granted``: the tokens each may take.

    Among siblings ``share * weight`` tokens are granted up to what a node can hold.  With
    siblings in the order of capacity over weight, the share is the largest of the budget left
    by the nodes before over the weight from there on.  Shares are rounded down, so a node
    leaves less than one token per child.  Nodes of weight 0 get nothing.
    """
    names = [level.name for level in levels]
    current = None
    for depth, level in enumerate(levels):
        parent, path = names[:depth], names[: depth + 1]
        usable = leaves
        for below in levels:  # capacity under a node of weight 0 can't be used
            usable = usable.withColumn("supply", F.when(below.weight > 0, F.col("supply")).otherwise(0))
        nodes = usable.groupBy(*path).agg((F.sum("supply") * epochs).alias("capacity"))
        nodes = nodes.withColumn("weight", level.weight.cast("bigint")).where("weight > 0 and capacity > 0")
        if current is None:
            nodes = nodes.withColumn("budget", F.lit(int(budget)).cast("bigint"))
        else:
            nodes = _beside(nodes, current, parent)
        siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        before = siblings.orderBy(F.col("capacity") / F.col("weight"), F.col(level.name).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumns(
            {
                "used": F.coalesce(F.sum("capacity").over(before), F.lit(0)),
                "passed": F.coalesce(F.sum("weight").over(before), F.lit(0)),
                "all": F.sum("weight").over(siblings),
            }
        )
        nodes = nodes.withColumn("share", (F.col("budget") - F.col("used")).cast("double") / (F.col("all") - F.col("passed")).cast("double"))
        nodes = nodes.withColumn("share", F.max("share").over(siblings))
        granted = F.least("capacity", F.floor(F.col("share") * F.col("weight")).cast("bigint"))
        current = nodes.select(*path, granted.alias("budget"))
    return _beside(leaves.where("supply > 0"), current.withColumnRenamed("budget", "granted"), names)


def _order_key(seed: int, epoch: Column, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def _cuts(rows: DataFrame, plan: DataFrame, names: list[str]) -> DataFrame:
    """``plan`` with the order key where each leaf's last epoch ends and the tokens taken there.

    ``rows`` holds names, ``o`` (order key) and ``n_tokens``.  The key is found digit by digit:
    each step sums tokens by the next digits of the rows that share the digits found so far,
    so no leaf is ever sorted whole.
    """
    cut = plan.withColumns({"prefix": F.lit(""), "left": F.col("rest")}).where("rest > 0")
    for step in range(_STEPS + 1):
        last = step == _STEPS
        inside = _beside(rows, cut.select(*names, "prefix", "left"), names).where(F.col("o").startswith(F.col("prefix")))
        part = F.col("o") if last else F.substring("o", 1, _DIGITS * (step + 1))
        sums = inside.groupBy(*names, "left", part.alias("part")).agg(F.sum("n_tokens").alias("n"))
        before = Window.partitionBy(*names).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        found = sums.where((F.col("before") < F.col("left")) & (F.col("before") + F.col("n") >= F.col("left")))
        cut = stage(found.select(*names, F.col("part").alias("prefix"), (F.col("left") - F.col("before")).alias("left")), "cuts")
    ends = cut.select(*names, F.col("prefix").alias("cut_key"), F.col("left").alias("cut_tokens"))
    open_ = plan.where("rest = 0").withColumns({"cut_key": F.lit(""), "cut_tokens": F.lit(0).cast("bigint")})
    return _beside(plan, ends, names).unionByName(open_)


def mix(
    docs: DataFrame, levels: Sequence[Level], share: tuple[int, int] = (1, 1), epochs: int = 1, seed: int = 0, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """The chosen rows of ``docs`` with the levels' names, ``epoch``, ``n_tokens`` and ``n_taken``.

    The budget is ``share`` (numerator, denominator) of all tokens; tokens are runs without
    ASCII white space.  A row comes once per epoch it is chosen in.  Where an epoch ends inside
    a document, ``text`` holds its first ``n_taken`` tokens; all other texts are whole.  Null
    texts count as empty, null names are names of their own.  Rows that share a key are chosen
    together, each cut at the same number of tokens.  Columns of ``docs`` that have the name of
    a new column are replaced.
    """
    names = [level.name for level in levels]
    if taken := {*names} & _RESERVED:
        raise ValueError(f"levels may not be called {sorted(taken)}")
    new = ["epoch", "n_tokens", "n_taken"]
    row = F.struct(*docs.columns).alias("row")
    rows = docs.select(row, F.col(key).alias("k"), *(level.value.alias(level.name) for level in levels))
    before = F.col("row")[text]
    tokens = F.coalesce(F.regexp_count(before, F.lit(WORD)), F.lit(0)).cast("bigint")
    narrow = stage(rows.select("k", *names, tokens.alias("n_tokens")), "tokens")
    leaves = stage(narrow.groupBy(*names).agg(F.sum("n_tokens").alias("supply")), "leaves")
    total = leaves.agg(F.sum("supply").alias("n")).first().n or 0
    plan = budgets(leaves, levels, total * share[0] // share[1], epochs)
    plan = plan.withColumn("full", F.expr("granted div supply")).withColumn("rest", F.expr("granted % supply"))
    plan = stage(plan.where("granted > 0").select(*names, "full", "rest"), "plan")
    ordered = _beside(narrow, plan.where("rest > 0").select(*names, "full"), names)
    ordered = stage(ordered.select(*names, _order_key(seed, F.col("full"), "k").alias("o"), "n_tokens"), "ordered")
    cuts = stage(_cuts(ordered, plan, names), "plan")
    rows = _beside(rows, cuts, names).withColumn("_o", _order_key(seed, F.col("full"), "k"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full"))))
    rows = rows.where("epoch < full or _o <= cut_key").withColumn("n_tokens", tokens)
    ends = (F.col("epoch") == F.col("full")) & (F.col("_o") == F.col("cut_key"))
    rows = rows.withColumn("n_taken", F.when(ends, F.least("n_tokens", "cut_tokens")).otherwise(F.col("n_tokens")))
    start = F.array_join(F.slice(F.regexp_extract_all(before, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), 0), F.lit(1), F.col("n_taken").cast("int")), "")
    after = {text: F.when(F.col("n_taken") < F.col("n_tokens"), start).otherwise(before)}
    own = [after.get(c, F.col("row")[c]).alias(c) for c in docs.columns if c not in new and c not in names]
    return rows.select(*own, *names, *new)
