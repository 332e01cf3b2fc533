"""Differences between two large states of a table, by a hash tree over their keys.

Keys are hashed to leaves; a leaf holds the number of its rows and the sums of two hashes of them, each node above the sums of its
`FANOUT` children. Two states are compared from the root down, and only children of nodes that differ are looked at, so equal
ranges cost one row each where they part from others. Only rows of leaves that differ are brought together and compared by cell.
A tree can be stored with its state, so a later comparison reads no rows of equal ranges at all but for the scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.values import value_text
from strata.session import StrataError, cut

#: Children of a node, as bits, and rows that a leaf has on average.
FANOUT_BITS = 4
LEAF_ROWS = 256
#: Leaves that differ and are sent to every task (about 16 bytes each); with more, rows and leaves are joined by a shuffle.
MOST_SENT = 200_000
_SUMS = ("n", "low1", "high1", "low2", "high2")


@dataclass(frozen=True)
class HashTree:
    """The levels of a tree in a stored table: level (0 is the root), node, number of rows and the sums of their hashes."""

    keys: tuple[str, ...]
    cells: tuple[str, ...]
    levels: int
    nodes: DataFrame


def levels_for(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Levels below the root that give leaves of about `leaf_rows` rows."""
    levels = 0
    while leaf_rows << (FANOUT_BITS * levels) < rows and levels < 12:
        levels += 1
    return levels


def _texts(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    return [value_text(F.col(f"`{c}`"), types[c.lower()]) for c in names]


def _hashed(texts: list[Column], seed: int) -> Column:
    # Nulls leave a hash as it is, so they are marked beside it.
    return F.xxhash64(F.lit(seed), *texts, *[t.isNull() for t in texts])


def _leaf(df: DataFrame, keys: tuple[str, ...], levels: int) -> Column:
    """The leaf of a row: the leading bits of its key's hash."""
    if not levels:
        return F.lit(0).cast("bigint")
    return F.shiftrightunsigned(_hashed(_texts(df, keys), 11), 64 - FANOUT_BITS * levels)


def shared_cells(baseline: DataFrame, edited: DataFrame, keys: list[str]) -> tuple[str, ...]:
    """The columns that both states have, but for the keys, as the baseline spells them."""
    barred, theirs = {k.lower() for k in keys}, {c.lower() for c in edited.columns}
    return tuple(c for c in baseline.columns if c.lower() not in barred and c.lower() in theirs)


def hash_tree(df: DataFrame, keys: list[str], cells: list[str], levels: int) -> HashTree:
    """The tree of a state: one pass over its rows, of which a task sends one sum per leaf."""
    key_names, cell_names = tuple(keys), tuple(cells)
    texts = _texts(df, key_names + cell_names)
    first, second = _hashed(texts, 12), _hashed(texts, 13)
    mask = F.lit(0xFFFFFFFF)
    rows = df.select(
        _leaf(df, key_names, levels).alias("node"), F.lit(1).cast("bigint").alias("n"),
        first.bitwiseAND(mask).alias("low1"), F.shiftrightunsigned(first, 32).alias("high1"),
        second.bitwiseAND(mask).alias("low2"), F.shiftrightunsigned(second, 32).alias("high2"),
    )
    # Modulo 2**32 at every level, so that no sum runs over.
    sums = [F.sum("n").alias("n"), *[F.sum(c).bitwiseAND(mask).alias(c) for c in _SUMS[1:]]]
    level = cut(rows.groupBy("node").agg(*sums), "leaves")
    nodes = level.withColumn("level", F.lit(levels))
    for at in range(levels - 1, -1, -1):
        level = level.groupBy(F.shiftright("node", FANOUT_BITS).alias("node")).agg(*sums)
        nodes = nodes.unionByName(level.withColumn("level", F.lit(at)))
    return HashTree(key_names, cell_names, levels, cut(nodes, "tree"))


def differing_leaves(old: HashTree, new: HashTree) -> DataFrame:
    """`node`: the leaves whose rows differ, found from the root down."""
    if (old.keys, old.cells, old.levels) != (new.keys, new.cells, new.levels):
        raise StrataError("the two trees were not made alike")
    parents: DataFrame | None = None
    for at in range(old.levels + 1):
        sides = []
        for tree in (old, new):
            level = tree.nodes.where(F.col("level") == at).drop("level")
            if parents is not None:
                level = level.join(parents, F.shiftright("node", FANOUT_BITS) == F.col("parent"), "left_semi")
            sides.append(level)
        theirs = sides[1].select(F.col("node").alias("_node"), *[F.col(c).alias(f"_{c}") for c in _SUMS])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _SUMS])
        both = sides[0].join(theirs, F.col("node") == F.col("_node"), "full").where(~same)
        parents = cut(both.select(F.coalesce("node", "_node").alias("parent")), "differing")
    return parents.withColumnRenamed("parent", "node")


def in_leaves(df: DataFrame, keys: tuple[str, ...], levels: int, leaves: DataFrame, most_sent: int = MOST_SENT) -> DataFrame:
    """The rows of a state that lie in the given leaves; the others stop at the scan while the leaves are few."""
    marked = df.withColumn("_leaf", _leaf(df, keys, levels))
    listed = leaves.select(F.col("node").alias("_node"))
    few = listed.limit(most_sent + 1).count() <= most_sent
    return marked.join(F.broadcast(listed) if few else listed, F.col("_leaf") == F.col("_node"), "left_semi").drop("_leaf")


def state_diff(
    baseline: DataFrame, edited: DataFrame, keys: list[str], old: HashTree | None = None, new: HashTree | None = None, most_sent: int = MOST_SENT,
) -> DataFrame:
    """Keys, change (updated, inserted, deleted), column, old_value, new_value of the cells that differ, as texts.

    The rows of a state must differ in their keys; null keys count as a value. An inserted or deleted row gives one row per cell. Trees
    of the states may be given; they must be made with the same keys, cells and levels.
    """
    cells = shared_cells(baseline, edited, keys)
    if not cells:
        raise StrataError("the two states share no column but the keys")
    if old is None or new is None:
        levels = (old or new).levels if old or new else levels_for(baseline.count())
        old, new = (t or hash_tree(df, keys, list(cells), levels) for t, df in ((old, baseline), (new, edited)))
    leaves = differing_leaves(old, new)

    def side(df: DataFrame, mark: str) -> DataFrame:
        held = in_leaves(df, tuple(keys), old.levels, leaves, most_sent)
        texts = [t.alias(c) for t, c in zip(_texts(held, cells), cells, strict=True)]
        return held.select(*[F.col(f"`{k}`").alias(f"{mark}{i}") for i, k in enumerate(keys)], F.struct(*texts).alias(mark))

    on = reduce(lambda a, b: a & b, [F.col(f"_old{i}").eqNullSafe(F.col(f"_new{i}")) for i in range(len(keys))])
    joined = side(baseline, "_old").join(side(edited, "_new"), on, "full")
    pair = [F.struct(F.lit(c).alias("column"), F.col("_old")[c].alias("old_value"), F.col("_new")[c].alias("new_value")) for c in cells]
    whole = F.col("_old").isNull() | F.col("_new").isNull()
    differ = F.filter(F.array(*pair), lambda p: whole | ~p["old_value"].eqNullSafe(p["new_value"]))
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").otherwise("updated")
    # A null key of a row that is there and the key of a row that is not both read null: the row's side tells them apart.
    named = [F.when(F.col("_old").isNull(), F.col(f"_new{i}")).otherwise(F.col(f"_old{i}")).alias(k) for i, k in enumerate(keys)]
    return joined.select(*named, change.alias("change"), F.explode(differ).alias("_c")).select(*keys, "change", "_c.*")
