"""Pairs of rows without the pairs: trees and subgroups over two rows of a sample, from counts of each side.

A description of pairs is a condition on the first row and one on the second. The pairs that meet it and also have a value on
the first row are the rows with the value that meet the first condition, each counted as often as it has partners that meet the
second; and the other way round. Partners of a row are counted per sample: those of the sample less those of its
own role (between groups), or those on the far side of its row_id (all combinations, whose first row has the smaller one). So every
count over pairs is a weighted count over rows, and the work grows with rows, not with pairs.

Columns of pairs are named as columns of rows, with _1 or _2. A sample's rows are all satisfying or all violating. Rows
without a sample, role or row_id belong to no pair.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import Condition, Conjunction
from ..functions.scoring import VIOLATING
from .baselines import all_of, beam_search, best_splits_of, cells, grow, row_condition, selectors_of
from .conjunctions import WORD, signature
from .pairs import total

KNOWN = "sample_id IS NOT NULL AND role IS NOT NULL AND row_id IS NOT NULL"
#: Rows of a sample that are cumulated in one go, where their order counts.
BLOCK = 1024


def _side(conditions: Iterable[Condition], side: int) -> list[Condition]:
    """The conditions on one row of a pair, as conditions on rows."""
    own = []
    for c in conditions:
        own += c.conditions if isinstance(c, Conjunction) else [c]
    return [row_condition(c) for c in own if c.column.endswith(f"_{side}")]


def _met(samples: DataFrame, nodes: list[frozenset], pattern: str) -> tuple[DataFrame, list[tuple[int, int, Column]]]:
    """samples with what each row and its partners meet, and (side, node, n): the pairs of a row as the first or the second one."""
    rows = samples.where(KNOWN)
    meets = [[all_of(_side(d, side), samples.schema).cast("long") for d in nodes] for side in (1, 2)]
    rows = rows.withColumns({"__1": F.array(*meets[0]), "__2": F.array(*meets[1])})
    names = [(side, i, f"__{side}_{i}") for side in (1, 2) for i in range(len(nodes))]
    if pattern == "between_groups":
        # sums over windows of the sample: rows that are partitioned by sample stay where they are
        every, own = Window.partitionBy("sample_id"), Window.partitionBy("sample_id", "role")
        others = lambda side: F.array(*[F.sum(F.col(f"__{side}")[i]).over(every) - F.sum(F.col(f"__{side}")[i]).over(own) for i in range(len(nodes))])
        met = rows.withColumns({f"__p{side}": others(side) for side in (1, 2)})
    else:
        tally = rows.groupBy("sample_id", "row_id").agg(*[F.sum(F.col(f"__{side}")[i]).alias(name) for side, i, name in names])
        behind = _beyond(tally, names, samples.schema["row_id"].dataType)
        met = rows.join(behind.select("sample_id", "row_id", *[F.array(*[F.col(name) for s, _, name in names if s == side]).alias(f"__p{side}") for side in (1, 2)]), ["sample_id", "row_id"])
    # the first row's partners are second rows, and the other way round
    return met, [(side, i, F.col(f"__{side}")[i] * F.col(f"__p{3 - side}")[i]) for side, i, _ in names]


def partners(samples: DataFrame, nodes: list[frozenset], pattern: str) -> DataFrame:
    """samples with `weights`: (node, side, n) for each description that a row meets as the first or the second of n > 0 pairs."""
    met, products = _met(samples, nodes, pattern)
    weights = [F.struct(F.lit(i).alias("node"), F.lit(side).alias("side"), n.alias("n")) for side, i, n in products]
    return met.withColumn("weights", F.filter(F.array(*weights), lambda w: w["n"] > 0)).drop("__1", "__2", "__p1", "__p2")


def _beyond(tally: DataFrame, names: list[tuple[int, int, str]], kind: T.DataType) -> DataFrame:
    """Second rows behind each row_id of a sample, and first rows before it; whole numbers are cumulated by blocks first, so a large sample isn't one task."""
    block = F.floor(F.col("row_id") / BLOCK) if isinstance(kind, T.IntegralType) else F.lit(0)
    tally = tally.withColumn("__block", block.cast("long"))
    inside, outside = Window.partitionBy("sample_id", "__block").orderBy("row_id"), Window.partitionBy("sample_id").orderBy("__block")
    before, behind = (Window.unboundedPreceding, -1), (1, Window.unboundedFollowing)
    rest = lambda w, name, side: F.coalesce(F.sum(name).over(w.rowsBetween(*(before if side == 1 else behind))), F.lit(0))
    blocks = tally.groupBy("sample_id", "__block").agg(*[F.sum(name).alias(name) for *_, name in names])
    blocks = blocks.select("sample_id", "__block", *[rest(outside, name, side).alias(f"{name}_b") for side, _, name in names])
    near = tally.select("sample_id", "row_id", "__block", *[rest(inside, name, side).alias(name) for side, _, name in names])
    return near.join(blocks, ["sample_id", "__block"]).select("sample_id", "row_id", *[(F.col(name) + F.col(f"{name}_b")).alias(name) for *_, name in names])


class Pairs:
    """Samples seen as pairs between groups; satisfying samples without such pairs give all theirs."""

    def __init__(self, samples: DataFrame, categorical: list[str], numerical: list[str]):
        self.categorical, self.numerical = categorical, numerical
        self.samples = samples.where(KNOWN).select("sample_id", "role", "row_id", VIOLATING, *dict.fromkeys([*categorical, *numerical])).persist(StorageLevel.MEMORY_AND_DISK)
        sat, vio = self.samples.where(~F.col(VIOLATING)), self.samples.where(VIOLATING)
        self.n_vio = total(vio, "between_groups").first()[0]
        self.n_sat = total(sat, "between_groups").first()[0]
        self.parts = [(self.samples, "between_groups")]
        if not self.n_sat:
            self.n_sat = total(sat, "all_combinations").first()[0]
            self.parts = [(vio, "between_groups"), (sat, "all_combinations")]
        fields = [self.samples.schema[c] for c in dict.fromkeys([*categorical, *numerical])]
        self.schema = T.StructType([T.StructField(f"{f.name}_{side}", f.dataType) for f in fields for side in (1, 2)])

    def weighted(self, nodes: list[frozenset]) -> DataFrame:
        """Rows, their flag, and (node, side, n) of each description, one a row."""
        out = None
        for rows, pattern in self.parts:
            part = partners(rows, nodes, pattern)
            part = part.select(VIOLATING, *self.categorical, *[c for c in self.numerical if c not in self.categorical], F.explode("weights").alias("w")).select("*", "w.*").drop("w")
            out = part if out is None else out.unionByName(part)
        return out

    def counted(self, nodes: list[frozenset], fill: float | None, categorical: list[str], numerical: list[str]) -> DataFrame:
        """(node, column, text, number, n, v): pairs, and violating ones, by description and feature; no column: the pairs of the description."""
        first, second = (cells(categorical, numerical, f"_{side}", fill, side == 1) for side in (1, 2))
        features = self.weighted(nodes).select("node", "n", VIOLATING, F.explode(F.when(F.col("side") == 1, first).otherwise(second)).alias("x"))
        return features.groupBy("node", "x.column", "x.text", "x.number").agg(F.sum("n").alias("n"), F.sum(F.when(F.col(VIOLATING), F.col("n")).otherwise(0)).alias("v"))

    def grouped(self, nodes: list[frozenset], keys: dict[str, Column]) -> DataFrame:
        """(flag, keys..., weights): (node, side, n) of each description, summed over rows with equal keys before anything is taken apart."""
        out = None
        for rows, pattern in self.parts:
            met, products = _met(rows, nodes, pattern)
            sums = [F.sum(n).alias(f"__w{side}_{i}") for side, i, n in products]
            part = met.withColumns(keys).groupBy(VIOLATING, *keys).agg(*sums)
            weights = [F.struct(F.lit(i).alias("node"), F.lit(side).alias("side"), F.col(f"__w{side}_{i}").alias("n")) for side, i, _ in products]
            part = part.select(VIOLATING, *keys, F.filter(F.array(*weights), lambda w: w["n"] > 0).alias("weights"))
            out = part if out is None else out.unionByName(part)
        return out

    def close(self) -> None:
        self.samples.unpersist()


def _both(names: list[str]) -> list[str]:
    return [f"{c}_{side}" for c in names for side in (1, 2)]


def pair_tree_rules(samples: DataFrame, categorical: list[str], numerical: list[str], depth: int = 3, min_leaf: int = 5, min_support: int = 5) -> list[dict]:
    """The leaves of an entropy tree over pairs, as conditions on rows."""
    pairs = Pairs(samples, categorical, numerical)

    def level(nodes: list[frozenset]) -> list:
        counted = pairs.counted(nodes, 0.0, categorical, numerical).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return best_splits_of(counted, _both(numerical), min_leaf).collect()
        finally:
            counted.unpersist()

    try:
        found = grow(level, pairs.schema, _both(numerical), depth, min_leaf, min_support)
    finally:
        pairs.close()
    return [r | {"condition": row_condition(r["condition"])} for r in found]


def pair_subgroups(samples: DataFrame, columns: list[str], depth: int = 3, width: int = 20, results: int = 20, max_cardinality: int = 50, min_support: int = 5, bins: int = 5) -> list[dict]:
    """Subgroups of pairs by beam search, as conditions on rows; a level is one pass over the rows."""
    numerical = [c for c in columns if isinstance(samples.schema[c].dataType, T.NumericType)]
    categorical = [c for c in columns if c not in numerical]
    pairs = Pairs(samples, categorical, numerical)
    try:
        if not pairs.n_sat or not pairs.n_vio:
            return []
        counted = pairs.counted([frozenset()], None, categorical, numerical).where("column <> ''").persist(StorageLevel.MEMORY_AND_DISK)
        selectors = selectors_of(counted, {f.name: f.dataType.simpleString() for f in pairs.schema}, _both(numerical), max_cardinality, bins)
        counted.unpersist()
        # what a row meets as the first and as the second one of a pair, as bits
        by_side = {side: [(i, Conjunction(frozenset(own))) for i, s in enumerate(selectors) if (own := _side([s], side))] for side in (1, 2)}
        bits = {side: signature(samples.schema, [c for _, c in own]) for side, own in by_side.items()}
        keys = {f"__s{side}_{w}": bits[side][w] for side, own in by_side.items() for w in range(-(-len(own) // WORD))}
        numbers: dict[int, Column] = {}
        for side, own in by_side.items():
            met = [F.when(F.shiftright(f"__s{side}_{k // WORD}", k % WORD).bitwiseAND(F.lit(1)) == 1, F.lit(i)) for k, (i, _) in enumerate(own)]
            numbers[side] = F.filter(F.array(*met), lambda x: x.isNotNull()) if met else F.array().cast("array<int>")

        def level(beam: list[frozenset]) -> list:
            rows = pairs.grouped([frozenset(selectors[i] for i in b) for b in beam], keys)
            apart = rows.select(VIOLATING, numbers[1].alias("first"), numbers[2].alias("second"), F.explode("weights").alias("w"))
            met = apart.select(F.col("w.node").alias("parent"), "w.n", VIOLATING, F.explode(F.when(F.col("w.side") == 1, F.col("first")).otherwise(F.col("second"))).alias("selector"))
            of = lambda flag: F.sum(F.when(F.col(VIOLATING) == flag, F.col("n")).otherwise(0))
            return met.groupBy("parent", "selector").agg(of(False).alias("sat"), of(True).alias("vio")).collect()

        found = beam_search(selectors, level, pairs.n_sat, pairs.n_vio, depth, width, results, min_support) if selectors else []
    finally:
        pairs.close()
    return [r | {"condition": row_condition(r["condition"])} for r in found]


def value_meetings(samples: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Pairs between groups by the values of both rows: (flag, keys_1, keys_2, n, sums_1, sums_2).

    Rows of a sample and role with equal keys are counted before they meet, so a sample gives as many rows as its values have combinations.
    """
    tally = samples.where(KNOWN).groupBy("sample_id", "role", VIOLATING, *keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    a, b = (tally.select("sample_id", *[F.col(c).alias(f"{c}_{side}") for c in ("role", VIOLATING, *keys, "n", *sums)]) for side in (1, 2))
    met = a.join(b, "sample_id").where("role_1 <> role_2")
    firsts = [F.sum(F.col(f"{c}_1") * F.col("n_2")).cast("double").alias(f"{c}_1") for c in sums]
    seconds = [F.sum(F.col(f"{c}_2") * F.col("n_1")).cast("double").alias(f"{c}_2") for c in sums]
    named = [F.col(f"{c}_{side}") for c in keys for side in (1, 2)]
    return met.groupBy(F.col(f"{VIOLATING}_1").alias(VIOLATING), *named).agg(F.sum(F.col("n_1") * F.col("n_2")).alias("n"), *firsts, *seconds)
