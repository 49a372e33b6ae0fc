"""Comparison methods: a shallow entropy tree, and beam search for subgroups."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import ColumnValue, Condition, Conjunction, Numerical
from ..functions.scoring import VIOLATING, purity_value, totals
from .candidates import typed
from .conjunctions import numbers_of, row_sets
from .pairs import explicit
from .quantiles import quantiles_of
from .splits import entropy, gains_of


def one_hot(rows: DataFrame, categorical: list[str], numerical: list[str], values: dict[str, list]) -> DataFrame:
    """Numbers with null as 0, and an indicator per categorical value, null included."""
    out = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in numerical]
    out += [F.col(c).cast("string").eqNullSafe(F.lit(None if v is None else str(v))).cast("int").alias(f"{c}={v}") for c in categorical for v in values[c]]
    return rows.select(*out, VIOLATING)


def value_gains(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, gain, n_in, v_in, n_all, v_all) of splitting off one value of a categorical column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    long = rows.select(F.explode(pairs).alias("p"), VIOLATING).select("p.column", "p.value", VIOLATING)
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_in"), F.count(F.when(F.col(VIOLATING), 1)).alias("v_in"))
    x = counts.join(F.broadcast(totals(rows))).withColumn("n_all", F.col("n_sat") + F.col("n_vio")).withColumn("v_all", F.col("n_vio"))
    out, v_out = F.col("n_all") - F.col("n_in"), F.col("v_all") - F.col("v_in")
    gain = entropy(F.col("v_all") / F.col("n_all")) - F.col("n_in") / F.col("n_all") * entropy(F.col("v_in") / F.col("n_in")) - F.when(out > 0, out / F.col("n_all") * entropy(v_out / out)).otherwise(0.0)
    return x.select("column", "value", gain.alias("gain"), "n_in", "v_in", "n_all", "v_all")


def cells(categorical: list[str], numerical: list[str], suffix: str = "", fill: float | None = 0.0, itself: bool = True) -> Column:
    """(column, text, number) of all features of a row, NaN as missing, null numbers as `fill`; one more without a column counts the row itself."""
    none, nothing = F.lit(None).cast("double"), F.lit(None).cast("string")
    number = lambda c: F.nanvl(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fill).cast("double")), none)
    out = [F.struct(F.lit("").alias("column"), nothing.alias("text"), none.alias("number"))] if itself else []
    out += [F.struct(F.lit(c + suffix).alias("column"), F.col(f"`{c}`").cast("string").alias("text"), none.alias("number")) for c in categorical]
    out += [F.struct(F.lit(c + suffix).alias("column"), nothing.alias("text"), number(c).alias("number")) for c in numerical]
    return F.array(*out)


def best_splits_of(counted: DataFrame, numerical: list[str], min_leaf: int) -> DataFrame:
    """Per node its rows (n_all, v_all) and its best split (column, text or cut; no column: none), from (node, column, text, number, n, v).

    The best split of a numeric column counts only if both sides hold min_leaf rows; of a categorical column all values do so that leave as many on both sides.
    """
    whole = counted.where("column = ''").select("node", F.col("n").alias("all_n"), F.col("v").alias("all_v"))
    key = F.concat_ws(":", F.col("node").cast("string"), F.col("column"))
    worst = -F.round("gain", 10)
    numbers = counted.where(F.col("column").isin(numerical) & F.col("number").isNotNull())
    gains = gains_of(numbers.select(key.alias("column"), F.col("number").alias("value"), "n", "v"))
    # the least of structs is the best split: it combines before the shuffle
    first = gains.groupBy("column").agg(F.min(F.struct(worst.alias("w"), "split_value", "n_left", "n_all")).alias("m")).select("column", "m.*")
    fits = (F.col("n_left") >= min_leaf) & (F.col("n_all") - F.col("n_left") >= min_leaf)
    parts = F.split("column", ":", 2)
    numeric = first.where(fits).select(parts[0].cast("int").alias("node"), F.struct("w", parts[1].alias("column"), F.lit(None).cast("string").alias("text"), F.col("split_value").alias("cut")).alias("s"))
    values = counted.where((F.col("column") != "") & ~F.col("column").isin(numerical)).join(F.broadcast(whole), "node")
    n, v, all_n, all_v = F.col("n"), F.col("v"), F.col("all_n"), F.col("all_v")
    out = all_n - n
    gain = entropy(all_v / all_n) - n / all_n * entropy(v / n) - F.when(out > 0, out / all_n * entropy((all_v - v) / out)).otherwise(0.0)
    sized = values.where((n >= min_leaf) & (out >= min_leaf)).withColumn("gain", gain).where("gain > 1e-12")
    some = sized.select("node", F.struct(worst.alias("w"), "column", "text", F.lit(None).cast("double").alias("cut")).alias("s"))
    top = numeric.unionByName(some).groupBy("node").agg(F.min("s").alias("s")).select("node", "s.column", "s.text", "s.cut")
    return whole.join(top, "node", "left")


def grow(level: Callable[[list[frozenset]], list], schema: T.StructType, numerical: list[str], depth: int, min_leaf: int, min_support: int) -> list[dict]:
    """Paths to leaves with more satisfying than violating rows, scored and best first. level: best_splits_of of nodes, given by their paths, collected: at most 2^depth rows."""
    out, nodes, total = [], [frozenset()], None
    while nodes:
        met = {r["node"]: r for r in level(nodes)}
        total = total or (met[0]["all_n"] - met[0]["all_v"], met[0]["all_v"]) if met else (0, 0)
        deeper = []
        for i, path in enumerate(nodes):
            r = met.get(i)
            if r is None:
                continue
            sat, vio = r["all_n"] - r["all_v"], r["all_v"]
            if len(path) < depth and sat and vio and sat + vio >= 2 * min_leaf and r["column"] is not None:
                c = r["column"]
                if c in numerical:
                    deeper += [path | {Numerical(c, op, r["cut"])} for op in ("<", ">=")]
                else:
                    value = typed(r["text"], schema[c].dataType.simpleString())
                    deeper += [path | {ColumnValue(c, op, value)} for op in ("=", "!=")]
            elif path and sat > vio:
                c, p = sat / max(1, total[0]), vio / max(1, total[1])
                condition = next(iter(path)) if len(path) == 1 else Conjunction(path)
                out.append({"condition": condition, "confidence": c, "penalty": p, "sat_matches": sat, "vio_matches": vio, "score": purity_value(c, p, sat, min_support)})
        nodes = deeper
    return sorted(out, key=lambda r: (-round(r["score"], 10), -r["confidence"], str(r["condition"])))


def all_of(conditions: Iterable[Condition], schema: T.StructType) -> Column:
    out = F.lit(True)
    for c in sorted(conditions, key=str):
        out = out & c.to_column(schema)
    return out


def node_counts(rows: DataFrame, nodes: list[frozenset], categorical: list[str], numerical: list[str]) -> DataFrame:
    """(node, column, text, number, n, v): rows, and violating ones, by node and feature. Nodes, which exclude each other, are given by their paths.

    A row's node is found once, before its features are apart; values are counted together first, so only numbers are apart for every row.
    """
    sums = [F.sum("n").alias("n"), F.sum("v").alias("v")]
    keys = ["node", "x.column", "x.text", "x.number"]
    node = F.coalesce(*[F.when(all_of(p, rows.schema), F.lit(i)) for i, p in enumerate(nodes)], F.lit(None).cast("int"))
    names = [F.col(f"`{c}`") for c in dict.fromkeys([*categorical, *numerical])]
    placed = rows.select(node.alias("__node"), *names, VIOLATING).where("__node IS NOT NULL")
    counts = [F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(VIOLATING), 1)).alias("v")]
    numbers = placed.select(F.col("__node").alias("node"), cells([], numerical, itself=False).alias("xs"), VIOLATING).select("node", F.explode("xs").alias("x"), VIOLATING).groupBy(*keys).agg(*counts) if numerical else None
    values = placed.groupBy("__node", *[F.col(f"`{c}`") for c in dict.fromkeys(categorical)]).agg(*counts)
    values = values.select(F.col("__node").alias("node"), cells(categorical, []).alias("xs"), "n", "v").select("node", F.explode("xs").alias("x"), "n", "v").groupBy(*keys).agg(*sums)
    return values if numbers is None else values.unionByName(numbers)


def tree_rules(rows: DataFrame, categorical: list[str], numerical: list[str], depth: int = 3, min_leaf: int = 5, min_support: int = 5) -> list[dict]:
    """The leaves of an entropy tree. A level is one aggregation over all rows, with the node as part of the key."""
    rows = rows.select(VIOLATING, *[F.col(f"`{c}`") for c in dict.fromkeys([*categorical, *numerical])]).persist(StorageLevel.MEMORY_AND_DISK)

    def level(nodes: list[frozenset]) -> list:
        counted = node_counts(rows, nodes, categorical, numerical).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # before the broadcasts that read it, whose time is limited
            counted.count()
            return best_splits_of(counted, numerical, min_leaf).collect()
        finally:
            counted.unpersist()

    try:
        return grow(level, rows.schema, numerical, depth, min_leaf, min_support)
    finally:
        rows.unpersist()


def search_space(rows: DataFrame, max_cardinality: int = 50, bins: int = 5) -> list[Condition]:
    """Selectors: values of non-numeric columns of up to max_cardinality values, and intervals of numeric ones."""
    names = [f for f in rows.schema if f.name != VIOLATING]
    numbers = [f.name for f in names if isinstance(f.dataType, T.NumericType)]
    others = [f.name for f in names if f.name not in numbers]
    features = rows.select(F.explode(cells(others, numbers, fill=None, itself=False)).alias("x"))
    counted = features.groupBy("x.column", "x.text", "x.number").agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return selectors_of(counted, {f.name: f.dataType.simpleString() for f in names}, numbers, max_cardinality, bins)
    finally:
        counted.unpersist()


def selectors_of(counted: DataFrame, kinds: dict[str, str], numbers: list[str], max_cardinality: int, bins: int) -> list[Condition]:
    """The same from (column, text, number, n)."""
    out: list[Condition] = []
    texts = counted.where(~F.col("column").isin(numbers) & F.col("text").isNotNull())
    small = texts.groupBy("column").agg(F.countDistinct("text").alias("d")).where(F.col("d") <= max_cardinality).select("column")
    # at most max_cardinality values a column
    for r in texts.join(F.broadcast(small), "column").select("column", "text").distinct().orderBy("column", "text").collect():
        out.append(ColumnValue(r[0], "=", typed(r[1], kinds[r[0]])))
    valued = counted.where(F.col("column").isin(numbers) & F.col("number").isNotNull()).select("column", F.col("number").alias("value"), "n")
    cuts = {r[0]: r[1] for r in quantiles_of(valued, [i / bins for i in range(1, bins)]).collect()} if numbers else {}
    for c in numbers:
        edges = sorted(set(cuts.get(c) or []))
        for low, high in zip([None, *edges], [*edges, None], strict=True):
            parts = [Numerical(c, ">=", low)] * (low is not None) + [Numerical(c, "<", high)] * (high is not None)
            out += [parts[0] if len(parts) == 1 else Conjunction(frozenset(parts))] if parts else []
    return out


def pair_rows(samples: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of rows as rows (columns named c_1 and c_2, flagged): between groups; satisfying samples without such pairs give all theirs."""
    sides = lambda p: p.select(*[F.col(f"{s}.{c}").alias(f"{c}_{i}") for c in columns for i, s in ((1, "a"), (2, "b"))], F.col(f"a.{VIOLATING}").alias(VIOLATING))
    between = explicit(samples, "between_groups")
    sat = samples.where(~F.col(VIOLATING))
    if between.where(~F.col(f"a.{VIOLATING}")).isEmpty():
        between = between.unionByName(explicit(sat, "all_combinations"))
    return sides(between)


def row_condition(condition: Condition) -> Condition:
    """A condition over columns of pairs as one over rows: the suffix goes, parts that become equal are one."""
    if isinstance(condition, Conjunction):
        parts = frozenset(map(row_condition, condition.conditions))
        return next(iter(parts)) if len(parts) == 1 else Conjunction(parts)
    return replace(condition, column=re.sub(r"_[12]$", "", condition.column))


def wracc(counts: DataFrame) -> DataFrame:
    """Adds wracc, the weighted relative accuracy for satisfying rows, to counts with totals."""
    n, p = F.col("n_sat") + F.col("n_vio"), F.col("n_sat") / (F.col("n_sat") + F.col("n_vio"))
    own = F.col("sat_matches") + F.col("vio_matches")
    return counts.withColumn("wracc", F.when(own > 0, own / n * (F.col("sat_matches") / own - p)).otherwise(F.lit(0.0)))


def beam_search(selectors: list[Condition], level: Callable[[list[frozenset]], list], n_sat: int, n_vio: int, depth: int, width: int, results: int, min_support: int) -> list[dict]:
    """Beam search for subgroups of large weighted relative accuracy. A description is a set of numbers of selectors on different columns.

    level: of each given description and selector (parent, selector, sat, vio) the rows that meet both: at most width * |selectors| collected.
    """
    n, share = n_sat + n_vio, n_sat / (n_sat + n_vio) if n_sat + n_vio else 0.0
    columns = [s.columns() for s in selectors]
    parts = [s.conditions if isinstance(s, Conjunction) else frozenset([s]) for s in selectors]
    joined = lambda t: frozenset().union(*(parts[i] for i in t))
    texts = lambda t: sorted(map(str, joined(t)))
    beam: list[frozenset] = [frozenset()]
    best: dict[frozenset, dict] = {}
    for _ in range(depth):
        counts: dict[frozenset, tuple[int, int]] = {}
        tried = {b | {i} for b in beam for i in range(len(selectors)) if not any(columns[i] & columns[j] for j in b)} - best.keys()
        if not tried:
            break
        for r in level(beam):
            t = beam[r["parent"]] | {r["selector"]}
            if t in tried:
                counts[t] = r["sat"], r["vio"]
        for t in tried:
            sat, vio = counts.get(t, (0, 0))
            own, c, p = sat + vio, sat / n_sat if n_sat else 0.0, vio / n_vio if n_vio else 0.0
            condition = next(iter(joined(t))) if len(joined(t)) == 1 else Conjunction(joined(t))
            accuracy = own / n * (sat / own - share) if own else 0.0
            best[t] = {"condition": condition, "sat_matches": sat, "vio_matches": vio, "confidence": c, "penalty": p, "score": purity_value(c, p, sat, min_support), "wracc": accuracy}
        beam = sorted(best, key=lambda t: (-round(best[t]["wracc"], 10), texts(t)))[:width]
    top = sorted(best.values(), key=lambda r: (-round(r["wracc"], 10), str(r["condition"])))[:results]
    return sorted(top, key=lambda r: (-round(r["score"], 10), -r["confidence"], str(r["condition"])))


def subgroup_beam(rows: DataFrame, depth: int = 3, width: int = 20, results: int = 20, max_cardinality: int = 50, min_support: int = 5) -> list[dict]:
    """Subgroups of single rows. Rows, which are kept for it, are grouped by the selectors they meet once; each level reads that table."""
    kept = rows.select(*[F.col(f"`{c}`") for c in rows.columns]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _subgroup_beam(kept, depth, width, results, max_cardinality, min_support)
    finally:
        kept.unpersist()


def _subgroup_beam(rows: DataFrame, depth: int, width: int, results: int, max_cardinality: int, min_support: int) -> list[dict]:
    selectors = search_space(rows, max_cardinality)
    total = totals(rows).first()
    if not selectors or not total["n_sat"] or not total["n_vio"]:
        return []
    met = row_sets(rows, selectors).signatures.select(numbers_of(range(len(selectors))).alias("hits"), "sat", "vio").persist(StorageLevel.MEMORY_AND_DISK)

    def level(beam: list[frozenset]) -> list:
        listed = F.array(*[F.struct(F.lit(i).alias("parent"), F.array(*map(F.lit, sorted(b))).cast("array<int>").alias("ids")) for i, b in enumerate(beam)])
        whole = F.filter(listed, lambda b: F.forall(b["ids"], lambda i: F.array_contains("hits", i)))
        both = met.select("sat", "vio", "hits", F.explode(whole).alias("b")).select("sat", "vio", "b.parent", F.explode("hits").alias("selector"))
        return both.groupBy("parent", "selector").agg(F.sum("sat").alias("sat"), F.sum("vio").alias("vio")).collect()

    try:
        return beam_search(selectors, level, total["n_sat"], total["n_vio"], depth, width, results, min_support)
    finally:
        met.unpersist()
