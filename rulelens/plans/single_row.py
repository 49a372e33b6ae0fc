"""Mining conditions for rules on single rows: one aggregation per stage for any number of rules, candidates in between."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.conditions import ColumnValue, Condition, Conjunction
from ..functions.scoring import MERGE_WEIGHT, VIOLATING, informedness, purity_value, with_metrics
from ..operators import candidates as G
from ..operators.conjunctions import Sets, signature
from ..operators.domains import Domains, best, long_values, scored
from ..operators.ranking import ranked
from ..operators.splits import best_of, gains_of

# Support and score limits of the stages.
MIN_SUPPORT = 5
OUT_ATOM, OUT_NUMERIC, MERGE, OUT_MERGED, PARENT, OUT_CONJUNCTION = 0.53, 0.5, 0.5, 0.5, 0.4, 0.5
PER_COLUMN = 10


def _result(condition, sat: int, vio: int, n_sat: int, n_vio: int, min_support: int) -> dict:
    c, p = sat / n_sat if n_sat else 0.0, vio / n_vio if n_vio else 0.0
    return {"condition": condition, "sat_matches": sat, "vio_matches": vio, "confidence": c, "penalty": p, "score": purity_value(c, p, sat, min_support)}


def suggest(rows: DataFrame, categorical: list[str], numerical: list[str], domains: dict[str, Iterable] | None = None, special: dict[str, Iterable] | None = None, groups: list[list[str]] | None = None, min_support: int = MIN_SUPPORT, conjunctions: bool = True) -> list[dict]:
    """Ranked conditions that tell satisfying from violating rows; [] without rows of both kinds."""
    return suggest_many(rows, {"": VIOLATING}, categorical, numerical, domains, special, groups, min_support, conjunctions)[""]


def suggest_many(rows: DataFrame, flags: dict[str, str], categorical: list[str], numerical: list[str], domains: dict[str, Iterable] | None = None, special: dict[str, Iterable] | None = None, groups: list[list[str]] | None = None, min_support: int = MIN_SUPPORT, conjunctions: bool = True) -> dict[str, list[dict]]:
    """`suggest` for many rules over one table: flags name the column that says of each row whether it violates the rule (null: the rule has nothing to do with it).

    The rows are read as often as for one rule: values, numbers and signatures are counted for all rules at once, and what is done rule by
    rule reads those counts. The needed columns are kept (in memory, else on disk) while the stages read them; a lost part is made again.
    """
    categorical, numerical = ([c for c in dict.fromkeys(cs) if c in rows.columns] for cs in (categorical, numerical))
    features = [F.col(f"`{c}`") for c in dict.fromkeys([*categorical, *numerical])]
    kept = rows.select(*[F.col(f"`{c}`").alias(f"__flag{i}") for i, c in enumerate(flags.values())], *features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        found = _suggest_many(kept, len(flags), categorical, numerical, domains, special, groups or [], min_support, conjunctions)
    finally:
        kept.unpersist()
    return dict(zip(flags, found, strict=True))


def _sides(rules: int) -> list:
    """Counts of satisfying and violating rows of each rule."""
    return [F.count(F.when(F.col(f"__flag{i}") == bad, 1)).alias(f"{side}{i}") for i in range(rules) for side, bad in (("sat", False), ("vio", True))]


def _of_rule(counted: DataFrame, i: int, *keys: str) -> DataFrame:
    """Counts of one rule where it has rows."""
    return counted.where(F.col(f"sat{i}") + F.col(f"vio{i}") > 0).select(*keys, F.col(f"sat{i}").alias("sat"), F.col(f"vio{i}").alias("vio"))


def _suggest_many(rows: DataFrame, rules: int, categorical: list[str], numerical: list[str], domains, special, groups: list[list[str]], min_support: int, conjunctions: bool) -> list[list[dict]]:
    whole = rows.agg(*_sides(rules)).first()
    sizes_of = [(whole[f"sat{i}"], whole[f"vio{i}"]) for i in range(rules)]
    live = [i for i, (n_sat, n_vio) in enumerate(sizes_of) if n_sat and n_vio]
    out: list[list[dict]] = [[] for _ in range(rules)]
    if not live:
        return out
    flags = [f"__flag{i}" for i in range(rules)]
    result = lambda i, c, s, v: _result(c, s, v, *sizes_of[i], min_support)
    # every value of every categorical column, counted once; sets and complements are sums of these
    atoms: dict[int, list[dict]] = {i: [] for i in live}
    merged: dict[int, list[dict]] = {i: [] for i in live}
    if categorical:
        counted = long_values(rows, categorical, *flags).groupBy("column", "value").agg(*_sides(rules)).persist(StorageLevel.MEMORY_AND_DISK)
        for i in live:
            atoms[i], merged[i] = _values(_of_rule(counted, i, "column", "value"), rows, categorical, domains, special, *sizes_of[i], min_support)
        counted.unpersist()
    numbers: dict[int, list[dict]] = {i: [] for i in live}
    if numerical:
        for i, split in _splits(rows, numerical, live, rules):
            # the counts of a split are those of its two conditions
            sides = {"<": (split["n_left"] - split["v_left"], split["v_left"]), ">=": (split["n_all"] - split["v_all"] - split["n_left"] + split["v_left"], split["v_all"] - split["v_left"])}
            numbers[i] += [result(i, c, *sides[c.op]) for c in G.numeric([(split["column"], split["split_value"])])]
    for i in live:
        out[i] = [r for r in atoms[i] if r["score"] > OUT_ATOM] + [r for r in numbers[i] if r["score"] > OUT_NUMERIC] + merged[i]
    if conjunctions:
        pools = {i: legal_pools([r for r in [*atoms[i], *numbers[i], *merged[i]] if r["score"] > PARENT], groups) for i in live}
        every = sorted({c for ps in pools.values() for pool in ps for c in pool}, key=str)
        if every:
            table = _signatures(rows, every, rules).persist(StorageLevel.MEMORY_AND_DISK)
            for i in live:
                out[i] += conjoined(pools[i], Sets(every, _of_rule(table, i, "sig")), *sizes_of[i], min_support, OUT_CONJUNCTION)
            table.unpersist()
    return [ranked(x) for x in out]


def _values(counted: DataFrame, rows: DataFrame, categorical: list[str], domains, special, n_sat: int, n_vio: int, min_support: int) -> tuple[list[dict], list[dict]]:
    """Conditions on values, and on sets of the best of them, from (column, value, sat, vio)."""
    domain = Domains(counted, rows.schema, categorical, domains, special)
    found = counted.select("column", "value", F.col("sat").alias("eq_sat"), F.col("vio").alias("eq_vio"), (F.lit(n_sat) - F.col("sat")).alias("ne_sat"), (F.lit(n_vio) - F.col("vio")).alias("ne_vio"))
    atoms, counts = [], {}
    for r in best(scored(domain.candidates(found), domain.sizes, n_sat, n_vio, min_support), PARENT, sum(domain.sizes.values())).collect():
        condition = ColumnValue(r["column"], r["op"], domain.value(r["column"], r["value"]))
        counts[condition.column, condition.value] = r["eq_sat"], r["eq_vio"]
        atoms.append(_result(condition, r["sat_matches"], r["vio_matches"], n_sat, n_vio, min_support))
    merged = []
    for m in G.merges([r for r in atoms if r["score"] > MERGE], domain.sizes, PER_COLUMN):
        s, v = (sum(counts[m.column, x][k] for x in m.values) for k in (0, 1))
        merged.append(_result(m, s, v, n_sat, n_vio, min_support) if m.op == "=" else _result(m, n_sat - s, n_vio - v, n_sat, n_vio, min_support))
    return atoms, [r for r in merged if r["score"] > OUT_MERGED]


def _splits(rows: DataFrame, numerical: list[str], live: list[int], rules: int) -> list[tuple[int, dict]]:
    """(rule, split with its counts), the best splits of each rule and column; numbers are counted once for all rules."""
    number = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("value")) for c in numerical])
    long = rows.select(F.explode(pairs).alias("p"), *[f"__flag{i}" for i in range(rules)]).where("p.value IS NOT NULL")
    counted = long.groupBy("p.column", "p.value").agg(*_sides(rules))
    per_rule = F.array(*[F.struct(F.lit(i).alias("i"), (F.col(f"sat{i}") + F.col(f"vio{i}")).alias("n"), F.col(f"vio{i}").alias("v")) for i in live])
    keyed = counted.select("column", "value", F.explode(per_rule).alias("r")).where("r.n > 0").select(F.concat_ws(":", F.col("r.i").cast("string"), "column").alias("column"), "value", "r.n", "r.v")
    found = []
    for r in best_of(gains_of(keyed)).collect():
        i, column = r["column"].split(":", 1)
        found.append((int(i), r.asDict() | {"column": column}))
    return sorted(found, key=lambda x: (x[0], x[1]["column"], x[1]["split_value"]))


def _signatures(rows: DataFrame, pool: list[Condition], rules: int) -> DataFrame:
    """(sig, sat0, vio0, ...): the rows of each rule by the conditions they meet."""
    return rows.select(signature(rows.schema, pool).alias("sig"), *[f"__flag{i}" for i in range(rules)]).groupBy("sig").agg(*_sides(rules))


def best_sets(found: DataFrame, pool: list, keep: int = 2) -> DataFrame:
    """Of sets (ids) of conditions over the same columns the best `keep`, as the redundancy filter ranks them; the rest never comes to the driver."""
    names = F.array(*[F.lit(",".join(sorted(c.columns()))) for c in pool])
    texts = F.array(*[F.lit(str(c)) for c in pool])
    own = lambda of: F.sort_array(F.transform("ids", lambda i: F.get(of, i.cast("int"))))
    rank = F.col("score") + F.lit(MERGE_WEIGHT) * informedness()
    order = Window.partitionBy("__columns").orderBy(F.desc(F.round(rank, 10)), F.desc(F.round("confidence", 10)), "__text")
    named = found.withColumns({"__columns": F.array_join(own(names), ","), "__text": F.array_join(own(texts), " AND ")})
    return named.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= keep).drop("__place", "__columns", "__text")


def legal_pools(parents: list[dict], groups: list[list[str]]) -> list[list[Condition]]:
    """Pools of parents within which conjunctions of several columns are legal."""
    return [pool for pool in G.pools(parents, groups) if len({next(iter(c.columns())) for c in pool}) > 1]


def conjoined(pools: list[list[Condition]], sets: Sets, n_sat: int, n_vio: int, min_support: int, least: float) -> list[dict]:
    """Conjunctions of two and three conditions of a pool, scored above `least`. sets: signatures over all pools, read once for each."""
    out, done = [], set()
    for pool in pools:
        own = set(pool)
        found = sets.counts(min_support, [i for i, c in enumerate(sets.pool) if c in own]).where(F.col("sat_matches") >= min_support)
        measured = with_metrics(found.withColumns({"n_sat": F.lit(n_sat), "n_vio": F.lit(n_vio)}), min_support)
        for r in best_sets(measured.where(F.col("score") > least), sets.pool).collect():
            condition = Conjunction(frozenset(sets.pool[i] for i in r["ids"]))
            if condition not in done:
                done.add(condition)
                out.append({k: r[k] for k in ("sat_matches", "vio_matches", "confidence", "penalty", "score")} | {"condition": condition})
    return out


def to_frame(spark, results: list[dict]) -> DataFrame:
    """Ranked results as a DataFrame: place, kind, expr, counts and metrics."""
    rows = [(i, type(r["condition"]).__name__, str(r["condition"]), ",".join(sorted(r["condition"].columns())), int(r["sat_matches"]), int(r["vio_matches"]), float(r["confidence"]), float(r["penalty"]), float(r["score"])) for i, r in enumerate(results, 1)]
    return spark.createDataFrame(rows, "place int, kind string, expr string, columns string, sat_matches long, vio_matches long, confidence double, penalty double, score double")
