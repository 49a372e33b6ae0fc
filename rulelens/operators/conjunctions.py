"""Counting conjunctions of two and three conditions from the data, not from the list of candidates.

A row's signature is the set of conditions it meets, as bits in an array of longs. Rows are grouped by signature once; whatever
their number, what is left is as long as there are different signatures. Sets are then found level by level: pairs of
conditions on distinct columns that occur in a signature, those with the support, and triples that extend such a pair by a later condition, which
drops nothing but zero scores. Nothing comes to the driver.

Pairs of rows of a sample meet a set of conditions together if the common part of their signatures contains it. So the pairs of
a sample are counted by common signature, from its different signatures and their sizes:

    between = T - U,  all = (T - U) / 2,  within = (U - N) / 2,

where T counts ordered pairs of rows of a sample, U those of one unit (role, or row_id for all) and N rows. A sample of more
than DENSE different signatures is counted by set instead, as the square of the rows that meet it.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import Condition
from ..functions.scoring import VIOLATING, totals, with_metrics

#: Conditions per long; different signatures of a sample up to which its pairs of signatures are formed.
WORD = 62
#: Conditions whose bits are one expression.
OCTET = 8
DENSE = 128


def signature(schema: T.StructType, pool: list[Condition]) -> Column:
    """The conditions that a row meets, as bits."""
    bits = [F.when(c.to_column(schema), F.lit(1 << i % WORD).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(pool)]
    # an array is compiled in parts, of OCTET conditions each; one expression over all of them would be too long for the compiler
    none = F.lit(0).cast("long")
    parts = lambda own: [reduce(Column.bitwiseOR, own[i : i + OCTET]) for i in range(0, len(own), OCTET)] or [none]
    return F.array(*[F.aggregate(F.array(*parts(bits[i : i + WORD])), none, lambda a, x: a.bitwiseOR(x)) for i in range(0, max(1, len(bits)), WORD)])


def numbers_of(chosen: Iterable[int]) -> Column:
    """The ascending numbers of the chosen conditions whose bits are set in `sig`."""
    return F.expr(f"filter(array({', '.join(map(str, chosen))}), i -> (shiftright(sig[cast(i div {WORD} as int)], i % {WORD}) & 1L) = 1L)")


def _common(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


@dataclass
class Sets:
    """Weighted signatures (sig, sat, vio) of a pool, with the samples that are counted by set: rows (keys..., sig, n), their keys, and a sign."""

    pool: list[Condition]
    signatures: DataFrame
    dense: list[tuple[DataFrame, list[str], int]] = field(default_factory=list)
    divisor: int = 1

    def counts(self, min_support: int, chosen: list[int] | None = None, size: int = 3) -> DataFrame:
        """(ids, sat_matches, vio_matches) of sets of two up to size of the chosen conditions on distinct columns; triples only where the first two have the support."""
        chosen = sorted(range(len(self.pool)) if chosen is None else chosen)
        names = sorted({next(iter(c.columns())) for c in self.pool})
        of = F.array(*[F.lit(names.index(next(iter(c.columns())))) for c in self.pool])
        apart = lambda x, y: F.get(of, x) != F.get(of, F.col(y))
        hits = numbers_of(chosen).alias("hits")
        found = self.signatures.select(hits, "sat", "vio").groupBy("hits").agg(F.sum("sat").alias("sat"), F.sum("vio").alias("vio")).where(F.size("hits") > 1)
        squares = [(rows.select(*keys, hits, "n").where(F.size("hits") > 1), keys, sign) for rows, keys, sign in self.dense]

        def seconds(rows: DataFrame, *kept: str) -> DataFrame:
            one = rows.select(*kept, "hits", F.explode("hits").alias("a"))
            return one.select(*kept, "hits", "a", F.explode(F.filter("hits", lambda x: (x > F.col("a")) & apart(x, "a"))).alias("b"))

        def thirds(rows: DataFrame, *kept: str) -> DataFrame:
            two = seconds(rows, *kept).join(F.broadcast(frequent), ["a", "b"], "left_semi")
            return two.select(*kept, "a", "b", F.explode(F.filter("hits", lambda x: (x > F.col("b")) & apart(x, "a") & apart(x, "b"))).alias("c"))

        def level(extend, ids: list[str]) -> DataFrame:
            out = extend(found, "sat", "vio").groupBy(*ids).agg(F.sum("sat").alias("sat"), F.sum("vio").alias("vio"))
            for rows, keys, sign in squares:
                of_key = extend(rows, *keys, "n").groupBy(*keys, *ids).agg(F.sum("n").alias("n"))
                out = out.unionByName(of_key.groupBy(*ids).agg(F.lit(0).cast("long").alias("sat"), F.sum(F.lit(sign) * F.col("n") * F.col("n")).alias("vio")))
            if squares:
                out = out.groupBy(*ids).agg(F.sum("sat").alias("sat"), F.sum("vio").alias("vio"))
            return out

        two = level(seconds, ["a", "b"])
        named = lambda rows, ids: rows.select(F.array(*ids).alias("ids"), F.col("sat").alias("sat_matches"), F.expr(f"vio div {self.divisor}").alias("vio_matches"))
        out = named(two, ["a", "b"])
        if size >= 3:
            # at most |pool|^2 / 2 pairs, whatever the rows
            frequent = two.where(F.col("sat") >= min_support).select("a", "b")
            out = out.union(named(level(thirds, ["a", "b", "c"]), ["a", "b", "c"]))
        return out


def row_sets(rows: DataFrame, pool: list[Condition]) -> Sets:
    """Satisfying and violating rows by signature."""
    sat, vio = F.count(F.when(~F.col(VIOLATING), 1)).alias("sat"), F.count(F.when(F.col(VIOLATING), 1)).alias("vio")
    return Sets(pool, rows.select(signature(rows.schema, pool).alias("sig"), VIOLATING).groupBy("sig").agg(sat, vio))


def _meetings(rows: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """(sig, vio): ordered pairs of rows of one key by their common signature, from rows (keys..., sig, n) of different signatures."""
    groups = rows.groupBy(*keys).agg(F.collect_list(F.struct("sig", "n")).alias("s"))
    first = groups.select("s", F.posexplode("s").alias("i", "x"))
    both = first.select("x", F.posexplode(F.expr("slice(s, i + 1, size(s))")).alias("j", "y"))
    weight = F.lit(sign) * F.col("x.n") * F.col("y.n") * F.when(F.col("j") > 0, F.lit(2)).otherwise(F.lit(1))
    return both.select(_common(F.col("x.sig"), F.col("y.sig")).alias("sig"), weight.alias("vio"))


def sample_sets(sat: DataFrame, vio: DataFrame, pool: list[Condition], pattern: str | None, unit: str = "role", dense: int = DENSE) -> Sets:
    """Satisfying rows, and violating pairs of rows of a pattern (None: whole samples), by signature."""
    sig = signature(sat.schema, pool).alias("sig")
    of_sat = sat.select(sig).groupBy("sig").agg(F.count(F.lit(1)).alias("sat")).select("sig", "sat", F.lit(0).cast("long").alias("vio"))
    late: list[tuple[DataFrame, list[str], int]] = []
    if pattern is None:
        words = -(-max(1, len(pool)) // WORD)
        whole = vio.select("sample_id", sig).groupBy("sample_id").agg(F.array(*[F.bit_and(F.col("sig")[i]) for i in range(words)]).alias("sig"))
        of_vio = [whole.select("sig", F.lit(1).cast("long").alias("vio"))]
    else:
        per_unit = vio.select("sample_id", unit, sig).groupBy("sample_id", unit, "sig").agg(F.count(F.lit(1)).alias("n"))
        tables = [(per_unit, ["sample_id", unit], 1 if pattern == "within_groups" else -1)]
        if pattern == "within_groups":
            of_vio = [per_unit.select("sig", (-F.col("n")).alias("vio"))]
        else:
            of_vio = []
            tables.append((per_unit.groupBy("sample_id", "sig").agg(F.sum("n").alias("n")), ["sample_id"], 1))
        for rows, keys, sign in tables:
            # no more different signatures than rows
            most = vio.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
            if most > dense:
                sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__d")).where(F.col("__d") > dense).select(*keys)
                late.append((rows.join(sizes, keys, "left_semi"), keys, sign))
                rows = rows.join(sizes, keys, "left_anti")
            of_vio.append(_meetings(rows, keys, sign))
    both = reduce(DataFrame.unionByName, of_vio).groupBy("sig").agg(F.sum("vio").alias("vio")).select("sig", F.lit(0).cast("long").alias("sat"), "vio")
    return Sets(pool, of_sat.unionByName(both), late, 1 if pattern in (None, "between_groups") else 2)


def combinations(rows: DataFrame, pool: list[Condition], min_support: int, size: int = 3) -> DataFrame:
    """(ids, sat_matches, vio_matches, ...) of sets of two up to size conditions on distinct columns."""
    return with_metrics(row_sets(rows, pool).counts(min_support, size=size).join(F.broadcast(totals(rows))), min_support)
