"""Mining conditions for rules over several rows.

samples: sample_id, role, row_id, the violation flag and attributes. Confidence is the share of
satisfying rows that match (of satisfying pairs, for pairwise conditions); penalty is the share of violating
pairs (or whole groups) that match, from counts, without building pairs.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import ColumnValue, Condition, Conjunction, PairWise
from ..functions.scoring import VIOLATING, purity_value
from ..operators import candidates as G
from ..operators import pairs as P
from ..operators.atoms import value_counts
from ..operators.conjunctions import Sets, sample_sets
from ..operators.domains import Domains, best, scored
from ..operators.ranking import ranked
from ..operators.splits import best_splits
from .single_row import conjoined, legal_pools

# Support and score limits of the stages.
MIN_SUPPORT = 10
COLLECT, OUT, MERGE = 0.37, 0.53, 0.53
PER_COLUMN = 12
WHOLE = "whole_group"


def pattern_of(rule_type: str) -> str:
    """How violations of a rule type show in a sample."""
    name = rule_type.lower()
    if name == "sum amount to threshold comparison rules":
        return WHOLE
    return "within_groups" if name == "unique key constraint rules" else "between_groups"


class Evaluator:
    """Metrics of conditions over satisfying and violating samples of one pattern."""

    def __init__(self, samples: DataFrame, pattern: str, min_support: int = MIN_SUPPORT):
        self.pattern, self.min_support = pattern, min_support
        self.sat, self.vio = samples.where(~F.col(VIOLATING)), samples.where(F.col(VIOLATING))
        self.n_sat = self.sat.count()
        if pattern == WHOLE:
            self.n_vio = self.vio.agg(F.countDistinct("sample_id")).first()[0]
        else:
            self.n_vio = P.total(self.vio, pattern).first()[0]
            self.sat_pairs = P.total(self.sat, pattern).first()[0]

    def _result(self, condition: Condition, sat: int, vio: int, whole: int) -> dict:
        c, p = sat / whole if whole else 0.0, vio / self.n_vio if self.n_vio else 0.0
        return {"condition": condition, "sat_matches": sat, "vio_matches": vio, "confidence": c, "penalty": p, "score": purity_value(c, p, sat, self.min_support)}

    def penalties(self, conditions: list[Condition]) -> dict[int, int]:
        if not conditions:
            return {}
        if self.pattern == WHOLE:
            return {r[0]: r[1] for r in P.whole_groups(self.vio, conditions).collect()}
        return {r[0]: r[1] for r in P.matching(self.vio, conditions, self.pattern).collect()}

    def atoms(self, columns: list[str], domains, special) -> tuple[list[dict], dict[str, int]]:
        """= and != of the columns' values that a later stage can use, and the sizes of the domains."""
        both = value_counts(self.sat, columns).unionByName(value_counts(self.vio, columns)).groupBy("column", "value").agg(F.sum("sat").alias("sat"), F.sum("vio").alias("vio"))
        both = both.persist(StorageLevel.MEMORY_AND_DISK)
        domain = Domains(both, self.sat.schema, columns, domains, special)
        pattern = None if self.pattern == WHOLE else self.pattern
        penal = P.value_pairs(self.vio, columns, pattern, self.n_vio)
        same = F.col("b.column").eqNullSafe(F.col("p.column")) & F.col("b.value").eqNullSafe(F.col("p.value"))
        found = both.alias("b").join(penal.alias("p"), same, "left").select("b.column", "b.value", F.col("sat").alias("eq_sat"), "eq_vio", (F.lit(self.n_sat) - F.col("sat")).alias("ne_sat"), "ne_vio")
        out = []
        for r in best(scored(domain.candidates(found), domain.sizes, self.n_sat, self.n_vio, self.min_support), COLLECT, sum(domain.sizes.values())).collect():
            out.append(self._result(ColumnValue(r["column"], r["op"], domain.value(r["column"], r["value"])), r["sat_matches"], r["vio_matches"], self.n_sat))
        both.unpersist()
        return out, domain.sizes

    def sets(self, pool: list[Condition]) -> Sets:
        """Satisfying rows and violating pairs (or whole samples) by the conditions that they meet."""
        return sample_sets(self.sat, self.vio, pool, None if self.pattern == WHOLE else self.pattern, "row_id" if self.pattern == "all_combinations" else "role")

    def rows(self, conditions: list[Condition]) -> list[dict]:
        """Row-level conditions."""
        if not conditions:
            return []
        sat = {r[0]: r[1] for r in P.meeting(self.sat, conditions).collect()}
        vio = self.penalties(conditions)
        return [self._result(c, sat.get(i, 0), vio.get(i, 0), self.n_sat) for i, c in enumerate(conditions)]

    def pairwise(self, columns: list[str]) -> list[dict]:
        """Pairwise conditions; none for whole groups, where there are no pairs to compare."""
        if self.pattern == WHOLE or not columns:
            return []
        sat = {(r[0], r[1]): r[2] for r in P.pairwise(self.sat, columns, self.pattern).collect()}
        vio = {(r[0], r[1]): r[2] for r in P.pairwise(self.vio, columns, self.pattern).collect()}
        return [self._result(c, sat.get((c.column, c.op), 0), vio.get((c.column, c.op), 0), self.sat_pairs) for c in G.pairwise(columns)]


def evaluate(samples: DataFrame, condition: Condition, pattern: str, min_support: int = 1) -> dict:
    """Metrics of one condition, for looking into a particular case."""
    if isinstance(condition, Conjunction) and any(isinstance(c, PairWise) for c in condition.conditions):
        raise ValueError("pairwise conditions can't be conjoined")
    e = Evaluator(samples, pattern, min_support)
    return next(r for r in (e.pairwise([condition.column]) if isinstance(condition, PairWise) else e.rows([condition])) if r["condition"] == condition)


def suggest(samples: DataFrame, categorical: list[str], numerical: list[str], pattern: str, domains: dict[str, Iterable] | None = None, special: dict[str, Iterable] | None = None, identifiers: Iterable[str] = (), groups: list[list[str]] | None = None, min_support: int = MIN_SUPPORT) -> list[dict]:
    """Ranked conditions; identifiers get pairwise conditions only."""
    keys = ["sample_id", "role", "row_id", VIOLATING]
    used = [c for c in dict.fromkeys([*categorical, *numerical, *identifiers]) if c in samples.columns]
    samples = samples.select(*keys, *used).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _suggest(samples, used, categorical, numerical, pattern, domains, special, identifiers, groups, min_support)
    finally:
        samples.unpersist()


def _suggest(samples: DataFrame, used: list[str], categorical: list[str], numerical: list[str], pattern: str, domains, special, identifiers, groups, min_support: int) -> list[dict]:
    e = Evaluator(samples, pattern, min_support)
    if not e.n_sat:
        return []
    identifiers = set(identifiers)
    valued = [c for c in categorical if c in used and c not in identifiers]
    atoms, sizes = e.atoms(valued, domains, special) if valued else ([], {})
    paired = e.pairwise(list(dict.fromkeys([*[c for c in valued if sizes.get(c)], *[c for c in used if c in identifiers]])))
    splits = sorted((r["column"], r["split_value"]) for r in best_splits(samples, [c for c in numerical if c in used]).collect()) if numerical else []
    numbers = e.rows(G.numeric(splits))
    out = [r for r in [*atoms, *paired, *numbers] if r["score"] >= COLLECT and r["score"] > OUT]
    merged = [r for r in e.rows(list(G.merges([r for r in atoms if r["score"] >= MERGE], sizes, PER_COLUMN))) if r["score"] >= OUT]
    out += [r for r in merged if r["score"] > OUT]
    parents = [r for r in [*atoms, *numbers, *merged] if r["score"] >= COLLECT]
    pools = legal_pools(parents, groups or [])
    if pools:
        sets = e.sets(sorted({c for pool in pools for c in pool}, key=str))
        sets.signatures = sets.signatures.persist(StorageLevel.MEMORY_AND_DISK)
        out += conjoined(pools, sets, e.n_sat, e.n_vio, min_support, OUT)
        sets.signatures.unpersist()
    return ranked(out)
