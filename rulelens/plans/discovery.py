"""From a rule and its samples to ranked refinements."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame

from ..operators.lookup import profile
from . import multi_row, single_row

SINGLE = "single_row_rule"
RELEVANCE = ("highly_relevant", "moderately_relevant", "unrelated")


class Advisor(Protocol):
    """What a semantic model may say; any answer may be empty."""

    def relevance(self, rule: str, columns: dict[str, str]) -> dict[str, str]: ...

    def utility(self, columns: dict[str, str]) -> dict[str, str]: ...

    def verify(self, rule: str, condition: str, columns: dict[str, str]) -> bool: ...


class EveryColumn:
    """The offline advisor: all columns are relevant, identifiers by cardinality only if asked."""

    def __init__(self, cardinality: dict[str, int] | None = None, identifier_from: int | None = None):
        self.cardinality, self.identifier_from = cardinality or {}, identifier_from

    def relevance(self, rule: str, columns: dict[str, str]) -> dict[str, str]:
        return {c: "highly_relevant" for c in columns}

    def utility(self, columns: dict[str, str]) -> dict[str, str]:
        limit = self.identifier_from
        return {c: "identifier" if limit and self.cardinality.get(c, 0) > limit else "categorical" for c in columns}

    def verify(self, rule: str, condition: str, columns: dict[str, str]) -> bool:
        return True


@dataclass
class Timing:
    advisor: float = 0.0
    mining: float = 0.0

    @property
    def total(self) -> float:
        return self.advisor + self.mining


@dataclass
class Engine:
    """Columns of a dataset with what is known about them."""

    categorical: list[str]
    numerical: list[str]
    meanings: dict[str, str] = field(default_factory=dict)
    domains: dict[str, list] = field(default_factory=dict)
    special: dict[str, list] = field(default_factory=dict)
    groups: list[list[str]] = field(default_factory=list)
    advisor: Advisor = field(default_factory=EveryColumn)
    timing: Timing = field(default_factory=Timing)
    _utility: dict | None = None
    _informed: bool = False

    def _ask(self, question, fallback):
        """An advisor's failure never stops mining."""
        began = time.time()
        try:
            return question() or fallback
        except Exception:  # noqa: BLE001 - whatever a foreign model raises
            return fallback
        finally:
            self.timing.advisor += time.time() - began

    def _columns(self, rule: str, data: DataFrame) -> tuple[list[str], list[str], list[str], list[list[str]]]:
        """Categorical and numerical columns that matter to the rule, the identifiers among the former, and the groups of such columns."""
        about = {c: self.meanings.get(c, "") for c in [*self.categorical, *self.numerical]}
        if hasattr(self.advisor, "inform") and not self._informed:
            known = profile(data, [c for c in about if c in data.columns]).collect()
            self._informed = True
            self.advisor.inform({r["column"]: r["first_values"].split("|") for r in known}, {r["column"]: r["n_distinct"] for r in known})
        relevant = self._ask(lambda: self.advisor.relevance(rule, about), {})
        kept = {c for c in about if relevant.get(c, RELEVANCE[0]) != "unrelated"}
        utility = self._utility or self._ask(lambda: self.advisor.utility({c: about[c] for c in self.categorical}), {})
        # no answer is asked for again with the next rule
        self._utility = utility or None
        categorical = [c for c in self.categorical if c in kept]
        identifiers = [c for c in categorical if utility.get(c) == "identifier"]
        return categorical, [c for c in self.numerical if c in kept and c not in categorical], identifiers, [[c for c in g if c in kept] for g in self.groups]

    def discover_many(self, rules: dict[str, str], data: DataFrame, flags: dict[str, str]) -> dict[str, list[dict]]:
        """Ranked conditions of many rules on single rows of one table: their texts, and the columns that flag violating rows (null: not of the rule), by name.

        Rules to which the same columns matter are mined together, with as many passes over the rows as one rule takes.
        """
        alike: dict[str, tuple[list[str], tuple]] = {}
        for name, text in rules.items():
            chosen = self._columns(text, data)
            alike.setdefault(repr(chosen), ([], chosen))[0].append(name)
        out: dict[str, list[dict]] = {}
        began = time.time()
        for names, (categorical, numerical, identifiers, groups) in alike.values():
            used = {*categorical, *numerical}
            domains, special = ({c: v for c, v in known.items() if c in used} for known in (self.domains, self.special))
            out |= single_row.suggest_many(data, {n: flags[n] for n in names}, [c for c in categorical if c not in identifiers], numerical, domains or None, special, groups)
        self.timing.mining += time.time() - began
        return out

    def discover(self, rule: str, rule_type: str, data: DataFrame, rule_columns: list[str] | None = None, verify_top: int = 0) -> list[dict]:
        """Ranked conditions for flagged rows (single_row_rule) or flagged samples (any other rule type).

        verify_top: of so many first conditions those go that the advisor finds senseless, given what the columns of
        the rule and of the condition mean; 0 asks about none.
        """
        categorical, numerical, identifiers, groups = self._columns(rule, data)
        domains = {c: v for c, v in self.domains.items() if c in {*categorical, *numerical}} or None
        special = {c: v for c, v in self.special.items() if c in {*categorical, *numerical}}
        began = time.time()
        if rule_type == SINGLE:
            out = single_row.suggest(data, [c for c in categorical if c not in identifiers], numerical, domains, special, groups)
        else:
            out = multi_row.suggest(data, categorical, numerical, multi_row.pattern_of(rule_type), domains, special, identifiers, groups)
        self.timing.mining += time.time() - began
        return self.verified(rule, out, verify_top, rule_columns) if verify_top else out

    def verified(self, rule: str, results: list[dict], top: int = 10, rule_columns: list[str] | None = None) -> list[dict]:
        """Results without those of the first `top` that the advisor finds senseless; a failure leaves them. It is told of the columns of rule and condition (of all, without those of the rule)."""
        every = [*self.categorical, *self.numerical]

        def sound(r: dict) -> bool:
            named = every if rule_columns is None else dict.fromkeys([*rule_columns, *sorted(r["condition"].columns())])
            about = {c: self.meanings.get(c, "") for c in named}
            return self._ask(lambda: (self.advisor.verify(rule, str(r["condition"]), about),), (True,))[0]

        return [r for i, r in enumerate(results) if i >= top or sound(r)]
