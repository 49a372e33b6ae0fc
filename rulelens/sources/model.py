"""Rules, candidate rules and what is known about a dataset; their JSON forms."""

from __future__ import annotations

import ast
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from ..functions.conditions import Condition, from_dict

DATE_OPERATORS = ("<", "<=", "==", ">", ">=")


@dataclass
class Rule:
    """A rule in words."""

    rule: str
    explanation: str = ""
    columns: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.columns = set(self.columns)
        for name in ("operator", "date_operator"):
            if getattr(self, name, None) is not None and getattr(self, name) not in DATE_OPERATORS:
                raise ValueError(f"{getattr(self, name)!r} is none of {DATE_OPERATORS}")


@dataclass
class FunctionalDependencyRule(Rule):
    left_side: str | list[str] | None = None
    right_side: str | list[str] | None = None


@dataclass
class TemporalRule(Rule):
    date1: str | None = None
    operator: str | None = None
    date2: str | None = None


@dataclass
class ReferenceTemporalRule(Rule):
    referencing_column: str | None = None
    referenced_identifier: str | None = None
    date1: str | None = None
    operator: str | None = None
    date2: str | None = None


@dataclass
class ReferenceEqualityRule(Rule):
    referencing_column: str | None = None
    referenced_identifier: str | None = None
    referencing_value: str | None = None
    referenced_value: str | None = None


@dataclass
class UniqueKeyRule(Rule):
    key: list[str] | None = None


@dataclass
class MonotonicRule(Rule):
    entity: str | list[str] | None = None
    order: str | list[str] | None = None
    value: str | None = None
    direction: str | None = None


@dataclass
class ReferencingPair:
    """A column whose values point to an identifier column. The names of the fields in stored files."""

    identifier_column: str
    reference_column: str
    details: str = ""


# Names of the rule models in stored files.
MODELS: dict[str, type[Rule]] = {
    "RuleDetail": Rule,
    "FDRuleDetail": FunctionalDependencyRule,
    "TemporalRuleDetail": TemporalRule,
    "ReferenceBasedTemporalRuleDetail": ReferenceTemporalRule,
    "ReferenceBasedEqualityRuleDetail": ReferenceEqualityRule,
    "UniqueKeyRuleDetail": UniqueKeyRule,
    "MonotonicRuleDetail": MonotonicRule,
}


def make_rule(model: str | None, data: dict | None) -> Rule | None:
    """A rule of its stored form; unknown fields are ignored, an unfit model becomes a plain rule."""
    if data is None:
        return None
    for cls in (MODELS.get(model or "", Rule), Rule):
        try:
            return cls(**{f.name: data[f.name] for f in fields(cls) if f.name in data})
        except (TypeError, ValueError):
            continue
    return None


def tuple_keys(x: Any) -> Any:
    """JSON with keys like "('a', 1)" turned back to tuples."""
    if isinstance(x, list):
        return [tuple_keys(y) for y in x]
    if not isinstance(x, dict):
        return x
    out = {}
    for k, v in x.items():
        if isinstance(k, str) and k[:1] == "(" and k[-1:] == ")":
            try:
                key = ast.literal_eval(k)
                k = key if isinstance(key, tuple) else k
            except (ValueError, SyntaxError):
                pass
        out[k] = tuple_keys(v)
    return out


@dataclass
class CandidateRule:
    """A rule with its result (satisfactions, violations, counts) and, if known, the condition under which it holds."""

    rule_id: int | str
    rule_type: str
    rule: Rule | None
    code: str | None = None
    execution_result: dict | None = None
    semantic_validity: bool | None = None
    condition: Condition | None = None


def load_rules(folder: str, rule_type: str, name: str = "candidate_rules_cache.json") -> dict | None:
    """Candidate rules by id from the rule type's folder, or else the folder itself; None if there is no readable file."""
    for path in (Path(folder, rule_type.replace(" ", "_"), name), Path(folder, name)):
        if path.exists():
            try:
                entries = json.loads(path.read_text(encoding="utf-8"))
            except (OSError, ValueError):
                return None
            return {
                e.get("rule_id"): CandidateRule(e.get("rule_id"), e.get("rule_type"), make_rule(e.get("rule_model"), e.get("rule")), e.get("code"), tuple_keys(e["execution_result"]) if e.get("execution_result") else None, e.get("semantic_validity"), from_dict(e.get("condition")))
                for e in entries
            }
    return None


def _plain(x: Any) -> Any:
    """What json can't write by itself."""
    if isinstance(x, (set, frozenset)):
        return sorted(x, key=lambda v: (v is None, str(type(v)), v if v is not None else 0))
    if hasattr(x, "item"):
        return x.item()
    if hasattr(x, "tolist"):
        return x.tolist()
    if hasattr(x, "isoformat"):
        return x.isoformat()
    raise TypeError(f"{type(x).__name__} has no JSON form")


@dataclass
class DataUnderstanding:
    """What is known about a dataset, with the path of its sample rows."""

    detailed_description: Any = ""
    column_meanings: dict[str, str] = field(default_factory=dict)
    categorical_columns: dict[str, set] = field(default_factory=dict)
    syntactic_columns: list[str] = field(default_factory=list)
    special_values: dict[str, set] = field(default_factory=dict)
    column_groups: list[list[str]] = field(default_factory=list)
    referencing_column_pairs: list[ReferencingPair] | None = None
    samples: str | None = None

    def sample_rows(self, spark):
        """The sample rows as a DataFrame; None if there are none."""
        from .tables import read_csv

        return read_csv(spark, self.samples) if self.samples and Path(self.samples).exists() else None

    def save(self, folder: str, samples=None) -> None:
        """data_understanding.json, and the sample rows (a small DataFrame) as samples.csv."""
        Path(folder).mkdir(parents=True, exist_ok=True)
        data = asdict(self) | {"special_values": {k: _plain(v) if v else None for k, v in self.special_values.items()}}
        data.pop("samples")
        Path(folder, "data_understanding.json").write_text(json.dumps(data, indent=4, default=_plain), encoding="utf-8")
        if samples is not None:
            samples.toPandas().to_csv(Path(folder, "samples.csv"), index=False)

    @classmethod
    def load(cls, folder: str) -> "DataUnderstanding":
        path, csv = Path(folder, "data_understanding.json"), Path(folder, "samples.csv")
        for p in (Path(folder), path, csv):
            if not p.exists():
                raise FileNotFoundError(f"{p} is missing")
        try:
            data = json.loads(path.read_text(encoding="utf-8"))
        except json.JSONDecodeError as e:
            raise ValueError(f"{path} is no JSON: {e}") from e
        sets = lambda name: {k: set(v) if isinstance(v, list) else set() for k, v in (data.get(name) or {}).items()}
        pairs = data.get("referencing_column_pairs")
        pairs = pairs.get("pairs", pairs.get("column_pairs")) if isinstance(pairs, dict) else pairs
        return cls(data.get("detailed_description", ""), data.get("column_meanings") or {}, sets("categorical_columns"), data.get("syntactic_columns") or [], sets("special_values"), data.get("column_groups") or [], [ReferencingPair(**{k: p[k] for k in ("identifier_column", "reference_column", "details") if k in p}) if isinstance(p, dict) else p for p in pairs] if pairs is not None else None, str(csv))
