"""Candidate generation on the driver: bounded lists of conditions, never rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import Any

from ..functions.conditions import ColumnValue, Condition, MergedValues, Numerical, PairWise, normalized
from ..functions.scoring import MERGE_WEIGHT, rank_value

#: != is only worth saying in domains of more values than this.
SMALL_DOMAIN = 2
SEEDS = 25


def pairwise(columns: Iterable[str]) -> list[PairWise]:
    return [PairWise(c, op) for c in columns for op in ("=", "!=")]


def numeric(splits: Iterable[tuple[str, float]]) -> list[Numerical]:
    return [Numerical(c, op, v) for c, v in splits for op in ("<", ">=")]


def merge_allowed(k: int, domain_size: int, op: str) -> bool:
    """Sets that a shorter set says as well are left out."""
    rest = domain_size - k
    if rest <= 0 or rest == 1:
        return False
    return k <= rest if op == "=" else k < rest


def merges(results: list[dict], sizes: dict[str, int], per_column: int, least: int = 2, most: int = 4) -> Iterator[MergedValues]:
    """Sets of least..most of the best atoms of each column and operator; sizes: values of each domain."""
    groups: dict[tuple[str, str], list[dict]] = {}
    for r in results:
        c = r["condition"]
        if isinstance(c, ColumnValue):
            groups.setdefault((c.column, c.op), []).append(r)
    for (name, op), own in sorted(groups.items()):
        own.sort(key=lambda r: (-rank_value(r, MERGE_WEIGHT), -r["confidence"], str(r["condition"])))
        values = [r["condition"].value for r in own[:per_column]]
        for k in range(least, min(most, len(values)) + 1):
            if merge_allowed(k, sizes[name], op):
                for chosen in combinations(values, k):
                    yield MergedValues(name, frozenset(chosen), op)


def seeds(results: list[dict], top: int = SEEDS) -> list[dict]:
    """Union of the best by (score, confidence), by informedness and by confidence."""
    orders = (lambda r: (-r["score"], -r["confidence"]), lambda r: (-(r["confidence"] - r["penalty"]),), lambda r: (-r["confidence"],))
    chosen: dict[Condition, dict] = {}
    for key in orders:
        for r in sorted(results, key=lambda r: (*key(r), str(r["condition"])))[:top]:
            chosen.setdefault(r["condition"], r)
    return list(chosen.values())


def local_pools(results: list[dict], top: int = SEEDS) -> dict[str, list[dict]]:
    """Per column the union of the best by (score, confidence) and by informedness."""
    by: dict[str, list[dict]] = {}
    for r in results:
        by.setdefault(next(iter(r["condition"].columns())), []).append(r)
    out = {}
    for name, own in by.items():
        chosen: dict[Condition, dict] = {}
        for key in (lambda r: (-r["score"], -r["confidence"]), lambda r: (-(r["confidence"] - r["penalty"]),)):
            for r in sorted(own, key=lambda r: (*key(r), str(r["condition"])))[:top]:
                chosen.setdefault(r["condition"], r)
        out[name] = list(chosen.values())
    return out


def pools(results: list[dict], groups: list[list[str]], top: int = SEEDS) -> list[list[Condition]]:
    """The pools within which conjunctions are legal: the global seeds, and per column group its local pools with them."""
    common = [r["condition"] for r in seeds(results, top)]
    out = [common]
    local = local_pools(results, top)
    for group in groups:
        own = [r["condition"] for c in group for r in local.get(c, [])]
        if own:
            out.append(list(dict.fromkeys([*own, *common])))
    return out


def typed(value: str | None, kind: str) -> Any:
    """A counted value as a literal of the column's type."""
    if value is None:
        return None
    if kind in ("string",):
        return value
    if kind == "boolean":
        return value == "true"
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return int(value)
    if kind.startswith("decimal") or kind in ("float", "double"):
        return normalized(float(value))
    return value
