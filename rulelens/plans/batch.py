"""Batches of rules: sample, discover, find the sought condition's place, and sum up.

Stored rules name the rows (or groups of rows by role) that satisfy and violate them; they become flagged samples. A
strategy turns a task into ranked conditions: the engine by default, or a comparison method.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.conditions import Condition
from ..functions.scoring import VIOLATING
from ..operators import baselines, lookup, ranking, sampling, sides
from ..operators.atoms import equality, inequality
from ..operators.candidates import typed
from ..operators.evaluation import rank_of
from ..functions.conditions import ColumnValue
from ..sources.model import CandidateRule, DataUnderstanding, load_rules
from .discovery import SINGLE, Advisor, Engine, EveryColumn

#: Rows that are sampled of either side of a rule.
SAMPLE_ROWS = 100_000


@dataclass
class Task:
    """One rule with its flagged rows (or samples) and the condition that should be found."""

    dataset: str
    rule_type: str
    rule_id: int | str
    rule: str
    data: DataFrame
    kind: str
    sought: Condition | None
    categorical: list[str]
    numerical: list[str]
    known: DataUnderstanding = field(default_factory=DataUnderstanding)
    rows: DataFrame | None = None
    sampling_seconds: float = 0.0


Strategy = Callable[[Task], list[dict]]


def units(spark: SparkSession, groups: dict) -> DataFrame:
    """(group_key, rep, role, row_id) of stored groups: key -> one representation or several, each role -> row ids."""
    rows = []
    for key, reps in groups.items():
        for rep, roles in enumerate(reps if isinstance(reps, list) else [reps]):
            listed = roles.items() if isinstance(roles, dict) else [("0", roles)]
            rows += [(str(key), rep, str(role), int(i)) for role, ids in listed for i in (ids if isinstance(ids, (list, set, tuple)) else [ids])]
    return spark.createDataFrame(rows, "group_key string, rep int, role string, row_id long")


def flagged(rows: DataFrame, result: dict, categorical: list[str], numerical: list[str], k: int = SAMPLE_ROWS) -> tuple[DataFrame, str]:
    """Sampled rows (or samples of rows) of both sides with their flag, and the kind of rule."""
    spark, parts = rows.sparkSession, []
    single = not isinstance(result["satisfactions"], dict)
    for name, flag in (("satisfactions", False), ("violations", True)):
        if single:
            ids = spark.createDataFrame([(int(i),) for i in result[name]], "id long")
            part = sampling.sample(lookup.entities(rows, ids, "row_id"), k, True, categorical)
        else:
            wanted = units(spark, result[name])
            scores = sampling.rarity(lookup.entities(rows, wanted.select("row_id"), "row_id"), categorical, numerical, bins=5)
            chosen = sampling.hierarchical(wanted, scores, k, 1, True).drop("score")
            part = chosen.join(rows, "row_id").withColumn("sample_id", F.concat_ws("#", F.lit(name), "group_key", "rep")).drop("group_key", "rep")
        parts.append(part.withColumn(VIOLATING, F.lit(flag)))
    return parts[0].unionByName(parts[1]), SINGLE if single else "multi_row_rule"


def tasks(datasets: dict[str, tuple[DataFrame, DataUnderstanding]], folder: str, rule_types: Iterable[str], k: int = SAMPLE_ROWS) -> Iterator[Task]:
    """The stored rules of datasets (rows with row_id, and what is known about them) under folder/dataset; missing ones are skipped."""
    for name, (rows, known) in datasets.items():
        categorical, numerical = lookup.column_kinds(rows.drop("row_id"), list(known.categorical_columns))
        for rule_type in rule_types:
            found: dict[int | str, CandidateRule] = load_rules(f"{folder}/{name}", rule_type) or {}
            for rule_id, candidate in found.items():
                if not candidate.execution_result:
                    continue
                began = time.time()
                data, kind = flagged(rows, candidate.execution_result, categorical, numerical, k)
                data = data.persist()
                data.count()
                text = candidate.rule.rule if candidate.rule else ""
                yield Task(name, rule_type, rule_id, text, data, kind, candidate.condition, categorical, numerical, known, rows, time.time() - began)
                data.unpersist()


def engine_strategy(advisor: Advisor | None = None) -> Strategy:
    """Discovery by the engine; one engine per dataset, so its columns are judged once."""
    engines: dict[str, Engine] = {}

    def run(task: Task) -> list[dict]:
        known = task.known
        engine = engines.setdefault(task.dataset, Engine(task.categorical, task.numerical, known.column_meanings, {c: list(v) for c, v in known.categorical_columns.items() if v}, {c: list(v) for c, v in known.special_values.items() if v}, known.column_groups, advisor or EveryColumn()))
        run.advisor_seconds = -engine.timing.advisor
        out = engine.discover(task.rule, SINGLE if task.kind == SINGLE else task.rule_type, task.data)
        run.advisor_seconds += engine.timing.advisor
        return out

    run.advisor_seconds = 0.0
    return run


def tree_strategy(task: Task) -> list[dict]:
    if task.kind == SINGLE:
        return baselines.tree_rules(task.data, task.categorical, task.numerical)
    return sides.pair_tree_rules(task.data, task.categorical, task.numerical)


def atom_strategy(task: Task) -> list[dict]:
    """Single values only: = and != of every categorical value, without redundant ones, in final order."""
    both = equality(task.data, task.categorical).where("value IS NOT NULL").withColumn("op", F.lit("=")).unionByName(inequality(task.data, task.categorical).withColumn("op", F.lit("!=")))
    scored = both.withColumns({"signature": F.concat_ws(":", "column", "op"), "expr": F.concat_ws(" ", "column", "op", "value")})
    kept = ranking.final_order(ranking.without_redundancy(scored)).orderBy("place")
    return [r.asDict() | {"condition": ColumnValue(r["column"], r["op"], typed(r["value"], task.data.schema[r["column"]].dataType.simpleString()))} for r in kept.collect()]


@dataclass
class Report:
    """One record per rule."""

    records: list[dict] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r["dataset"], r["rule_type"], str(r["rule_id"]), r["rank"], r["conditions"], r["sampling"], r["advisor"], r["mining"]) for r in self.records]
        return spark.createDataFrame(rows, "dataset string, rule_type string, rule_id string, rank int, conditions int, sampling double, advisor double, mining double")

    def metrics(self, spark: SparkSession) -> DataFrame:
        """Rules, hits at 1, 3, 5 and 10, and mean reciprocal rank."""
        return ranking.retrieval(self.frame(spark))

    def times(self, spark: SparkSession, part: str = "mining") -> DataFrame:
        """Seconds per rule of sampling, advisor or mining: count, total, mean, median, least, most, deviation."""
        return ranking.summary(self.frame(spark), part)


def run(work: Iterable[Task], strategy: Strategy | None = None) -> Report:
    """The place of each task's sought condition among the strategy's conditions."""
    strategy, report = strategy or engine_strategy(), Report()
    for task in work:
        began = time.time()
        found = strategy(task)
        seconds, advisor = time.time() - began, getattr(strategy, "advisor_seconds", 0.0)
        rows = task.rows if task.rows is not None else task.data
        rank = rank_of(rows, found, task.sought) if task.sought is not None else None
        report.records.append({"dataset": task.dataset, "rule_type": task.rule_type, "rule_id": task.rule_id, "rank": rank, "conditions": len(found), "sampling": task.sampling_seconds, "advisor": advisor, "mining": seconds - advisor})
    return report


@dataclass
class Flagged:
    """A rule on single rows of a table with the column that flags the rows that violate it (null: rows that it has nothing to do with)."""

    rule_id: int | str
    rule: str
    flag: str
    sought: Condition | None = None


def run_together(dataset: str, rows: DataFrame, rules: list[Flagged], engine: Engine) -> Report:
    """`run` for all rules of one table at once: the rows are read as often as for one rule, and each rule counts an equal share of the seconds."""
    before, asked = engine.timing.mining, engine.timing.advisor
    found = engine.discover_many({str(r.rule_id): r.rule for r in rules}, rows, {str(r.rule_id): r.flag for r in rules})
    mining, advisor = (engine.timing.mining - before) / max(1, len(rules)), (engine.timing.advisor - asked) / max(1, len(rules))
    report = Report()
    for r in rules:
        own = found[str(r.rule_id)]
        rank = rank_of(rows, own, r.sought) if r.sought is not None else None
        report.records.append({"dataset": dataset, "rule_type": SINGLE, "rule_id": r.rule_id, "rank": rank, "conditions": len(own), "sampling": 0.0, "advisor": advisor, "mining": mining})
    return report
