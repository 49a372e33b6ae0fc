"""All registered queries: each operator over the test tables, with its SQL counterpart in `oracles`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.binning import QUARTILES, quartile_bin, width_bin
from ..functions.conditions import ColumnValue, Conjunction, MergedValues, Numerical
from ..functions.scoring import VIOLATING
from ..operators import atoms, baselines, conjunctions, evaluation, lookup, pairs, quantiles, ranking, rules, sampling, screening, sides, splits
from ..streaming import incremental
from . import batch, discovery, multi_row, single_row
from .oracles import ORACLES  # noqa: F401

CATEGORICAL = ["o_year", "l_returnflag", "l_linestatus", "o_orderpriority", "supp_class"]
NUMERIC = ["o_totalprice", "l_quantity", "l_discount"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with their orders, flagged where they shipped before the order's date."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    supplier = F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string")))
    return rules.temporal_order(joined.withColumns({"o_year": F.year("o_orderdate"), "supp_class": supplier}), "l_shipdate", ">=", "o_orderdate")


def _items_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, those of an order together. Their number is known from the files."""
    rows = table(spark, sf_dir, "lineitem")
    return rules.together(rows, ["l_orderkey"], rows.count())


def keyed_samples(spark: SparkSession, sf_dir: str, below: int | None = None) -> DataFrame:
    """Orders as samples of the key rule (order, line): role is the line status, rows in a total order."""
    rows = _items_by_order(spark, sf_dir)
    return _order_samples(rows, rules.unique_key(rows, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(F.bool_or(VIOLATING).alias(VIOLATING)))


def summed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples of the rule that their quantities sum up to 150 at most, with a class of suppliers."""
    rows = _items_by_order(spark, sf_dir)
    supplier = F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string"))
    return _order_samples(rows, rules.sum_to_threshold(rows, ["l_orderkey"], "l_quantity", "<=", 150.0)).withColumn("supp", supplier)


def _order_samples(rows: DataFrame, units: DataFrame) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    return rules.samples(rows, units, ["l_orderkey"], F.col("l_linestatus"), order)


def _metrics(df: DataFrame, *keys: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return df.select(*keys, "sat_matches", "vio_matches", r("confidence"), r("penalty"), r("score"))


def _conditions(spark, sf_dir, named: dict) -> DataFrame:
    rows = base(spark, sf_dir)
    found = atoms.evaluate(rows, list(named.values()))
    names = F.array(*map(F.lit, named))
    return _metrics(found.withColumn("name", F.get(names, F.col("cond"))), "name")


def atomic_eq(spark, sf_dir):
    return _metrics(atoms.equality(base(spark, sf_dir), CATEGORICAL).where("value IS NOT NULL"), "column", "value")


def atomic_neq(spark, sf_dir):
    return _metrics(atoms.inequality(base(spark, sf_dir), CATEGORICAL), "column", "value")


def atomic_isnull(spark, sf_dir):
    return _conditions(spark, sf_dir, {"null": ColumnValue("supp_class", "=", None), "not_null": ColumnValue("supp_class", "!=", None)})


def atomic_numeric(spark, sf_dir):
    return _conditions(spark, sf_dir, {"lt": Numerical("o_totalprice", "<", 150000.0), "gte": Numerical("o_totalprice", ">=", 150000.0)})


def merged_in(spark, sf_dir):
    return _conditions(spark, sf_dir, {"years": MergedValues("o_year", {1995, 1996}, "="), "classes": MergedValues("supp_class", {"S1", None}, "=")})


def merged_not_in(spark, sf_dir):
    return _conditions(spark, sf_dir, {"years": MergedValues("o_year", {1997, 1998}, "!="), "classes": MergedValues("supp_class", {"S1", "S2"}, "!=")})


def evaluate_condition(spark, sf_dir):
    c = Conjunction({ColumnValue("o_year", "=", 1995), ColumnValue("supp_class", "!=", "S1"), Numerical("l_quantity", ">=", 10.0)})
    return _metrics(atoms.evaluate(base(spark, sf_dir), [c], 1), *[])


_POOL = [ColumnValue("o_year", "=", 1995), ColumnValue("o_year", "=", 1996), ColumnValue("l_returnflag", "=", "R"), ColumnValue("l_linestatus", "=", "O"), ColumnValue("supp_class", "!=", "S1"), Numerical("o_totalprice", "<", 150000.0)]


def _sets(spark, sf_dir, size):
    found = conjunctions.combinations(base(spark, sf_dir), _POOL, 5).where(F.size("ids") == size)
    return _metrics(found.withColumn("ids", F.concat_ws(",", F.col("ids").cast("array<string>"))), "ids")


def conjunction_2(spark, sf_dir):
    return _sets(spark, sf_dir, 2)


def conjunction_3(spark, sf_dir):
    return _sets(spark, sf_dir, 3)


def blank_to_null(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment")).alias("segment"))
    return lookup.blank_to_null(raw)


def normalize_null_literals(spark, sf_dir):
    words = F.when(F.col("c_custkey") % 5 == 0, "None").when(F.col("c_custkey") % 5 == 1, "<NA>").when(F.col("c_custkey") % 5 == 2, "NaN").otherwise(F.col("c_mktsegment"))
    return lookup.null_words_to_null(table(spark, sf_dir, "customer").select("c_custkey", words.alias("segment")))


def column_profile(spark, sf_dir):
    return lookup.profile(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


def entity_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_nationkey = 3").select("c_custkey")
    return lookup.entities(table(spark, sf_dir, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


def entity_group_lookup(spark, sf_dir):
    groups = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("entity"), F.col("c_custkey").alias("id"))
    return lookup.entity_groups(table(spark, sf_dir, "orders"), groups, "o_custkey")


def numeric_splits(spark, sf_dir):
    best = splits.best_splits(base(spark, sf_dir), NUMERIC)
    return best.select("column", "rank", F.round("split_value", 6).alias("split_value"), F.round("gain", 8).alias("gain"))


def numeric_split_stats(spark, sf_dir):
    names = [f"{s}_{m}" for s in ("lt", "gte") for m in ("confidence", "penalty", "score")]
    found = splits.split_stats(splits.best_splits(base(spark, sf_dir), NUMERIC))
    return found.select("column", "rank", *[F.round(c, 6).alias(c) for c in names])


def quartile_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    edges = quantiles.wide(rows, ["l_extendedprice"], QUARTILES).select(F.col("l_extendedprice").alias("edges"))
    return rows.join(F.broadcast(edges)).select(quartile_bin(F.col("l_extendedprice"), F.col("edges")).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def equal_width_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    ends = rows.agg(F.min("l_quantity").cast("double").alias("low"), F.max("l_quantity").cast("double").alias("high"))
    return rows.join(F.broadcast(ends)).select(width_bin(F.col("l_quantity"), F.col("low"), F.col("high"), 10).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def potential_categorical(spark, sf_dir):
    return screening.categorical(base(spark, sf_dir), CATEGORICAL).select("column", "value", F.round("valid", 6).alias("valid"), "n")


def potential_numeric(spark, sf_dir):
    return screening.numerical(base(spark, sf_dir), NUMERIC).select("column", "value", F.round("valid", 6).alias("valid"), "n")


def potential_decision(spark, sf_dir):
    found = screening.decision(base(spark, sf_dir), CATEGORICAL, NUMERIC)
    return found.select("refine", "n", F.round("global_valid", 6).alias("global_valid"), F.round("best_gain", 6).alias("best_gain"), "best_column", "best_value")


def _pair_counts(spark, sf_dir, pattern):
    return pairs.total(keyed_samples(spark, sf_dir), pattern)


def pairs_between_groups(spark, sf_dir):
    return _pair_counts(spark, sf_dir, "between_groups")


def pairs_within_groups(spark, sf_dir):
    return _pair_counts(spark, sf_dir, "within_groups")


def pairs_all_combinations(spark, sf_dir):
    return _pair_counts(spark, sf_dir, "all_combinations")


_PAIR_CONDITIONS = [ColumnValue("l_returnflag", "=", "R"), Numerical("l_quantity", ">=", 25.0), ColumnValue("l_returnflag", "!=", "A")]


def pair_both_sides(spark, sf_dir):
    return pairs.matching_all(keyed_samples(spark, sf_dir), _PAIR_CONDITIONS)


def _pairwise(spark, sf_dir, op):
    rows = keyed_samples(spark, sf_dir).withColumn("supp", F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey") % 5))
    return pairs.pairwise_all(rows, ["l_returnflag", "supp"]).where(F.col("op") == op).select("pattern", "column", "pairs")


def pairwise_eq(spark, sf_dir):
    return _pairwise(spark, sf_dir, "=")


def pairwise_neq(spark, sf_dir):
    return _pairwise(spark, sf_dir, "!=")


def penalty_whole_group(spark, sf_dir):
    vio = keyed_samples(spark, sf_dir).where(VIOLATING)
    n = vio.agg(F.countDistinct("sample_id").alias("n"))
    return pairs.whole_groups(vio, _PAIR_CONDITIONS).join(F.broadcast(n)).select("cond", "matched", "n", F.round(F.col("matched") / F.col("n"), 6).alias("penalty"))


def penalty_pairs(spark, sf_dir):
    vio = keyed_samples(spark, sf_dir).where(VIOLATING)
    whole = pairs.total(vio, "within_groups").withColumnRenamed("pairs", "n")
    return pairs.matching(vio, _PAIR_CONDITIONS, "within_groups").join(F.broadcast(whole)).select("cond", "pairs", "n", F.round(F.col("pairs") / F.col("n"), 6).alias("penalty"))


def confidence_rows(spark, sf_dir):
    sat = keyed_samples(spark, sf_dir).where(~F.col(VIOLATING))
    found = atoms.evaluate(sat, _PAIR_CONDITIONS, 10)
    return found.select("cond", "sat_matches", "n_sat", F.round("confidence", 6).alias("confidence"))


def confidence_pairs(spark, sf_dir):
    sat = keyed_samples(spark, sf_dir).where(~F.col(VIOLATING))
    whole = pairs.total(sat, "between_groups").withColumnRenamed("pairs", "n")
    return pairs.pairwise(sat, ["l_returnflag"], "between_groups").join(F.broadcast(whole)).select("op", "pairs", "n", F.round(F.col("pairs") / F.col("n"), 6).alias("confidence"))


def confidence_with_violations(spark, sf_dir):
    rows = keyed_samples(spark, sf_dir)
    both = pairs.with_violations(rows.where(~F.col(VIOLATING)), rows.where(VIOLATING), True)
    # names of samples are many in few bytes, so the size of a partition is a number of rows here
    named = rules.together(both.select("sample_id"), ["sample_id"], table(spark, sf_dir, "lineitem").count())
    return named.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


def flatten_samples(spark, sf_dir):
    rows = keyed_samples(spark, sf_dir)
    per_role = rows.groupBy("l_orderkey", "role").agg(F.sort_array(F.collect_list(F.struct("row_id", "l_partkey"))).alias("rows"))
    nested = per_role.groupBy("l_orderkey").agg(F.array(F.map_from_entries(F.collect_list(F.struct("role", F.transform("rows", lambda x: x.l_partkey))))).alias("samples"))
    return pairs.flatten(nested, "l_orderkey").select("sample_id", "role", "row_id", F.col("row").alias("l_partkey"))


def _scored_atoms(spark, sf_dir):
    rows = base(spark, sf_dir)
    eq = atoms.equality(rows, CATEGORICAL).where("value IS NOT NULL").withColumn("op", F.lit("="))
    ne = atoms.inequality(rows, CATEGORICAL).withColumn("op", F.lit("!="))
    both = eq.unionByName(ne)
    return both.withColumns({"signature": F.concat_ws(":", "column", "op"), "expr": F.concat_ws(" ", "column", "op", "value")})


def redundancy_filter(spark, sf_dir):
    return _metrics(ranking.without_redundancy(_scored_atoms(spark, sf_dir)), "signature", "expr")


def final_ranking(spark, sf_dir):
    kept = ranking.final_order(ranking.without_redundancy(_scored_atoms(spark, sf_dir)))
    return kept.select("place", "expr", F.round("final_rank", 6).alias("final_rank"))


def _ranks(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 13 + 1).alias("rank"))


def ranking_metrics(spark, sf_dir):
    return ranking.retrieval(_ranks(spark, sf_dir)).select("rules", *[F.round(c, 6).alias(c) for c in ("hits_at_1", "hits_at_3", "hits_at_5", "hits_at_10", "mrr")])


def timing_summary(spark, sf_dir):
    return ranking.summary(table(spark, sf_dir, "events"), "value").select("n", *[F.round(c, 4).alias(c) for c in ("total", "mean", "median", "least", "most", "deviation")])


def _customers(spark, sf_dir):
    balance = F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), "c_mktsegment", F.col("c_nationkey").cast("string").alias("nation"), balance.alias("balance"))


def sample_uniform(spark, sf_dir):
    return sampling.uniform(_customers(spark, sf_dir), 100).select("row_id")


def sample_informative(spark, sf_dir):
    return sampling.informative(_customers(spark, sf_dir), 60, ["c_mktsegment", "nation"], 2).select("row_id")


def rarity_score(spark, sf_dir):
    found = sampling.rarity(_customers(spark, sf_dir), ["c_mktsegment", "nation"], ["balance"])
    return found.select("row_id", F.round("score", 8).alias("score"))


def _candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select((F.col("c_custkey") % 40).cast("string").alias("group_key"), F.lit(0).alias("rep"), F.when(F.col("c_acctbal") > 4500, "high").otherwise("low").alias("role"), F.col("c_custkey").alias("row_id"))


def hier_sample(spark, sf_dir):
    scores = sampling.rarity(_customers(spark, sf_dir), ["c_mktsegment", "nation"], ["balance"])
    return sampling.hierarchical(_candidates(spark, sf_dir), scores, 300).select("group_key", "role", "row_id")


def reconstruct_samples(spark, sf_dir):
    scores = sampling.rarity(_customers(spark, sf_dir), ["c_mktsegment", "nation"], ["balance"])
    kept = sampling.hierarchical(_candidates(spark, sf_dir), scores, 300)
    roles = sampling.reconstruct(kept, _customers(spark, sf_dir)).select("group_key", "rep", F.explode("roles").alias("role", "rows"))
    return roles.select("group_key", "rep", "role", F.posexplode("rows").alias("place", "row")).select("group_key", "rep", "role", "place", "row.*")


def entity_group_rows(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    groups = table(spark, sf_dir, "customer").join(chosen, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("c_nationkey").alias("entity"), F.col("c_custkey").alias("id"))
    return lookup.entity_group_rows(table(spark, sf_dir, "orders"), groups, "o_custkey").select("entity", "o_orderkey", "o_custkey")


def sample_rows(spark, sf_dir):
    rows = _customers(spark, sf_dir)
    return sampling.sample(rows, 80, False).select("row_id").unionByName(sampling.sample(rows.where("nation = '3'"), 1 << 30, True, ["nation"]).select("row_id"))


def tree_pairs(spark, sf_dir):
    return sides.value_meetings(keyed_samples(spark, sf_dir), ["l_returnflag"], ["l_quantity"]).withColumnRenamed(VIOLATING, "vio")


def _with_supplier(spark, sf_dir):
    return keyed_samples(spark, sf_dir).withColumn("supp", F.concat(F.lit("S"), (F.col("l_suppkey") % 5).cast("string")))


def tree_pair_rules(spark, sf_dir):
    return single_row.to_frame(spark, sides.pair_tree_rules(summed_samples(spark, sf_dir), ["l_returnflag", "supp"], ["l_quantity", "l_discount"]))


def subgroup_pairs(spark, sf_dir):
    return single_row.to_frame(spark, sides.pair_subgroups(summed_samples(spark, sf_dir), ["l_returnflag", "supp", "l_quantity", "l_discount"]))


_SOUGHT = [ColumnValue("o_year", "=", 1995), ColumnValue("l_returnflag", "!=", "R"), ColumnValue("supp_class", "=", "S1"), ColumnValue("l_linestatus", "=", "F"), ColumnValue("o_orderpriority", "=", "5-LOW"), ColumnValue("o_year", "!=", 1900)]


def batch_metrics(spark, sf_dir):
    rows = base(spark, sf_dir).persist()
    work = [batch.Task("orders", "temporal", i, "items ship on or after the order's date", rows, discovery.SINGLE, c, CATEGORICAL, []) for i, c in enumerate(_SOUGHT)]
    known: list[dict] = []

    def strategy(task):  # one list for all, as the rows are the same
        known.extend([] if known else batch.atom_strategy(task))
        return known

    found = batch.run(work, strategy).metrics(spark)
    rows.unpersist()
    return found.select("rules", *[F.round(c, 6).alias(c) for c in ("hits_at_1", "hits_at_3", "hits_at_5", "hits_at_10", "mrr")])


def batch_engine(spark, sf_dir):
    """Two stored rules with the conditions that should refine them, mined together by the engine with all columns."""
    urgent = ~((F.col("l_discount") <= 0.05) | (F.col("o_orderpriority") == "1-URGENT"))
    stored = [batch.Flagged(0, "items ship on or after the order's date", VIOLATING, ColumnValue("o_year", "=", 1995)), batch.Flagged(1, "discounts are at most 5 per cent", "dear", ColumnValue("o_orderpriority", "=", "1-URGENT"))]
    report = batch.run_together("orders", base(spark, sf_dir).withColumn("dear", urgent), stored, discovery.Engine(CATEGORICAL, NUMERIC))
    return report.frame(spark).select("rule_id", "rank", "conditions")


def sample_texts(spark, sf_dir):
    """A sample that covers a free text that few rows have, besides values, quartiles and nulls."""
    noted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.when(F.col("c_custkey") % 97 == 0, F.col("c_name")).alias("note"))
    return sampling.informative(_customers(spark, sf_dir).join(noted, "row_id"), 60, ["c_mktsegment", "nation"], 2).select("row_id")


def condition_iou(spark, sf_dir):
    found = evaluation.overlap(base(spark, sf_dir), Numerical("o_totalprice", "<", 150000.0), Numerical("o_totalprice", "<", 151000.0))
    return found.select("both", "either", F.round("iou", 6).alias("iou"))


def one_hot(spark, sf_dir):
    values = {"o_year": [1995, 1996, 1997, 1998], "supp_class": ["S0", "S1", None]}
    hot = baselines.one_hot(base(spark, sf_dir), ["o_year", "supp_class"], ["l_quantity"], values)
    return hot.agg(*[F.sum(F.col(f"`{c}={v}`")).cast("long").alias(f"{c}_{v}".lower()) for c, vs in values.items() for v in vs], F.sum("l_quantity").cast("double").alias("quantity"))


def tree_stump(spark, sf_dir):
    found = baselines.value_gains(base(spark, sf_dir), CATEGORICAL)
    return found.select("column", F.coalesce("value", F.lit("<null>")).alias("value"), F.round("gain", 8).alias("gain"), "n_in", "v_in")


def search_space(spark, sf_dir):
    rows = base(spark, sf_dir).select(VIOLATING, "l_returnflag", "l_linestatus", "supp_class", "l_quantity")
    return spark.createDataFrame([(str(c),) for c in baselines.search_space(rows)], "selector string")


def wracc(spark, sf_dir):
    counts = atoms.equality(base(spark, sf_dir), CATEGORICAL).where("value IS NOT NULL")
    return baselines.wracc(counts).select("column", "value", F.round("wracc", 8).alias("wracc"))


def subgroup_level1(spark, sf_dir):
    counts = baselines.wracc(atoms.equality(base(spark, sf_dir), ["l_returnflag", "l_linestatus", "o_orderpriority", "supp_class"]).where("value IS NOT NULL"))
    order = Window.orderBy(F.desc(F.round("wracc", 10)), "column", "value")
    return counts.withColumn("place", F.row_number().over(order)).where("place <= 20").select("place", "column", "value", F.round("wracc", 8).alias("wracc"), F.round("score", 6).alias("score"))


def suggest_single_row(spark, sf_dir):
    return single_row.to_frame(spark, single_row.suggest(base(spark, sf_dir), CATEGORICAL, NUMERIC, groups=[["o_year", "supp_class"]]))


def _suggest_multi(spark, sf_dir, pattern):
    return single_row.to_frame(spark, multi_row.suggest(_with_supplier(spark, sf_dir), ["l_returnflag", "supp"], ["l_quantity"], pattern))


def suggest_multi_between(spark, sf_dir):
    return _suggest_multi(spark, sf_dir, "between_groups")


def suggest_multi_within(spark, sf_dir):
    return _suggest_multi(spark, sf_dir, "within_groups")


def suggest_multi_whole(spark, sf_dir):
    return _suggest_multi(spark, sf_dir, multi_row.WHOLE)


def suggest_multi_identifiers(spark, sf_dir):
    """The class of suppliers as an identifier: pairwise conditions only."""
    return single_row.to_frame(spark, multi_row.suggest(_with_supplier(spark, sf_dir), ["l_returnflag"], ["l_quantity"], "between_groups", identifiers=["supp"]))


def discover(spark, sf_dir):
    engine = discovery.Engine(CATEGORICAL, NUMERIC)
    return single_row.to_frame(spark, engine.discover("items ship on or after the order's date", discovery.SINGLE, base(spark, sf_dir)))


def tree_rules(spark, sf_dir):
    return single_row.to_frame(spark, baselines.tree_rules(base(spark, sf_dir), CATEGORICAL, NUMERIC))


def subgroup_beam(spark, sf_dir):
    others = [F.col(c) for c in [*CATEGORICAL, *NUMERIC] if c != "o_year"]
    return single_row.to_frame(spark, baselines.subgroup_beam(base(spark, sf_dir).select(VIOLATING, F.col("o_year").cast("string").alias("o_year"), *others)))


def hybrid_rank(spark, sf_dir):
    found = single_row.suggest(base(spark, sf_dir), ["o_year", "supp_class"], [], conjunctions=False)
    mixed = ranking.hybrid(found, {"o_year": "highly_relevant", "supp_class": "moderately_relevant"})
    return spark.createDataFrame([(str(r["condition"]), float(r["hybrid_score"])) for r in mixed], "expr string, hybrid_score double")


def _flag_counts(units: DataFrame) -> DataFrame:
    return units.agg(F.count(F.lit(1)).alias("units"), F.count(F.when(F.col(VIOLATING), 1)).alias("violating"))


def rule_functional_dependency(spark, sf_dir):
    return _flag_counts(rules.functional_dependency(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linestatus"))


def rule_unique_key(spark, sf_dir):
    return _flag_counts(rules.unique_key(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]))


def rule_sum_comparison(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _flag_counts(rules.sum_comparison(rows, ["l_orderkey"], "l_extendedprice", "<=", "o_totalprice"))


def rule_sum_threshold(spark, sf_dir):
    return _flag_counts(rules.sum_to_threshold(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", "<=", 100.0))


def rule_monotonic(spark, sf_dir):
    return _flag_counts(rules.monotonic(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value"))


def rule_reference_equality(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return _flag_counts(rules.reference_equality(rows, "l_suppkey", table(spark, sf_dir, "supplier"), "s_suppkey", "c_nationkey", "s_nationkey"))


def stream_atom_counts(spark, sf_dir):
    """Event counts by type and weekday half, as the streaming job keeps them."""
    events = table(spark, sf_dir, "events").withColumn(VIOLATING, F.col("value") < 50)
    return _metrics(incremental.metrics(incremental.atom_counts(events, ["event_type"])), "column", "value")


_NAMES = """atomic_eq atomic_neq atomic_isnull atomic_numeric merged_in merged_not_in evaluate_condition conjunction_2 conjunction_3
blank_to_null normalize_null_literals column_profile entity_lookup entity_group_lookup numeric_splits numeric_split_stats quartile_bins
equal_width_bins potential_categorical potential_numeric potential_decision pairs_between_groups pairs_within_groups
pairs_all_combinations pair_both_sides pairwise_eq pairwise_neq penalty_whole_group penalty_pairs confidence_rows confidence_pairs
confidence_with_violations flatten_samples redundancy_filter final_ranking ranking_metrics timing_summary sample_uniform
sample_informative rarity_score hier_sample reconstruct_samples condition_iou one_hot tree_stump search_space wracc subgroup_level1
suggest_single_row suggest_multi_between suggest_multi_within suggest_multi_whole discover tree_rules subgroup_beam hybrid_rank
entity_group_rows sample_rows tree_pairs tree_pair_rules subgroup_pairs batch_engine sample_texts suggest_multi_identifiers batch_metrics rule_functional_dependency rule_unique_key rule_sum_comparison rule_sum_threshold rule_monotonic rule_reference_equality stream_atom_counts"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}
