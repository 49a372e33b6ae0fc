"""Cleaning, profiles and lookups by identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import NULL_WORDS


def _strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def blank_to_null(df: DataFrame) -> DataFrame:
    """Strings of nothing but white space become null."""
    return df.withColumns({c: F.when(F.trim(F.col(c)) != "", F.col(c)) for c in _strings(df)})


def null_words_to_null(df: DataFrame) -> DataFrame:
    """none, null, nan, na and <na>, in any case, become null."""
    return df.withColumns({c: F.when(~F.lower(F.trim(F.col(c))).isin(*NULL_WORDS), F.col(c)) for c in _strings(df)})


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def profile(df: DataFrame, columns: list[str], shown: int = 15) -> DataFrame:
    """(column, n_distinct, first_values): non-null distinct values, and the smallest of them as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.explode(pairs).alias("p")).select("p.column", "p.value").where("value IS NOT NULL").distinct()
    ranked = values.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    from pyspark.sql import Window

    first = values.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy("value"))).where(F.col("place") <= shown)
    lists = first.groupBy("column").agg(F.array_join(F.sort_array(F.collect_list("value")), "|").alias("first_values"))
    return ranked.join(lists, "column")


def column_kinds(df: DataFrame, categorical: list[str]) -> tuple[list[str], list[str]]:
    """Names of the categorical columns that exist, and of the other numeric ones."""
    some = [c for c in categorical if c in df.columns]
    return some, [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in some]


def entities(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids (a semi-join: repeated ids don't repeat rows)."""
    return df.join(ids.select(F.col(ids.columns[0]).alias("__id")), F.col(key) == F.col("__id"), "left_semi")


def entity_groups(df: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(entity, n_rows, complete) for groups (entity, id): complete says whether no id is missing."""
    wanted = groups.select("entity", F.col("id").alias("__id")).distinct()
    expected = wanted.groupBy("entity").agg(F.count(F.lit(1)).alias("__expected"))
    found = wanted.join(df, F.col("__id") == F.col(key))
    got = found.groupBy("entity").agg(F.countDistinct("__id").alias("__found"), F.count(F.lit(1)).alias("n_rows"))
    return expected.join(got, "entity", "left").select("entity", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), (F.coalesce("__found", F.lit(0)) == F.col("__expected")).alias("complete"))


def entity_group_rows(df: DataFrame, groups: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """The rows of groups (entity, id), each with its entity; strict: ValueError if a group has an id without a row.

    Rows stay rows, so a group of any size is no single value.
    """
    if key not in df.columns:
        raise ValueError(f"there is no column {key!r}")
    if strict:
        missing = [r[0] for r in entity_groups(df, groups, key).where(~F.col("complete")).select("entity").orderBy("entity").limit(5).collect()]
        if missing:
            raise ValueError(f"ids of these groups have no rows: {missing}")
    wanted = groups.select("entity", F.col("id").alias("__id")).distinct()
    return wanted.join(df, F.col("__id") == F.col(key)).drop("__id")
