"""Candidate values of columns: given ones matched by typed value, all others counted without a limit.

`candidates` gives, per column, operator and value, the rows that meet the condition. A given value is cast to the column's type, so 5.0 is 5 in
a column of whole numbers and of decimals alike; what can't be a value of the type counts in the domain's size, and is no candidate. Texts that stand for
null (NA, None, ...) are values of their own where the column has them as text; else they mean null.

`best` leaves those that any later stage can use: of each column and operator the first of every order that a stage ranks by.
It is exact whatever the number of values, and it is done in two steps, so no column is sorted in one task.
"""

from __future__ import annotations

import datetime
import decimal
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.conditions import normalized
from ..functions.scoring import MERGE_WEIGHT, VIOLATING, purity, ratio
from .candidates import SEEDS, SMALL_DOMAIN, typed

#: Parts of a column's values that are ranked on their own first.
PARTS = 64
#: Values of all columns that come to the driver unranked.
FEW = 1000
_SPAN = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def text_of(kind: T.DataType, column: Column) -> Column:
    """A value as text by which equal values are one: -0.0 is 0.0, and NaN is null."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        column = F.nanvl(column, F.lit(None).cast(kind)) + F.lit(0.0).cast(kind)
    return column.cast("string")


def as_type(kind: T.DataType, value: Any) -> Any:
    """The value of a column's type that equals a given one; None if there is none."""
    name = kind.simpleString()
    is_number = isinstance(value, (int, float, decimal.Decimal)) and value == value
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else None
    if isinstance(kind, T.BooleanType):
        return bool(value) if is_number and value in (0, 1) else None
    if name in _SPAN:
        return int(value) if is_number and abs(value) < 1 << 63 and value == int(value) and -(1 << _SPAN[name] - 1) <= value < 1 << _SPAN[name] - 1 else None
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return float(value) if is_number else None
    if isinstance(kind, T.DecimalType):
        if not is_number or abs(value) >= 10 ** (kind.precision - kind.scale):
            return None
        exact = decimal.Decimal(str(value))
        short = exact.quantize(decimal.Decimal(1).scaleb(-kind.scale))
        return short if short == exact else None
    try:
        if isinstance(kind, T.DateType):
            return value.date() if isinstance(value, datetime.datetime) else value if isinstance(value, datetime.date) else datetime.date.fromisoformat(str(value)[:10])
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(str(value))
    except ValueError:
        return None
    return value if isinstance(value, str) else None


def given_texts(spark: SparkSession, schema: T.StructType, given: dict[str, list]) -> dict[str, list[tuple[Any, str | None]]]:
    """(value, its text in the column's type; None if it can't occur) of given values other than null."""
    out: dict[str, list[tuple[Any, str | None]]] = {}
    for c, values in given.items():
        kind = schema[c].dataType
        cast = [as_type(kind, v) for v in values]
        fitting = [(i, v) for i, v in enumerate(cast) if v is not None]
        # a local table: Spark itself writes the values as it writes those of rows
        text = dict(spark.createDataFrame(fitting, T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", kind)])).select("i", text_of(kind, F.col("v"))).collect()) if fitting else {}
        out[c] = [(v, text.get(i)) for i, v in enumerate(values)]
    return out


def long_values(rows: DataFrame, columns: list[str], *kept: str) -> DataFrame:
    """(kept..., column, value) of every row and column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), text_of(rows.schema[c].dataType, F.col(f"`{c}`")).alias("value")) for c in columns])
    return rows.select(*kept, F.explode(pairs).alias("p")).select(*kept, "p.column", "p.value")


def side_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, sat, vio) of every value, null included."""
    counts = [F.count(F.when(~F.col(VIOLATING), 1)).alias("sat"), F.count(F.when(F.col(VIOLATING), 1)).alias("vio")]
    return long_values(rows, columns, VIOLATING).groupBy("column", "value").agg(*counts)


class Domains:
    """The domain of each column: given values, else all that occur, and special ones.

    `sizes` has the number of values of each domain, `listed` the values that must be candidates though no row has them.
    """

    def __init__(self, counts: DataFrame, schema: T.StructType, columns: list[str], given: dict[str, Iterable] | None = None, special: dict[str, Iterable] | None = None):
        """counts: (column, value, ...) of all values that occur, null included; it is read more than once."""
        spark = counts.sparkSession
        own = {c: list(dict.fromkeys(map(normalized_text, given[c]))) for c in columns if (given or {}).get(c) is not None}
        extra = {c: list(dict.fromkeys(map(normalized_text, special[c]))) for c in columns if (special or {}).get(c)}
        listed = {c: list(dict.fromkeys([*own.get(c, []), *extra.get(c, [])])) for c in {**own, **extra}}
        words = {c: [v for v in vs if isinstance(v, str) and normalized(v) is None] for c, vs in listed.items()}
        asked = [(c, v) for c, vs in words.items() for v in vs if isinstance(schema[c].dataType, T.StringType)]
        as_text = set()
        if asked:
            as_text = {tuple(r) for r in counts.join(spark.createDataFrame(asked, "column string, value string"), ["column", "value"], "left_semi").select("column", "value").collect()}
        settled = {c: list(dict.fromkeys(None if v is None or v in words[c] and (c, v) not in as_text else v for v in vs)) for c, vs in listed.items()}
        texts = given_texts(spark, schema, {c: [v for v in vs if v is not None] for c, vs in settled.items()})
        # values of two spellings are one
        self.literal = {c: {t: v for v, t in reversed(pairs) if t is not None} for c, pairs in texts.items()}
        self.impossible = {c: [v for v, t in pairs if t is None] for c, pairs in texts.items()}
        self.with_null = {c for c, vs in settled.items() if None in vs}
        self.open = [c for c in columns if c not in own]
        self.sizes = {c: len(self.literal.get(c, {})) + len(self.impossible.get(c, [])) + (c in self.with_null) for c in listed}
        if self.open:
            found = counts.where(F.col("column").isin(self.open) & F.col("value").isNotNull())
            also = [(c, t) for c in self.open for t in self.literal.get(c, {})]
            known = dict(found.groupBy("column").count().collect())
            there: dict[str, int] = {}
            if also:
                there = dict(found.join(spark.createDataFrame(also, "column string, value string"), ["column", "value"], "left_semi").groupBy("column").count().collect())
            for c in self.open:
                self.sizes[c] = known.get(c, 0) + self.sizes.get(c, 0) - there.get(c, 0)
        self.kinds = {c: schema[c].dataType.simpleString() for c in columns}
        self._listed = [(c, t) for c in listed for t in self.literal[c]] + [(c, None) for c in sorted(self.with_null)]

    def value(self, column: str, text: str | None) -> Any:
        """The literal of a candidate."""
        return self.literal.get(column, {}).get(text, typed(text, self.kinds[column])) if text is not None else None

    def candidates(self, counts: DataFrame) -> DataFrame:
        """counts of all candidates: listed values, with null counts where no row has them, and all other values of open columns."""
        listed = counts.sparkSession.createDataFrame(self._listed, "column string, value string")
        same = F.col("l.column").eqNullSafe(F.col("r.column")) & F.col("l.value").eqNullSafe(F.col("r.value"))
        out = listed.alias("l").join(counts.alias("r"), same, "left").select("l.column", "l.value", *[f"r.`{c}`" for c in counts.columns if c not in ("column", "value")])
        if self.open:
            free = counts.where(F.col("column").isin(self.open) & F.col("value").isNotNull())
            also = [x for x in self._listed if x[0] in self.open and x[1] is not None]
            out = out.unionByName(free.join(counts.sparkSession.createDataFrame(also, "column string, value string"), ["column", "value"], "left_anti") if also else free)
        return out


def normalized_text(value: Any) -> Any:
    """As `normalized`, but null words stay: rows may have them as text."""
    return value if isinstance(value, str) else normalized(value)


def scored(counts: DataFrame, sizes: dict[str, int], n_sat: int, n_vio: int, min_support: int) -> DataFrame:
    """(column, op, value, eq_sat, eq_vio, sat_matches, vio_matches, confidence, penalty, score) of = and !=, from (column, value, eq_sat, eq_vio, ne_sat, ne_vio).

    != only in domains of more than two values. Values without rows have null counts: no row equals them, all differ.
    """
    large = [c for c, n in sizes.items() if n > SMALL_DOMAIN]
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    all_ = lambda c, n: F.coalesce(F.col(c), F.lit(n)).cast("long")
    eq = F.struct(F.lit("=").alias("op"), zero("eq_sat").alias("sat_matches"), zero("eq_vio").alias("vio_matches"))
    ne = F.struct(F.lit("!=").alias("op"), all_("ne_sat", n_sat).alias("sat_matches"), all_("ne_vio", n_vio).alias("vio_matches"))
    both = counts.select("column", "value", zero("eq_sat").alias("eq_sat"), zero("eq_vio").alias("eq_vio"), F.explode(F.when(F.col("column").isin(large), F.array(eq, ne)).otherwise(F.array(eq))).alias("x"))
    x = both.select("column", "value", "eq_sat", "eq_vio", "x.*").withColumns({"confidence": ratio(F.col("sat_matches"), F.lit(n_sat)), "penalty": ratio(F.col("vio_matches"), F.lit(n_vio))})
    return x.withColumn("score", purity(F.col("confidence"), F.col("penalty"), F.col("sat_matches"), min_support))


def best(candidates: DataFrame, least: float, values: int, keep: int = SEEDS) -> DataFrame:
    """Of each column and operator the first `keep` with a score from `least` in each order that stages rank by; ties by the value's text.

    values: how many there are; FEW need no ranking here, as stages rank what they get.
    """
    if values <= FEW:
        return candidates.where(F.col("score") >= least)
    inf = F.col("confidence") - F.col("penalty")
    orders = [[F.desc("score"), F.desc("confidence")], [F.desc(inf)], [F.desc("confidence")], [F.desc(F.col("score") + F.lit(MERGE_WEIGHT) * inf), F.desc("confidence")]]
    out = candidates.where(F.col("score") >= least).withColumn("__part", F.pmod(F.xxhash64("value"), F.lit(PARTS)))
    for by in (["column", "op", "__part"], ["column", "op"]):
        for i, order in enumerate(orders):
            out = out.withColumn(f"__p{i}", F.row_number().over(Window.partitionBy(*by).orderBy(*order, F.col("value").asc_nulls_first())))
        out = out.where(F.least(*[F.col(f"__p{i}") for i in range(len(orders))]) <= keep)
    return out.drop("__part", *[f"__p{i}" for i in range(len(orders))])
