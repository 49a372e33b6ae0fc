"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

BASE = """WITH base AS (
  SELECT l.*, o.*, CAST(year(o_orderdate) AS INTEGER) AS o_year,
         CASE WHEN l_suppkey % 7 <> 0 THEN 'S' || CAST(l_suppkey % 5 AS VARCHAR) END AS supp_class,
         l_shipdate < o_orderdate AS vio
  FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey),
tot AS (SELECT CAST(count(*) FILTER (NOT vio) AS BIGINT) AS n_sat, CAST(count(*) FILTER (vio) AS BIGINT) AS n_vio FROM base)"""


def _score(sat: str, support: int) -> str:
    return f"""CASE WHEN {sat} < {support} OR confidence + penalty = 0 THEN 0.0 ELSE confidence / (confidence + penalty) END"""


def _metrics(keys: str, counts: str, support: int = 5, where: str = "TRUE") -> str:
    """counts: SELECT of keys, sat_matches, vio_matches."""
    k = f"{keys}, " if keys else ""
    return f"""{BASE}, cnt AS ({counts}),
m AS (SELECT {k}sat_matches, vio_matches, sat_matches / n_sat AS confidence, vio_matches / n_vio AS penalty FROM cnt, tot),
s AS (SELECT *, {_score('sat_matches', support)} AS score FROM m)
SELECT {k}CAST(sat_matches AS BIGINT) AS sat_matches, CAST(vio_matches AS BIGINT) AS vio_matches,
       round(confidence, 6) AS confidence, round(penalty, 6) AS penalty, round(CAST(score AS DOUBLE), 6) AS score FROM s WHERE {where}"""


CATEGORICAL = ["o_year", "l_returnflag", "l_linestatus", "o_orderpriority", "supp_class"]
NUMERIC = ["o_totalprice", "l_quantity", "l_discount"]


def _long(columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, vio FROM base" for c in columns)


_VALUES = f"SELECT \"column\", value, count(*) FILTER (NOT vio) AS sat, count(*) FILTER (vio) AS vio FROM ({_long(CATEGORICAL)}) GROUP BY 1, 2"
_EQ = f"SELECT \"column\", value, sat AS sat_matches, vio AS vio_matches FROM ({_VALUES}) WHERE value IS NOT NULL"
_NEQ = f"""SELECT "column", value, n_sat - sat AS sat_matches, n_vio - vio AS vio_matches FROM
(SELECT *, count(*) OVER (PARTITION BY "column") AS domain FROM ({_VALUES}) WHERE value IS NOT NULL), tot WHERE domain >= 3"""


def _named(conditions: dict[str, str], key: str = "name") -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS {key}, count(*) FILTER (NOT vio AND ({c})) AS sat_matches, count(*) FILTER (vio AND ({c})) AS vio_matches FROM base" for n, c in conditions.items())


_POOL = ["o_year = 1995", "o_year = 1996", "l_returnflag = 'R'", "l_linestatus = 'O'", "supp_class IS DISTINCT FROM 'S1'", "o_totalprice < 150000"]
_POOL_COLUMNS = ["o_year", "o_year", "l_returnflag", "l_linestatus", "supp_class", "o_totalprice"]


def _sets(size: int) -> str:
    from itertools import combinations

    chosen = {",".join(map(str, ids)): " AND ".join(f"({_POOL[i]})" for i in ids) for ids in combinations(range(len(_POOL)), size) if len({_POOL_COLUMNS[i] for i in ids}) == size}
    # only sets that occur are listed; a triple needs a first pair with the support
    return _metrics("ids", f"SELECT * FROM ({_named(chosen, 'ids')}) WHERE sat_matches + vio_matches > 0")


_E = "CASE WHEN {p} > 0 AND {p} < 1 THEN -{p} * log2({p}) - (1 - {p}) * log2(1 - {p}) ELSE 0 END"


def _entropy(p: str) -> str:
    return _E.format(p=f"({p})")


def _split_ctes(columns: list[str], source: str) -> str:
    """CTEs up to `best`: the 20 best splits of each number."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS value, vio FROM {source}" for c in columns)
    return f"""vals AS (SELECT "column", value, count(*) AS n, count(*) FILTER (vio) AS v FROM ({long}) WHERE value IS NOT NULL GROUP BY 1, 2),
cum AS (SELECT "column", value, lead(value) OVER w AS nxt, sum(n) OVER (w ROWS UNBOUNDED PRECEDING) AS nl, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS vl,
  sum(n) OVER (PARTITION BY "column") AS na, sum(v) OVER (PARTITION BY "column") AS va FROM vals WINDOW w AS (PARTITION BY "column" ORDER BY value)),
g AS (SELECT *, (value + nxt) / 2 AS split_value, {_entropy('va / na')} - nl / na * ({_entropy('vl / nl')}) - (na - nl) / na * ({_entropy('(va - vl) / (na - nl)')}) AS gain FROM cum WHERE nxt IS NOT NULL),
best AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY round(gain, 10) DESC, split_value) AS rank FROM g WHERE gain > 1e-12 QUALIFY rank <= 20)"""


_SPLITS = f"{BASE}, {_split_ctes(NUMERIC, 'base')}"

_SIDES = ", ".join(
    f"round({c}, 6) AS {n}_confidence, round({p}, 6) AS {n}_penalty, round(CASE WHEN {s} < 10 OR {c} + {p} = 0 THEN 0.0 ELSE {c} / ({c} + {p}) END, 6) AS {n}_score"
    for n, c, p, s in (("lt", "((nl - vl) / (na - va))", "(vl / va)", "(nl - vl)"), ("gte", "(1 - (nl - vl) / (na - va))", "(1 - vl / va)", "(na - va - nl + vl)"))
)

SAMPLES = """WITH bad AS (SELECT l_orderkey, bool_or(n > 1) AS vio FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1),
smp AS (SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, l_linestatus AS role, lineitem.*, vio,
  row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS row_id,
  CASE WHEN l_suppkey % 7 <> 0 THEN l_suppkey % 5 END AS supp
  FROM lineitem JOIN bad USING (l_orderkey))"""
_RESIDUAL = {"between_groups": "a.role <> b.role", "within_groups": "a.role = b.role AND a.row_id < b.row_id", "all_combinations": "a.row_id < b.row_id"}
_PAIR = ["{x}.l_returnflag = 'R'", "{x}.l_quantity >= 25", "{x}.l_returnflag <> 'A'"]


def _pair_total(pattern: str) -> str:
    return f"{SAMPLES} SELECT CAST(count(*) AS BIGINT) AS pairs FROM smp a JOIN smp b USING (sample_id) WHERE {_RESIDUAL[pattern]}"


def _both(pattern: str, i: int, where: str = "TRUE") -> str:
    c = _PAIR[i]
    return f"FROM smp a JOIN smp b USING (sample_id) WHERE {_RESIDUAL[pattern]} AND {c.format(x='a')} AND {c.format(x='b')} AND {where}"


def _pairwise(op: str) -> str:
    parts = [f"SELECT '{p}' AS pattern, '{c}' AS \"column\", CAST(count(*) FILTER (a.{c} {op} b.{c}) AS BIGINT) AS pairs FROM smp a JOIN smp b USING (sample_id) WHERE {r}" for p, r in _RESIDUAL.items() for c in ("l_returnflag", "supp")]
    return f"{SAMPLES} {' UNION ALL '.join(parts)}"


_SCORED = f"""{BASE}, cnt AS (SELECT '=' AS op, * FROM ({_EQ}) UNION ALL SELECT '!=' AS op, * FROM ({_NEQ})),
m AS (SELECT "column" || ':' || op AS signature, "column" || ' ' || op || ' ' || value AS expr, sat_matches, vio_matches, sat_matches / n_sat AS confidence, vio_matches / n_vio AS penalty FROM cnt, tot),
s AS (SELECT *, CAST({_score('sat_matches', 5)} AS DOUBLE) AS score FROM m),
kept AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY signature ORDER BY round(score + 0.3 * (confidence - penalty), 10) DESC, round(confidence, 10) DESC, expr) <= 2)"""

CUSTOMERS = """WITH cust AS (SELECT c_custkey AS row_id, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS nation, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal END AS balance FROM customer)"""
_SPOT = "(row_id * 2654435761) % 4294967296"

_RARITY = f"""{CUSTOMERS}, ends AS (SELECT min(balance) AS low, max(balance) AS high FROM cust),
long AS (SELECT row_id, 'c:m' AS c, c_mktsegment AS v FROM cust UNION ALL SELECT row_id, 'c:n', nation FROM cust UNION ALL
  SELECT row_id, 'n:b', CAST(CASE WHEN balance IS NULL THEN NULL WHEN high = low THEN 1 ELSE least(greatest(ceil((balance - low) / (high - low) * 10), 1), 10) END AS VARCHAR) FROM cust, ends),
freq AS (SELECT c, v, 1.0 / count(*) AS weight FROM long WHERE v IS NOT NULL GROUP BY 1, 2),
rar AS (SELECT row_id, coalesce(sum(weight), 0.0) AS score FROM long LEFT JOIN freq USING (c, v) GROUP BY 1)"""

_INFORMATIVE = f"""{CUSTOMERS}, q AS (SELECT quantile_cont(balance, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM cust),
grp AS (SELECT row_id, 'm' || c_mktsegment AS g FROM cust UNION ALL SELECT row_id, 'n' || nation FROM cust
  UNION ALL SELECT row_id, 'q' || CAST(CASE WHEN balance <= e[2] THEN 1 WHEN balance <= e[3] THEN 2 WHEN balance <= e[4] THEN 3 ELSE 4 END AS VARCHAR) FROM cust, q WHERE balance IS NOT NULL
  UNION ALL SELECT row_id, 'z' || CAST(balance IS NULL AS VARCHAR) FROM cust),
must AS (SELECT DISTINCT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY g ORDER BY {_SPOT}, row_id) AS r FROM grp) WHERE r <= 2)
SELECT row_id FROM cust LEFT JOIN (SELECT row_id, TRUE AS is_must FROM must) USING (row_id) ORDER BY is_must IS NULL, {_SPOT}, row_id LIMIT 60"""

_HIER = f"""{_RARITY}, cand AS (SELECT CAST(c_custkey % 40 AS VARCHAR) AS group_key, CASE WHEN c_acctbal > 4500 THEN 'high' ELSE 'low' END AS role, c_custkey AS row_id FROM customer),
x AS (SELECT cand.*, round(coalesce(score, 0), 8) AS sc FROM cand LEFT JOIN rar USING (row_id)),
y AS (SELECT *, count(*) OVER (PARTITION BY group_key) AS unit_rows, count(*) OVER () AS all_rows, row_number() OVER (PARTITION BY group_key, role ORDER BY sc DESC, row_id) AS role_place FROM x),
r AS (SELECT group_key, count(DISTINCT role) AS roles FROM cand GROUP BY 1),
z AS (SELECT y.*, least(unit_rows, greatest(roles, floor(unit_rows * 300 / all_rows))) AS budget, row_number() OVER (PARTITION BY group_key ORDER BY (role_place <= 1) DESC, sc DESC, row_id) AS unit_place FROM y JOIN r USING (group_key))
SELECT group_key, role, row_id FROM z WHERE role_place <= 1 OR unit_place <= budget ORDER BY sc DESC, group_key, role, row_id LIMIT 300"""


def _rank_bins(c: str) -> str:
    """Bins over distinct edges: the number of distinct edges below the value, at least 1."""
    return f"""SELECT '{c}' AS "column", CAST(greatest(len([x for x in list_distinct(e) if x < {c}]), 1) AS VARCHAR) AS value, vio FROM base, (SELECT quantile_cont(CAST({c} AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM base) WHERE len(list_distinct(e)) > 1"""


_VALID = "avg(CASE WHEN vio THEN 0.0 ELSE 1.0 END)"
_CAT = f'SELECT "column", value, {_VALID} AS valid, count(*) AS n FROM ({_long(CATEGORICAL)}) WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10'
_NUM = f'SELECT "column", value, {_VALID} AS valid, count(*) AS n FROM ({" UNION ALL ".join(map(_rank_bins, NUMERIC))}) WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10'

_GAINS = f"""{BASE}, v AS (SELECT "column", value, sat + vio AS n_in, vio AS v_in FROM ({_VALUES})),
t AS (SELECT *, n_sat + n_vio AS na, n_vio AS va FROM v, tot)
SELECT "column", coalesce(value, '<null>') AS value, round({_entropy('va / na')} - n_in / na * ({_entropy('v_in / n_in')}) - CASE WHEN na > n_in THEN (na - n_in) / na * ({_entropy('(va - v_in) / (na - n_in)')}) ELSE 0 END, 8) AS gain, CAST(n_in AS BIGINT) AS n_in, CAST(v_in AS BIGINT) AS v_in FROM t"""


def _wracc(values: str) -> str:
    return f"""{BASE}, v AS (SELECT * FROM ({values}) WHERE value IS NOT NULL),
w AS (SELECT "column", value, sat, vio, (sat + vio) / (n_sat + n_vio) * (sat / (sat + vio) - n_sat / (n_sat + n_vio)) AS wracc, sat / n_sat AS confidence, vio / n_vio AS penalty FROM v, tot)"""


_LEVEL = _long(["l_returnflag", "l_linestatus", "o_orderpriority", "supp_class"])
_VALUES1 = f"SELECT \"column\", value, count(*) FILTER (NOT vio) AS sat, count(*) FILTER (vio) AS vio FROM ({_LEVEL}) GROUP BY 1, 2"


def _flags(units: str) -> str:
    return f"SELECT CAST(count(*) AS BIGINT) AS units, CAST(count(*) FILTER (bad) AS BIGINT) AS violating FROM ({units})"


def _interval(column: str) -> tuple[str, str]:
    """Sentences of an interval's two ends."""
    side = lambda words, x: f"'the \"{column}\" column is {words}: ' || CAST({x} AS VARCHAR)"
    return side("greater than or equal to", "low"), side("less than", "high")


def _selectors(columns: list[str], numeric: list[str] = ("l_quantity",), base: str = "", rows: str = "base") -> str:
    """(rid, vio, col, parts) of the selectors that each row meets: values, and intervals of numbers between fifths."""
    values = " UNION ALL ".join(f"SELECT rid, vio, '{c}' AS col, ['the \"{c}\" column has the value of: ' || CAST({c} AS VARCHAR)] AS parts FROM numbered WHERE {c} IS NOT NULL" for c in columns)
    bins = " UNION ALL ".join(f"SELECT '{c}' AS col, e[i] AS low, e[i + 1] AS high, list_filter([{', '.join(_interval(c))}], lambda x: x IS NOT NULL) AS parts FROM (SELECT e, unnest(range(0, len(e) + 1)) AS i FROM (SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [0.2, 0.4, 0.6, 0.8]))) AS e FROM {rows}))" for c in numeric)
    numbers = " UNION ALL ".join(f"SELECT rid, vio, '{c}', parts FROM numbered JOIN bins ON col = '{c}' AND coalesce({c} >= low, TRUE) AND coalesce({c} < high, TRUE)" for c in numeric)
    return f"""{base or BASE}, numbered AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM {rows}),
bins AS MATERIALIZED ({bins}),
met AS MATERIALIZED ({values} UNION ALL {numbers})"""


_COUNTS = "count(*) FILTER (NOT {x}vio) AS sat, count(*) FILTER ({x}vio) AS bad"
_RELATIVE = "(sat + bad) / (n_sat + n_vio) * (sat / (sat + bad) - n_sat / (n_sat + n_vio)) AS wracc, sat / n_sat AS confidence, bad / n_vio AS penalty"
_RULES = """SELECT CAST(row_number() OVER (ORDER BY round(score, 10) DESC, confidence DESC, expr) AS INTEGER) AS place, CASE WHEN len(parts) > 1 THEN 'Conjunction' WHEN parts[1] LIKE '% value of: %' THEN 'ColumnValue' ELSE 'Numerical' END AS kind,
  expr, array_to_string(list_sort(list_distinct(cols)), ',') AS columns, CAST(sat AS BIGINT) AS sat_matches, CAST(bad AS BIGINT) AS vio_matches, confidence, penalty, score
FROM (SELECT *, CAST(CASE WHEN sat < 5 OR confidence + penalty = 0 THEN 0.0 ELSE confidence / (confidence + penalty) END AS DOUBLE) AS score, array_to_string(parts, ' AND ') AS expr FROM {found})"""

def _beam(selectors: str, shown: str = "{parts}", columns: str = "cols") -> str:
    """Three levels of a beam of 20: selectors, then pairs and triples on different columns with one selector less in the beam. shown: how a description is written at last."""
    best = "ORDER BY round(wracc, 10) DESC, parts LIMIT 20"
    return f"""{selectors},
one AS MATERIALIZED (SELECT *, {_RELATIVE} FROM (SELECT [col] AS cols, parts, [parts] AS sels, {_COUNTS.format(x="")} FROM met GROUP BY ALL), tot),
first AS MATERIALIZED (SELECT sels FROM one {best}),
two AS MATERIALIZED (SELECT *, {_RELATIVE} FROM (SELECT [a.col, b.col] AS cols, list_sort(list_concat(a.parts, b.parts)) AS parts, [a.parts, b.parts] AS sels, {_COUNTS.format(x="a.")}
  FROM met a JOIN met b ON a.rid = b.rid AND a.col < b.col WHERE [a.parts] IN (SELECT sels FROM first) OR [b.parts] IN (SELECT sels FROM first) GROUP BY ALL), tot),
second AS MATERIALIZED (SELECT * FROM (SELECT cols, parts, sels, wracc FROM one UNION ALL SELECT cols, parts, sels, wracc FROM two) {best}),
three AS MATERIALIZED (SELECT *, {_RELATIVE} FROM (SELECT list_sort(list_append(cols, c.col)) AS cols, list_sort(list_concat(s.parts, c.parts)) AS parts, [] AS sels, count(DISTINCT a.rid) FILTER (NOT a.vio) AS sat, count(DISTINCT a.rid) FILTER (a.vio) AS bad
  FROM second s JOIN met a ON a.parts = s.sels[1] JOIN met b ON b.rid = a.rid AND b.parts = s.sels[2] JOIN met c ON c.rid = a.rid AND NOT list_contains(s.cols, c.col) WHERE len(s.sels) = 2 GROUP BY ALL), tot),
every AS (SELECT {columns} AS cols, {shown.format(parts="parts")} AS parts, sat, bad, wracc, confidence, penalty, parts AS raw FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three)),
top AS (SELECT cols, parts, sat, bad, wracc, confidence, penalty FROM every ORDER BY round(wracc, 10) DESC, array_to_string(raw, ' AND ') LIMIT 20)
{_RULES.format(found="top")}"""


_BEAM = _beam(_selectors(CATEGORICAL, NUMERIC))
#: Rows of a sample in both orders with their roles apart, as columns with _1 and _2.
_PAIR_COLUMNS, _PAIR_NUMBERS = ["l_returnflag", "supp"], ["l_quantity", "l_discount"]
_TWO = ", ".join(f"{x}.{c} AS {c}_{i}" for c in (*_PAIR_COLUMNS, *_PAIR_NUMBERS) for i, x in ((1, "a"), (2, "b")))
_BY_SUM = SAMPLES.replace(SAMPLES[SAMPLES.index("(SELECT l_orderkey, bool_or") : SAMPLES.index(",\nsmp")], "(SELECT l_orderkey, sum(l_quantity) > 150 AS vio FROM lineitem GROUP BY 1)")
_PAIRS = f"""{_BY_SUM}, with_supp AS MATERIALIZED (SELECT * REPLACE ('S' || CAST(l_suppkey % 5 AS VARCHAR) AS supp) FROM smp),
base AS MATERIALIZED (SELECT a.vio AS vio, {_TWO} FROM with_supp a JOIN with_supp b USING (sample_id) WHERE {_RESIDUAL['between_groups']}),
tot AS (SELECT CAST(count(*) FILTER (NOT vio) AS BIGINT) AS n_sat, CAST(count(*) FILTER (vio) AS BIGINT) AS n_vio FROM base)"""
_sides = lambda names: [f"{c}_{i}" for c in names for i in (1, 2)]
#: Conditions on either row of a pair, said of rows; what becomes equal is said once.
_OF_ROWS = "list_sort(list_distinct(list_transform({parts}, lambda x: regexp_replace(x, '_[12]\" column', '\" column'))))"
_OF_ROW_COLUMNS = "list_sort(list_distinct(list_transform(cols, lambda x: regexp_replace(x, '_[12]$', ''))))"


def _tree(depth: int = 3, leaf: int = 5, base: str = BASE, categorical: list[str] = CATEGORICAL, numeric: list[str] = NUMERIC, shown: str = "{parts}", columns: str = "cols") -> str:
    """An entropy tree, a level at a time: rows carry their path, and a level picks the best split of each path."""
    number = "CASE col " + " ".join(f"WHEN '{c}' THEN coalesce(CAST({c} AS DOUBLE), 0)" for c in numeric) + " END"
    text = "CASE col " + " ".join(f"WHEN '{c}' THEN CAST({c} AS VARCHAR)" for c in categorical) + " END"
    gain = f"{_entropy('va / na')} - nl / na * ({_entropy('vl / nl')}) - CASE WHEN na > nl THEN (na - nl) / na * ({_entropy('(va - vl) / (na - nl)')}) ELSE 0 END AS gain"
    steps = [f"{base}, t0 AS MATERIALIZED (SELECT *, CAST([] AS VARCHAR[]) AS parts, CAST([] AS VARCHAR[]) AS cols FROM base)"]
    for i in range(depth):
        numbers = " UNION ALL ".join(f"SELECT parts, '{c}' AS col, coalesce(CAST({c} AS DOUBLE), 0) AS value, vio FROM t{i}" for c in numeric)
        texts = " UNION ALL ".join(f"SELECT parts, '{c}' AS col, CAST({c} AS VARCHAR) AS value, vio FROM t{i}" for c in categorical)
        counted = "SELECT parts, col, value, count(*) AS n, count(*) FILTER (vio) AS v FROM ({}) GROUP BY ALL"
        steps.append(f"""open{i} AS MATERIALIZED (SELECT parts, count(*) AS na, count(*) FILTER (vio) AS va FROM t{i} WHERE len(parts) = {i} GROUP BY parts HAVING count(*) >= {2 * leaf} AND bool_or(vio) AND bool_or(NOT vio)),
num{i} AS (SELECT parts, col, value, lead(value) OVER o AS nxt, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS nl, sum(v) OVER (o ROWS UNBOUNDED PRECEDING) AS vl FROM ({counted.format(numbers)}) WINDOW o AS (PARTITION BY parts, col ORDER BY value)),
cut{i} AS (SELECT parts, col, (value + nxt) / 2 AS cut, na, nl, {gain} FROM num{i} JOIN open{i} USING (parts) WHERE nxt IS NOT NULL),
best{i} AS (SELECT * FROM cut{i} WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY parts, col ORDER BY round(gain, 10) DESC, cut) = 1),
txt{i} AS (SELECT parts, col, value, na, nl, {gain} FROM (SELECT parts, col, value, n AS nl, v AS vl, na, va FROM ({counted.format(texts)}) JOIN open{i} USING (parts))),
val{i} AS (SELECT * FROM txt{i} WHERE gain > 1e-12 AND nl >= {leaf} AND na - nl >= {leaf} QUALIFY row_number() OVER (PARTITION BY parts ORDER BY round(gain, 10) DESC, col, value NULLS FIRST) = 1),
pick{i} AS MATERIALIZED (SELECT * FROM (SELECT parts, col, cut, CAST(NULL AS VARCHAR) AS value, gain FROM best{i} WHERE nl >= {leaf} AND na - nl >= {leaf} UNION ALL SELECT parts, col, NULL, value, gain FROM val{i}) QUALIFY row_number() OVER (PARTITION BY parts ORDER BY round(gain, 10) DESC, col) = 1),
t{i + 1} AS MATERIALIZED (SELECT * EXCLUDE (parts, cols, col, cut, value, gain), CASE WHEN col IS NULL THEN cols ELSE list_append(cols, col) END AS cols,
  CASE WHEN col IS NULL THEN parts ELSE list_sort(list_append(parts, 'the "' || col || '" column ' || CASE WHEN cut IS NOT NULL THEN CASE WHEN {number} < cut THEN 'is less than: ' ELSE 'is greater than or equal to: ' END || CAST(cut AS VARCHAR)
    ELSE CASE WHEN {text} IS NOT DISTINCT FROM value THEN 'has the value of: ' ELSE 'does not have the value of: ' END || coalesce(value, 'None') END)) END AS parts
  FROM t{i} LEFT JOIN pick{i} USING (parts))""")
    leaves = f"(SELECT *, sat / n_sat AS confidence, bad / n_vio AS penalty FROM (SELECT {shown.format(parts='parts')} AS parts, {columns} AS cols, sat, bad FROM (SELECT parts, any_value(cols) AS cols, {_COUNTS.format(x='')} FROM t{depth} WHERE len(parts) > 0 GROUP BY parts)), tot WHERE sat > bad)"
    return ",\n".join(steps) + "\n" + _RULES.format(found=leaves)


def _mined(categorical: list[str], groups: list[str] | None) -> str:
    """CTEs up to `ranked`: the single-row miner's list. groups None: no numbers and no conjunctions.

    The pool of conjunctions is that of the seeds and of the columns in groups, which holds the pool of the seeds alone.
    A condition is a string of bits, one a row, and conjunctions are counted from bits.
    """
    text = lambda side: f"'the \"' || col || '\" column {side}: ' || "
    listed = "CASE WHEN col = 'o_year' THEN '[' || array_to_string(list_sort(vals), ', ') || ']' ELSE '[''' || array_to_string(list_sort(vals), ''', ''') || ''']' END"
    unions = []
    for names in ("ab", "abc", "abcd"):
        on = " ".join(f"JOIN ranked_atoms {n} ON {n}.col = a.col AND {n}.op = a.op AND {p}.m < {n}.m" for p, n in zip(names, names[1:], strict=False))
        unions.append(f"SELECT a.col, a.op, [{', '.join(f'{n}.vals[1]' for n in names)}] AS vals, {' + '.join(f'{n}.one' for n in names)} AS one, {' + '.join(f'{n}.two' for n in names)} AS two FROM ranked_atoms a {on}")
    score = "CAST(CASE WHEN sat < 5 OR confidence + penalty = 0 THEN 0.0 ELSE confidence / (confidence + penalty) END AS DOUBLE) AS score"
    scored = lambda rows: f"SELECT *, {score} FROM (SELECT *, sat / n_sat AS confidence, bad / n_vio AS penalty FROM ({rows}), tot)"
    sides = "CASE WHEN op = '=' THEN one ELSE n_sat - one END AS sat, CASE WHEN op = '=' THEN two ELSE n_vio - two END AS bad"
    values = f"SELECT 'ColumnValue' AS kind, col, op, [value] AS vals, NULL::DOUBLE AS cut, CASE op WHEN '=' THEN {text('has the value of')}value ELSE {text('does not have the value of')}value END AS expr, one, two, {sides} FROM counted, (SELECT unnest(['=', '!=']) AS op), tot WHERE op = '=' OR size > 2"
    sets = f"SELECT 'MergedValues' AS kind, col, op, vals, NULL::DOUBLE AS cut, CASE op WHEN '=' THEN {text('value is in the set')}{listed} ELSE {text('value is not in the set')}{listed} END AS expr, {sides} FROM sets, tot WHERE size - k > 1 AND (k < size - k OR op = '=' AND k = size - k)"
    ctes = [
        f"{_SPLITS if groups is not None else BASE}",
        f'counted AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY col) AS size FROM (SELECT "column" AS col, value, count(*) FILTER (NOT vio) AS one, count(*) FILTER (vio) AS two FROM ({_long(categorical)}) WHERE value IS NOT NULL GROUP BY ALL))',
        f"atom AS MATERIALIZED ({scored(values)})",
        "ranked_atoms AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY col, op ORDER BY score + 0.3 * (confidence - penalty) DESC, confidence DESC, expr) AS m FROM atom WHERE score > 0.5 QUALIFY m <= 10)",
        f"sets AS (SELECT s.*, size, len(vals) AS k FROM ({' UNION ALL '.join(unions)}) s JOIN (SELECT DISTINCT col, size FROM counted) USING (col))",
        f"merged AS MATERIALIZED (SELECT * FROM ({scored(sets)}) WHERE score > 0.5)",
    ]
    names = "kind, col, op, vals, cut, expr, sat, bad, confidence, penalty, score"
    found = f"SELECT {names} FROM atom WHERE score > 0.53 UNION ALL SELECT {names} FROM merged"
    if groups is not None:
        number = f"SELECT 'Numerical' AS kind, col, u.op AS op, []::VARCHAR[] AS vals, cut, CASE u.op WHEN '<' THEN {text('is less than')}CAST(cut AS VARCHAR) ELSE {text('is greater than or equal to')}CAST(cut AS VARCHAR) END AS expr, u.sat AS sat, u.bad AS bad FROM split"
        orders = ("score DESC, confidence DESC, expr", "confidence - penalty DESC, expr", "confidence DESC, expr")
        chosen = [f"row_number() OVER (ORDER BY {o}) <= 25" for o in orders]
        chosen += [f"col = '{c}' AND row_number() OVER (PARTITION BY col ORDER BY {o}) <= 25" for c in groups for o in orders[:2]]
        texts = " UNION ALL ".join(f"SELECT rid, '{c}' AS col, CAST({c} AS VARCHAR) AS value, NULL::DOUBLE AS x FROM numbered" for c in categorical)
        numbers = " UNION ALL ".join(f"SELECT rid, '{c}', NULL, CAST({c} AS DOUBLE) FROM numbered" for c in NUMERIC)
        meets = "CASE WHEN cut IS NULL THEN coalesce(list_contains(vals, value), FALSE) = (op = '=') ELSE coalesce((x < cut) = (op = '<'), FALSE) END"
        counts = "SELECT cols, parts, bit_count(b & s) AS sat, bit_count(b) - bit_count(b & s) AS bad FROM (SELECT cols, parts, b, s FROM pairs UNION ALL SELECT * FROM triples)"
        ctes += [
            "split AS (SELECT \"column\" AS col, split_value AS cut, unnest([{'op': '<', 'sat': nl - vl, 'bad': vl}, {'op': '>=', 'sat': na - va - nl + vl, 'bad': va - vl}]) AS u FROM best)",
            f"number AS MATERIALIZED ({scored(number)})",
            f"parents AS (SELECT * FROM ({' UNION ALL '.join(f'SELECT {names} FROM {t}' for t in ('atom', 'merged', 'number'))}) WHERE score > 0.4)",
            f"pool AS MATERIALIZED (SELECT col, op, vals, cut, expr FROM parents QUALIFY {' OR '.join(chosen)})",
            "numbered AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM base)",
            "satisfying AS MATERIALIZED (SELECT CAST(string_agg(CASE WHEN vio THEN '0' ELSE '1' END, '' ORDER BY rid) AS BIT) AS s FROM numbered)",
            f"bits AS MATERIALIZED (SELECT row_number() OVER (ORDER BY expr) AS i, col, expr, CAST(b AS BIT) AS b FROM (SELECT col, expr, string_agg(CASE WHEN {meets} THEN '1' ELSE '0' END, '' ORDER BY rid) AS b FROM ({texts} UNION ALL {numbers}) JOIN pool USING (col) GROUP BY col, expr))",
            "pairs AS MATERIALIZED (SELECT * FROM (SELECT y.i, [x.col, y.col] AS cols, [x.expr, y.expr] AS parts, x.b & y.b AS b FROM bits x JOIN bits y ON x.i < y.i AND x.col <> y.col), satisfying WHERE bit_count(b & s) >= 5)",
            "triples AS (SELECT list_append(cols, col), list_append(parts, expr), p.b & z.b, s FROM pairs p JOIN bits z ON p.i < z.i AND NOT list_contains(cols, col))",
            f"conjunctions AS ({scored(counts)})",
        ]
        found += f" UNION ALL SELECT {names} FROM number WHERE score > 0.5"
        found += " UNION ALL SELECT 'Conjunction', array_to_string(list_sort(cols), ','), 'and', NULL, NULL, array_to_string(parts, ' AND '), sat, bad, confidence, penalty, score FROM conjunctions WHERE score > 0.5"
    order = "round(score + {} * (confidence - penalty), 10) DESC, round(confidence, 10) DESC, expr"
    ctes.append(f"ranked AS (SELECT *, row_number() OVER (ORDER BY {order.format(0.4)}) AS place FROM (SELECT * FROM ({found}) QUALIFY row_number() OVER (PARTITION BY kind, col, op ORDER BY {order.format(0.3)}) <= 2))")
    return ",\n".join(ctes)


def _single(groups: list[str]) -> str:
    return f"{_mined(CATEGORICAL, groups)} SELECT CAST(place AS INTEGER) AS place, kind, expr, col AS columns, CAST(sat AS BIGINT) AS sat_matches, CAST(bad AS BIGINT) AS vio_matches, confidence, penalty, score FROM ranked"


def _multi(pattern: str | None, identifiers: tuple[str, ...] = ()) -> str:
    """The multi-row miner: a condition is bits over satisfying rows and bits over violating pairs (None: whole samples), and conjunctions are counted from both."""
    categorical, numeric = ["l_returnflag", "supp"], ["l_quantity"]
    text = lambda side: f"'the \"' || col || '\" column {side}: ' || "
    listed = "'[''' || array_to_string(list_sort(vals), ''', ''') || ''']'"
    values = " UNION ALL ".join(f"SELECT rid, vio, '{c}' AS col, {c} AS value, NULL::DOUBLE AS x FROM items" for c in categorical if c not in identifiers)
    numbers = " UNION ALL ".join(f"SELECT rid, vio, '{c}', NULL, CAST({c} AS DOUBLE) FROM items" for c in numeric)
    meets = "CASE WHEN cut IS NULL THEN coalesce(list_contains(vals, value), FALSE) = (op = '=') ELSE coalesce((x < cut) = (op = '<'), FALSE) END"
    units = "SELECT sample_id AS u, rid FROM items WHERE vio"
    if pattern:
        pairs = f"SELECT a.rid AS one, b.rid AS two FROM items a JOIN items b USING (sample_id) WHERE a.vio AND {_RESIDUAL[pattern]}"
        units = f"SELECT one || '-' || two AS u, unnest([one, two]) AS rid FROM ({pairs})"
    bits = lambda x, by: f"CAST(string_agg(CASE WHEN {x} THEN '1' ELSE '0' END, '' ORDER BY {by}) AS BIT)"
    score = "CAST(CASE WHEN sat < 10 OR confidence + penalty = 0 THEN 0.0 ELSE confidence / (confidence + penalty) END AS DOUBLE) AS score"
    scored = lambda rows, whole="n_sat": f"SELECT *, {score} FROM (SELECT *, sat / {whole} AS confidence, bad / n_vio AS penalty FROM ({rows}), sizes)"
    counted = lambda conditions: scored(
        f"""SELECT c.*, sb, vb, bit_count(sb) AS sat, bit_count(vb) AS bad FROM {conditions} c
  JOIN (SELECT expr, {bits(meets, 'rid')} AS sb FROM {conditions} JOIN cells USING (col) WHERE NOT vio GROUP BY expr) USING (expr)
  JOIN (SELECT expr, {bits('hit', 'u')} AS vb FROM (SELECT expr, u, bool_and({meets}) AS hit FROM {conditions} JOIN cells USING (col) JOIN units USING (rid) GROUP BY expr, u) GROUP BY expr) USING (expr)"""
    )
    unions = []
    for names in ("ab", "abc", "abcd"):
        on = " ".join(f"JOIN tops {n} ON {n}.col = a.col AND {n}.op = a.op AND {p}.m < {n}.m" for p, n in zip(names, names[1:], strict=False))
        unions.append(f"SELECT a.col, a.op, [{', '.join(f'{n}.vals[1]' for n in names)}] AS vals FROM tops a {on}")
    names = "kind, col, op, expr, sat, bad, confidence, penalty, score"
    seeds = " OR ".join(f"row_number() OVER (ORDER BY {o}, expr) <= 25" for o in ("score DESC, confidence DESC", "confidence - penalty DESC", "confidence DESC"))
    order = "round(score + {} * (confidence - penalty), 10) DESC, round(confidence, 10) DESC, expr"
    found = f"SELECT {names} FROM single WHERE score > 0.53 UNION ALL SELECT {names} FROM merged WHERE score > 0.53"
    found += " UNION ALL SELECT 'Conjunction', array_to_string(list_sort(cols), ','), 'and', array_to_string(parts, ' AND '), sat, bad, confidence, penalty, score FROM conjunctions WHERE sat >= 10 AND score > 0.53"
    ctes = [
        SAMPLES,
        "items AS MATERIALIZED (SELECT row_number() OVER () AS rid, sample_id, role, row_id, vio, l_returnflag, 'S' || CAST(l_suppkey % 5 AS VARCHAR) AS supp, l_quantity FROM smp)",
        f"cells AS MATERIALIZED ({values} UNION ALL {numbers})",
        f"units AS MATERIALIZED ({units})",
        "sizes AS MATERIALIZED (SELECT (SELECT count(*) FROM items WHERE NOT vio) AS n_sat, (SELECT count(DISTINCT u) FROM units) AS n_vio)",
        _split_ctes(numeric, "items"),
        "domain AS (SELECT *, count(*) OVER (PARTITION BY col) AS size FROM (SELECT DISTINCT col, value FROM cells WHERE value IS NOT NULL))",
        f"""listed AS MATERIALIZED (SELECT 'ColumnValue' AS kind, col, op, [value] AS vals, NULL::DOUBLE AS cut, CASE op WHEN '=' THEN {text('has the value of')}value ELSE {text('does not have the value of')}value END AS expr FROM domain, (SELECT unnest(['=', '!=']) AS op) WHERE op = '=' OR size > 2
  UNION ALL SELECT 'Numerical', col, op, [], cut, CASE op WHEN '<' THEN {text('is less than')}CAST(cut AS VARCHAR) ELSE {text('is greater than or equal to')}CAST(cut AS VARCHAR) END FROM (SELECT "column" AS col, split_value AS cut, unnest(['<', '>=']) AS op FROM best))""",
        f"single AS MATERIALIZED ({counted('listed')})",
        "tops AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY col, op ORDER BY score + 0.3 * (confidence - penalty) DESC, confidence DESC, expr) AS m FROM single WHERE kind = 'ColumnValue' AND score >= 0.53 QUALIFY m <= 12)",
        f"sets AS MATERIALIZED (SELECT 'MergedValues' AS kind, col, op, vals, NULL::DOUBLE AS cut, CASE op WHEN '=' THEN {text('value is in the set')}{listed} ELSE {text('value is not in the set')}{listed} END AS expr FROM (SELECT *, len(vals) AS k FROM ({' UNION ALL '.join(unions)})) JOIN (SELECT DISTINCT col, size FROM domain) USING (col) WHERE size - k > 1 AND (k < size - k OR op = '=' AND k = size - k))",
        f"merged AS MATERIALIZED (SELECT * FROM ({counted('sets')}) WHERE score >= 0.53)",
        f"pool AS MATERIALIZED (SELECT row_number() OVER (ORDER BY expr) AS i, * FROM (SELECT col, expr, sb, vb, confidence, penalty, score FROM (SELECT * FROM single UNION ALL SELECT * FROM merged) WHERE score >= 0.37 QUALIFY {seeds}))",
        "two AS MATERIALIZED (SELECT * FROM (SELECT y.i, [x.col, y.col] AS cols, [x.expr, y.expr] AS parts, x.sb & y.sb AS sb, x.vb & y.vb AS vb FROM pool x JOIN pool y ON x.i < y.i AND x.col <> y.col) WHERE bit_count(sb) >= 10)",
        "three AS (SELECT list_append(cols, col), list_append(parts, expr), t.sb & z.sb, t.vb & z.vb FROM two t JOIN pool z ON t.i < z.i AND NOT list_contains(cols, col))",
        f"conjunctions AS ({scored('SELECT cols, parts, bit_count(sb) AS sat, bit_count(vb) AS bad FROM (SELECT cols, parts, sb, vb FROM two UNION ALL SELECT * FROM three)')})",
    ]
    if pattern:
        same = " UNION ALL ".join(f"SELECT '{c}' AS col, a.vio AS vio, a.{c} = b.{c} AS same FROM items a JOIN items b USING (sample_id) WHERE {_RESIDUAL[pattern]}" for c in categorical)
        ctes.append(f"alike AS (SELECT col, op, count(*) FILTER (NOT vio AND same = (op = '=')) AS sat, count(*) FILTER (vio AND same = (op = '=')) AS bad, count(*) FILTER (NOT vio) AS n_pairs FROM ({same}), (SELECT unnest(['=', '!=']) AS op) GROUP BY col, op)")
        sentence = "CASE op WHEN '=' THEN 'two rows have the same value' ELSE 'two rows have different values' END || ' in the \"' || col || '\" column'"
        ctes.append(f"paired AS ({scored(f'SELECT *, {sentence} AS expr FROM alike', 'n_pairs')})")
        found += " UNION ALL SELECT 'PairWise', col, op, expr, sat, bad, confidence, penalty, score FROM paired WHERE score > 0.53"
    ctes.append(f"ranked AS (SELECT *, row_number() OVER (ORDER BY {order.format(0.4)}) AS place FROM (SELECT * FROM ({found}) QUALIFY row_number() OVER (PARTITION BY kind, col, op ORDER BY {order.format(0.3)}) <= 2))")
    return ",\n".join(ctes) + "\nSELECT CAST(place AS INTEGER) AS place, kind, expr, col AS columns, CAST(sat AS BIGINT) AS sat_matches, CAST(bad AS BIGINT) AS vio_matches, confidence, penalty, score FROM ranked"


def _placed(rule: str, violates: str, column: str, value: str) -> str:
    """The place of a value's condition among what is mined for a rule, and how many there are."""
    mined = _mined(CATEGORICAL, []).replace("l_shipdate < o_orderdate AS vio", f"{violates} AS vio")
    sought = f"the \"{column}\" column has the value of: {value}"
    return f"SELECT '{rule}' AS rule_id, CAST(min(place) FILTER (expr = '{sought}') AS INTEGER) AS rank, CAST(count(*) AS INTEGER) AS conditions FROM ({mined} SELECT place, expr FROM ranked)"


_WORDS = "CASE c_custkey % 5 WHEN 0 THEN 'None' WHEN 1 THEN '<NA>' WHEN 2 THEN 'NaN' ELSE c_mktsegment END"

ORACLES: dict[str, str] = {
    "atomic_eq": _metrics('"column", value', _EQ),
    "atomic_neq": _metrics('"column", value', _NEQ),
    "atomic_isnull": _metrics("name", _named({"null": "supp_class IS NULL", "not_null": "supp_class IS NOT NULL"})),
    "atomic_numeric": _metrics("name", _named({"lt": "o_totalprice < 150000", "gte": "o_totalprice >= 150000"})),
    "merged_in": _metrics("name", _named({"years": "o_year IN (1995, 1996)", "classes": "supp_class = 'S1' OR supp_class IS NULL"}).replace("AND (supp_class", "AND coalesce((supp_class").replace("NULL))", "NULL), FALSE))")),
    "merged_not_in": _metrics("name", _named({"years": "o_year NOT IN (1997, 1998)", "classes": "supp_class IS NULL OR supp_class NOT IN ('S1', 'S2')"})),
    "evaluate_condition": _metrics("", "SELECT count(*) FILTER (NOT vio AND ok) AS sat_matches, count(*) FILTER (vio AND ok) AS vio_matches FROM (SELECT vio, o_year = 1995 AND supp_class IS DISTINCT FROM 'S1' AND l_quantity >= 10 AS ok FROM base)", 1),
    "conjunction_2": _sets(2),
    "conjunction_3": _sets(3),
    "blank_to_null": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer",
    "normalize_null_literals": f"SELECT c_custkey, CASE WHEN lower(trim({_WORDS})) IN ('none', 'null', 'nan', 'na', '<na>') THEN NULL ELSE {_WORDS} END AS segment FROM customer",
    "column_profile": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM orders) AS n_distinct, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM orders WHERE {c} IS NOT NULL ORDER BY v LIMIT 15)) AS first_values" for c in ("o_orderstatus", "o_orderpriority", "o_custkey")),
    "entity_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "entity_group_lookup": "SELECT c_nationkey AS entity, CAST(count(o_orderkey) AS BIGINT) AS n_rows, count(DISTINCT o_custkey) = count(DISTINCT c_custkey) AS complete FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "numeric_splits": f'{_SPLITS} SELECT "column", CAST(rank AS INTEGER) AS rank, round(split_value, 6) AS split_value, round(gain, 8) AS gain FROM best',
    "numeric_split_stats": f'{_SPLITS} SELECT "column", CAST(rank AS INTEGER) AS rank, {_SIDES} FROM best',
    "quartile_bins": "SELECT CAST(CASE WHEN l_extendedprice <= e[2] THEN 1 WHEN l_extendedprice <= e[3] THEN 2 WHEN l_extendedprice <= e[4] THEN 3 ELSE 4 END AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem, (SELECT quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM lineitem) GROUP BY 1",
    "equal_width_bins": "SELECT CAST(CASE WHEN low = high THEN 1 ELSE least(greatest(ceil((l_quantity - low) / (high - low) * 10), 1), 10) END AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM lineitem, (SELECT CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high FROM lineitem) GROUP BY 1",
    "potential_categorical": f'{BASE} SELECT "column", value, round(valid, 6) AS valid, n FROM ({_CAT})',
    "potential_numeric": f'{BASE} SELECT "column", value, round(valid, 6) AS valid, n FROM ({_NUM})',
    "potential_decision": f"""{BASE}, g AS (SELECT count(*) AS n, {_VALID} AS global_valid FROM base),
found AS (SELECT 0 AS kind, * FROM ({_CAT}) UNION ALL SELECT 1, * FROM ({_NUM})),
top AS (SELECT valid AS top_valid, "column" AS best_column, value AS best_value FROM found ORDER BY round(valid, 10) DESC, kind, "column" DESC, value DESC LIMIT 1)
SELECT n > 0 AND global_valid <= 0.95 AND greatest(round(top_valid, 10) - global_valid, 0) >= 0.2 AS refine, n, round(global_valid, 6) AS global_valid, round(greatest(round(top_valid, 10) - global_valid, 0), 6) AS best_gain, best_column, best_value FROM g, top""",
    **{f"pairs_{p}": _pair_total(p) for p in _RESIDUAL},
    "pair_both_sides": f"{SAMPLES} " + " UNION ALL ".join(f"SELECT '{p}' AS pattern, CAST({i} AS INTEGER) AS cond, CAST(count(*) AS BIGINT) AS pairs {_both(p, i)}" for p in _RESIDUAL for i in range(3)),
    "pairwise_eq": _pairwise("="),
    "pairwise_neq": _pairwise("<>"),
    "penalty_whole_group": f"{SAMPLES}, n AS (SELECT count(DISTINCT sample_id) AS n FROM smp WHERE vio) " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS cond, CAST(count(*) FILTER (ok) AS BIGINT) AS matched, any_value(n) AS n, round(count(*) FILTER (ok) / any_value(n), 6) AS penalty FROM (SELECT sample_id, bool_and({c.format(x='smp')}) AS ok FROM smp WHERE vio GROUP BY 1), n" for i, c in enumerate(_PAIR)),
    "penalty_pairs": f"{SAMPLES}, n AS (SELECT count(*) AS n FROM smp a JOIN smp b USING (sample_id) WHERE a.vio AND {_RESIDUAL['within_groups']}) " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS cond, (SELECT CAST(count(*) AS BIGINT) {_both('within_groups', i, 'a.vio')}) AS pairs, n, round((SELECT count(*) {_both('within_groups', i, 'a.vio')}) / n, 6) AS penalty FROM n" for i in range(3)),
    "confidence_rows": f"{SAMPLES} " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS cond, CAST(count(*) FILTER ({c.format(x='smp')}) AS BIGINT) AS sat_matches, CAST(count(*) AS BIGINT) AS n_sat, round(count(*) FILTER ({c.format(x='smp')}) / count(*), 6) AS confidence FROM smp WHERE NOT vio" for i, c in enumerate(_PAIR)),
    "confidence_pairs": f"{SAMPLES} " + " UNION ALL ".join(f"SELECT '{n}' AS op, CAST(count(*) FILTER (a.l_returnflag {o} b.l_returnflag) AS BIGINT) AS pairs, CAST(count(*) AS BIGINT) AS n, round(count(*) FILTER (a.l_returnflag {o} b.l_returnflag) / count(*), 6) AS confidence FROM smp a JOIN smp b USING (sample_id) WHERE NOT a.vio AND {_RESIDUAL['between_groups']}" for n, o in (("=", "="), ("!=", "<>"))),
    "confidence_with_violations": f"{SAMPLES} SELECT CASE WHEN vio THEN sample_id || '_' || role ELSE sample_id END AS sample_id, CAST(count(*) AS BIGINT) AS n FROM smp GROUP BY 1",
    "flatten_samples": f"{SAMPLES} SELECT sample_id || '#0' AS sample_id, role, CAST(row_id AS INTEGER) AS row_id, l_partkey FROM smp",
    "redundancy_filter": f"{_SCORED} SELECT signature, expr, CAST(sat_matches AS BIGINT) AS sat_matches, CAST(vio_matches AS BIGINT) AS vio_matches, round(confidence, 6) AS confidence, round(penalty, 6) AS penalty, round(score, 6) AS score FROM kept",
    "final_ranking": f"{_SCORED} SELECT CAST(row_number() OVER (ORDER BY round(score + 0.4 * (confidence - penalty), 10) DESC, round(confidence, 10) DESC, expr) AS INTEGER) AS place, expr, round(score + 0.4 * (confidence - penalty), 6) AS final_rank FROM kept",
    "ranking_metrics": "WITH r AS (SELECT CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 13 + 1 END AS rank FROM orders) SELECT CAST(count(*) AS BIGINT) AS rules, " + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hits_at_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM r",
    "timing_summary": "SELECT CAST(count(value) AS BIGINT) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(min(value), 4) AS least, round(max(value), 4) AS most, round(stddev_pop(value), 4) AS deviation FROM events",
    "sample_uniform": f"{CUSTOMERS} SELECT row_id FROM cust ORDER BY {_SPOT}, row_id LIMIT 100",
    "sample_informative": _INFORMATIVE,
    "rarity_score": f"{_RARITY} SELECT row_id, round(CAST(score AS DOUBLE), 8) AS score FROM rar",
    "hier_sample": _HIER,
    "entity_group_rows": "SELECT c_nationkey AS entity, o_orderkey, o_custkey FROM customer JOIN orders ON c_custkey = o_custkey",
    "sample_rows": f"{CUSTOMERS} SELECT row_id FROM (SELECT row_id FROM cust ORDER BY {_SPOT}, row_id LIMIT 80) UNION ALL SELECT row_id FROM cust WHERE nation = '3'",
    "tree_pairs": f"{SAMPLES} SELECT a.vio AS vio, a.l_returnflag AS l_returnflag_1, b.l_returnflag AS l_returnflag_2, CAST(count(*) AS BIGINT) AS n, CAST(sum(a.l_quantity) AS DOUBLE) AS l_quantity_1, CAST(sum(b.l_quantity) AS DOUBLE) AS l_quantity_2 FROM smp a JOIN smp b USING (sample_id) WHERE {_RESIDUAL['between_groups']} GROUP BY 1, 2, 3",
    "batch_metrics": f"""{_SCORED}, placed AS (SELECT row_number() OVER (ORDER BY round(score + 0.4 * (confidence - penalty), 10) DESC, round(confidence, 10) DESC, expr) AS place, expr FROM kept),
sought AS (SELECT unnest(['o_year = 1995', 'l_returnflag != R', 'supp_class = S1', 'l_linestatus = F', 'o_orderpriority = 5-LOW', 'o_year != 1900']) AS expr),
r AS (SELECT place AS rank FROM sought LEFT JOIN placed USING (expr)) SELECT CAST(count(*) AS BIGINT) AS rules, """ + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS hits_at_{k}" for k in (1, 3, 5, 10)) + ", round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM r",
    "condition_iou": f"{BASE} SELECT CAST(count(*) FILTER (o_totalprice < 150000) AS BIGINT) AS both, CAST(count(*) FILTER (o_totalprice < 151000) AS BIGINT) AS either, round(count(*) FILTER (o_totalprice < 150000) / count(*) FILTER (o_totalprice < 151000), 6) AS iou FROM base",
    "one_hot": f"{BASE} SELECT " + ", ".join(f"CAST(count(*) FILTER (o_year = {y}) AS BIGINT) AS o_year_{y}" for y in (1995, 1996, 1997, 1998)) + ", CAST(count(*) FILTER (supp_class = 'S0') AS BIGINT) AS supp_class_s0, CAST(count(*) FILTER (supp_class = 'S1') AS BIGINT) AS supp_class_s1, CAST(count(*) FILTER (supp_class IS NULL) AS BIGINT) AS supp_class_none, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM base",
    "tree_stump": _GAINS,
    "search_space": f"{_selectors(['l_returnflag', 'l_linestatus', 'supp_class'])} SELECT array_to_string(parts, ' AND ') AS selector FROM (SELECT DISTINCT parts FROM met WHERE col <> 'l_quantity' UNION ALL SELECT parts FROM bins)",
    "subgroup_beam": _BEAM,
    "tree_rules": _tree(),
    "tree_pair_rules": _tree(base=_PAIRS, categorical=_sides(_PAIR_COLUMNS), numeric=_sides(_PAIR_NUMBERS), shown=_OF_ROWS, columns=_OF_ROW_COLUMNS),
    "subgroup_pairs": _beam(_selectors(_sides(_PAIR_COLUMNS), _sides(_PAIR_NUMBERS), _PAIRS), _OF_ROWS, _OF_ROW_COLUMNS),
    "suggest_single_row": _single(["o_year", "supp_class"]),
    "discover": _single([]),
    "suggest_multi_between": _multi("between_groups"),
    "suggest_multi_within": _multi("within_groups"),
    "suggest_multi_whole": _multi(None),
    "suggest_multi_identifiers": _multi("between_groups", ("supp",)),
    "batch_engine": " UNION ALL ".join(_placed(*x) for x in (("0", "l_shipdate < o_orderdate", "o_year", "1995"), ("1", "NOT (l_discount <= 0.05 OR o_orderpriority = '1-URGENT')", "o_orderpriority", "1-URGENT"))),
    "sample_texts": _INFORMATIVE.replace("grp AS (", "grp AS (SELECT row_id, 'y' || CAST(row_id % 97 = 0 AS VARCHAR) AS g FROM cust UNION ALL SELECT row_id, 's' FROM cust WHERE row_id % 97 = 0 UNION ALL "),
    "hybrid_rank": f"{_mined(['o_year', 'supp_class'], None)} SELECT expr, 0.2::DOUBLE * CASE col WHEN 'o_year' THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END + 0.8::DOUBLE * ((score + 1) / 2) AS hybrid_score FROM ranked",
    "reconstruct_samples": f"SELECT group_key, 0 AS rep, role, CAST(row_number() OVER (PARTITION BY group_key, role ORDER BY row_id) - 1 AS INTEGER) AS place, row_id, c_mktsegment, nation, balance FROM ({_HIER}) JOIN ({CUSTOMERS} SELECT * FROM cust) USING (row_id)",
    "wracc": f'{_wracc(_VALUES)} SELECT "column", value, round(wracc, 8) AS wracc FROM w',
    "subgroup_level1": f'{_wracc(_VALUES1)} SELECT CAST(row_number() OVER (ORDER BY round(wracc, 10) DESC, "column", value) AS INTEGER) AS place, "column", value, round(wracc, 8) AS wracc, round(CASE WHEN sat < 5 OR confidence + penalty = 0 THEN 0.0 ELSE confidence / (confidence + penalty) END, 6) AS score FROM w QUALIFY place <= 20',
    "rule_functional_dependency": _flags("SELECT count(DISTINCT l_linestatus) > 1 AS bad FROM lineitem WHERE l_linestatus IS NOT NULL GROUP BY l_orderkey"),
    "rule_unique_key": _flags("SELECT count(*) > 1 AS bad FROM lineitem GROUP BY l_orderkey, l_linenumber"),
    "rule_sum_comparison": _flags("SELECT sum(l_extendedprice) > max(o_totalprice) AS bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey"),
    "rule_sum_threshold": _flags("SELECT sum(l_quantity) > 100 AS bad FROM lineitem GROUP BY l_orderkey"),
    "rule_monotonic": _flags("SELECT value < prev AS bad FROM (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NOT NULL"),
    "rule_reference_equality": _flags("SELECT c_nationkey <> s_nationkey AS bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"),
    "stream_atom_counts": """WITH base AS (SELECT event_type, value < 50 AS vio FROM events), tot AS (SELECT count(*) FILTER (NOT vio) AS n_sat, count(*) FILTER (vio) AS n_vio FROM base),
m AS (SELECT 'event_type' AS "column", event_type AS value, count(*) FILTER (NOT vio) AS sat_matches, count(*) FILTER (vio) AS vio_matches, any_value(n_sat) AS n_sat, any_value(n_vio) AS n_vio FROM base, tot GROUP BY 2),
s AS (SELECT *, sat_matches / n_sat AS confidence, vio_matches / n_vio AS penalty FROM m)
SELECT "column", value, CAST(sat_matches AS BIGINT) AS sat_matches, CAST(vio_matches AS BIGINT) AS vio_matches, round(confidence, 6) AS confidence, round(penalty, 6) AS penalty, round(CASE WHEN sat_matches < 5 OR confidence + penalty = 0 THEN 0.0 ELSE confidence / (confidence + penalty) END, 6) AS score FROM s""",
}
