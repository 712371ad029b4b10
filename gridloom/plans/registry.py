"""Where queries and their DuckDB counterparts are registered, and the grid that most of them read.

The SQL of an oracle is written from the definition of the operator; it shares neither kernels
nor responses with the code that it checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.sources import fixtures

N = 48
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_PRICES = f"SELECT CAST(l_partkey % {N} AS INTEGER) AS row, CAST(l_orderkey % {N} AS INTEGER) AS col, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2"
CELLS = f"cells AS (SELECT CAST(r.range AS INTEGER) AS row, CAST(c.range AS INTEGER) AS col FROM range({N}) r, range({N}) c)"
#: The price grid; ``full`` is dense, ``g`` has the regular holes too.
GRID_SQL = f"""p AS ({_PRICES}), {CELLS},
full_ AS (SELECT cells.row, cells.col, p.v FROM cells LEFT JOIN p ON p.row = cells.row AND p.col = cells.col),
g AS (SELECT row, col, CASE WHEN (row * 7 + col * 3) % 11 = 0 THEN NULL ELSE v END AS v FROM full_)"""


def add(name: str, query, oracle: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


def grid(spark: SparkSession, sf: str, holes: bool = True) -> DataFrame:
    return fixtures.price_grid(spark, sf, N, holes)


def out(df: DataFrame, digits: int = 7, *cols: str) -> DataFrame:
    """Rounded to what different summation orders leave alone; adding zero turns -0 into 0."""
    cols = cols or ("v",)
    keys = [c for c in df.columns if c not in cols]
    return df.select(*keys, *[(F.round(c, digits) + 0.0).alias(c) for c in cols])


def rounded(sql: str, digits: int = 7, keys: str = "row, col", cols: tuple[str, ...] = ("v",)) -> str:
    return f"SELECT {keys}, {', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in cols)} FROM ({sql})"
