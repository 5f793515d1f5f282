"""Views over the given tables and helpers shared by the query modules.

Every SQL fragment here mirrors the DataFrame view next to it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut_lineage
from plumbline.sources.tables import load_table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return load_table(spark, f"{sf}/{name}.parquet")


# Added before rounding on both sides: values that lie exactly on a rounding tie
# (frequent with short decimals) then round alike whatever their last bit is.
NUDGE = 2e-9


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and turn -0.0 into 0.0, as the SQL side does."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if f.dataType.typeName() == "double":
            c = (F.round(c + F.lit(NUDGE), digits) + F.lit(0.0)).alias(f.name)
        elif f.dataType.typeName() in ("integer", "short", "byte"):
            c = c.cast("long").alias(f.name)
        out.append(c)
    return df.select(*out)


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE + {NUDGE!r}, {digits}) + 0.0 AS {name}"


def dbl(v: float) -> str:
    """A double literal that keeps every bit."""
    return f"{v:.17e}::DOUBLE"


_STORED: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage that several queries read, written once to the checkpoint folder of the session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        _STORED[key] = cut_lineage(build())
    return _STORED[key]


# --- documents with labels, scored by length --------------------------------

SCORED_DOCS = """scored AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality AS y, l.toxic AS toxic,
         d.n_chars / (d.n_chars + 2000.0::DOUBLE) AS p
  FROM documents d JOIN labels l USING (doc_id))"""


def scored_docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    l = table(spark, sf, "labels")
    return d.join(l, "doc_id").select(
        "doc_id", "lang", "source", "n_chars", F.col("quality").alias("y"), "toxic",
        (F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0))).alias("p"),
    )


# --- line items: a heavily tied score at scale --------------------------------

SCORED_LINES = """scored AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
         l_linestatus AS grp, l_returnflag AS flag, l_quantity / 50.0::DOUBLE AS p,
         (l_returnflag = 'R')::INT AS y
  FROM lineitem)"""


def scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.col("l_linestatus").alias("grp"), F.col("l_returnflag").alias("flag"),
        (F.col("l_quantity") / 50.0).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )


# --- baseline and evaluation side of line items --------------------------------

SPLIT = "1998-07-01"
PAIR = f"""base AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '{SPLIT} 00:00:00'),
evalt AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '{SPLIT} 00:00:00')"""


def line_pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf, "lineitem")
    cut = F.lit(f"{SPLIT} 00:00:00").cast("timestamp")
    return l.filter(F.col("l_shipdate") < cut), l.filter(F.col("l_shipdate") >= cut)


DRIFT_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
DRIFT_CATEGORICAL = ["l_returnflag", "l_linestatus"]


def union_cells(source: str, columns: list[str], cast: str = "DOUBLE", extra: str = "") -> str:
    """feature, value rows of several columns, as UNION ALL."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c}::{cast} AS value{extra} FROM {source}" for c in columns
    )


# --- orders with holes, infinities and repeats ---------------------------------

MESSY = """messy AS (
  SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 97 = 0 THEN 'infinity'::DOUBLE WHEN o_orderkey % 89 = 0 THEN 'nan'::DOUBLE
              ELSE o_totalprice * CASE WHEN o_orderkey % 13 = 0 THEN 10 ELSE 1 END END AS o_totalprice,
         o_orderdate, o_orderpriority, 'EU' AS market, (o_orderkey % 100 = 0)::INT AS flag
  FROM orders
  UNION ALL
  SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END,
         CASE WHEN o_orderkey % 97 = 0 THEN 'infinity'::DOUBLE WHEN o_orderkey % 89 = 0 THEN 'nan'::DOUBLE
              ELSE o_totalprice * CASE WHEN o_orderkey % 13 = 0 THEN 10 ELSE 1 END END,
         o_orderdate, o_orderpriority, 'EU', (o_orderkey % 100 = 0)::INT
  FROM orders WHERE o_orderkey % 40 = 0)"""
MESSY_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "market", "flag"]
MESSY_NUMERIC = ["o_custkey", "o_totalprice", "flag"]


def messy_orders(spark: SparkSession, sf: str) -> DataFrame:
    """All orders, with gaps, infinities, inflated prices and repeated rows placed by key."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice") * F.when(k % 13 == 0, 10).otherwise(1)
    rows = o.select(
        "o_orderkey",
        F.when(k % 7 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 97 == 0, F.lit(float("inf"))).when(k % 89 == 0, F.lit(float("nan"))).otherwise(price).alias("o_totalprice"),
        "o_orderdate", "o_orderpriority", F.lit("EU").alias("market"), (k % 100 == 0).cast("int").alias("flag"),
    )
    return rows.unionByName(rows.filter(k % 40 == 0)).drop("o_orderkey")


# --- running-total statistics of one scored table, for SQL ---------------------

def score_cte(y: str = "y", p: str = "p") -> str:
    return f"""cnt AS (SELECT {p} AS v, sum(({y} = 1)::INT)::DOUBLE AS pos, sum(({y} <> 1)::INT)::DOUBLE AS neg
  FROM scored GROUP BY 1),
cum AS (SELECT v, pos, neg,
  coalesce(sum(pos) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lt_pos,
  coalesce(sum(neg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lt_neg,
  sum(pos) OVER () AS tp_all, sum(neg) OVER () AS tn_all FROM cnt)"""


# --- event history as runs of lineages ------------------------------------------

EVENT_RUNS = """runs AS (
  SELECT event_type AS lineage_id, CAST(ts AS DATE) AS run_date, avg(value) AS mean_value,
         avg((value > 100)::INT::DOUBLE) AS high_share, avg((value < 20)::INT::DOUBLE) AS low_share, count(*) AS n
  FROM events GROUP BY 1, 2),
idx AS (SELECT *, row_number() OVER (PARTITION BY lineage_id ORDER BY run_date) - 1 AS run_index FROM runs)"""
