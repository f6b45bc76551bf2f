"""A raw all-string customer panel derived from the trade tables (orders, customer, nation).

One row per customer and month with at least one order. Values are padded, missing or unreadable
on purpose, by rules on the customer number, so that staging meets every kind of text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cohortry.functions.calendar import month_gap
from cohortry.spec import PanelSpec

# The whole span of the orders table, as first-of-month dates; padding is blanks.
ORDERS_SPEC = PanelSpec(panel_start=dt.date(1995, 1, 1), panel_end=dt.date(2001, 8, 1), white_space=" ")
URGENT = ("1-URGENT", "2-HIGH")


def _every(step: int) -> Column:
    return F.col("c_custkey") % step == 0


def raw_panel(spark: SparkSession, folder: str, before: dt.date | None = None) -> DataFrame:
    """The panel as text columns. ``before`` ends it early (first orders still see all orders)."""
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderpriority")
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    day = F.to_date("o_orderdate")
    monthly = orders.groupBy("o_custkey", F.trunc(day, "MM").alias("month")).agg(
        F.min(day).alias("first_day"),
        F.count("*").alias("n_orders"),
        F.max(F.col("o_orderpriority").isin(*URGENT).cast("int")).alias("flag"),
    )
    # after the aggregate a customer has at most one row per calendar month
    months = monthly.withColumn("first_order", F.min("first_day").over(W.partitionBy("o_custkey")))
    if before is not None:
        months = months.filter(F.col("month") < F.lit(before))
    joined = months.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    snapshot = F.date_add("month", 27)
    acquired = F.add_months("first_order", -(F.col("c_custkey") % 3).cast("int"))
    income = F.round(F.col("c_acctbal") * 20).cast("bigint").cast("string")
    text = {
        "ncodpers": F.col("o_custkey").cast("string"),
        "fecha_dato": snapshot.cast("string"),
        "fecha_alta": F.when(_every(97), F.lit("not a date")).otherwise(acquired.cast("string")),
        "antiguedad": F.when(_every(19), F.lit("-999999"))
        .when(_every(23), F.lit(" NA"))
        .otherwise(F.lpad(month_gap(snapshot, acquired).cast("string"), 7, " ")),
        "ind_nuevo": F.when(_every(29), F.lit("1.0")).otherwise(
            F.when(month_gap(snapshot, acquired) < 6, F.lit("1")).otherwise(F.lit("0"))
        ),
        "age": F.when(_every(17), F.lit(" NA"))
        .when(_every(83), F.lit("x"))
        .otherwise(F.lpad((F.col("c_custkey") % 90).cast("string"), 3, " ")),
        "renta": F.when(_every(11), F.lit("   NA"))
        .when(_every(13), F.lit(""))
        .when(_every(89), F.lit("n/a"))
        .otherwise(F.concat(F.lit("  "), income)),
        "segmento": F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("01 - TOP"))
        .when(F.col("c_mktsegment") != "HOUSEHOLD", F.lit("02 - RETAIL ")),
        "canal_entrada": F.when(
            F.col("c_nationkey") % 7 != 0, F.concat(F.lit("K"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
        ),
        "cod_prov": F.concat(F.lit(" "), F.col("c_nationkey").cast("string")),
        "nomprov": F.col("n_name"),
        "pais_residencia": F.concat(F.lit("R"), F.col("n_regionkey").cast("string")),
        "indresi": F.when(_every(31), F.lit("N ")).otherwise(F.lit("S")),
        "indext": F.when(_every(37), F.lit(" S")).otherwise(F.lit("N")),
        "ind_actividad_cliente": F.when(F.col("n_orders") > 1, F.lit("1")).otherwise(F.lit("0")),
        "ind_empleado": F.when(_every(41), F.lit("A")).otherwise(F.lit("N")),
        "indrel": F.when(_every(43), F.lit("99")).otherwise(F.lit("1")),
        "tiprel_1mes": F.when(F.col("n_orders") > 1, F.lit("A")).otherwise(F.lit("I")),
        "ind_tjcr_fin_ult1": F.col("flag").cast("string"),
    }
    return joined.select(*[value.alias(name) for name, value in text.items()])
