"""Clinical analogs over the sample tables, as frames and as SQL.

person = customer, stay = order, long observation = order line with an offset in
days from the order date, code text = part type, brand and name joined by a
pipe, chart = events of a user with minutes since 2024-01-01.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.catalog.registry import Sample

# --- charts: events with whole minutes since the first midnight --------------
CHARTS_SQL = """
    SELECT event_id, user_id, event_type, value,
           CAST(date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', ts) AS BIGINT) AS minute
    FROM events
"""


def charts(s: Sample) -> DataFrame:
    return s.table("events").select(
        "event_id", "user_id", "event_type", "value",
        F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("minute"),
    )


# --- observations: order lines with days since the order ----------------------
OBSERVATIONS_SQL = """
    SELECT l.l_orderkey AS stay, o.o_custkey AS person, l.l_partkey, l.l_suppkey, l.l_linenumber,
           l.l_quantity AS quantity, l.l_extendedprice AS price, l.l_discount AS discount,
           l.l_returnflag AS flag, l.l_linestatus AS line_status,
           CAST(date_diff('day', o.o_orderdate, l.l_shipdate) AS BIGINT) AS day
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""


def observations(s: Sample) -> DataFrame:
    lines, orders = s.table("lineitem"), s.table("orders")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        lines.l_orderkey.alias("stay"), orders.o_custkey.alias("person"),
        "l_partkey", "l_suppkey", "l_linenumber",
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
        F.datediff("l_shipdate", "o_orderdate").cast("bigint").alias("day"),
    )


# --- coded events: a hierarchical code text per order line --------------------
CODED_SQL = """
    SELECT l.l_orderkey AS stay, l.l_quantity AS quantity,
           concat_ws('|', p.p_type, p.p_brand, p.p_name) AS code
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
"""


def coded(s: Sample) -> DataFrame:
    lines, part = s.table("lineitem"), s.table("part")
    return lines.join(part, lines.l_partkey == part.p_partkey).select(
        lines.l_orderkey.alias("stay"), F.col("l_quantity").alias("quantity"),
        F.concat_ws("|", "p_type", "p_brand", "p_name").alias("code"),
    )


# --- stays: orders, with outcome, treatment and a five-level group ------------
STAYS_SQL = """
    SELECT o_orderkey AS stay, o_custkey AS person, o_orderpriority AS grp, o_totalprice AS price,
           o_orderstatus AS status,
           CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS outcome,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS treated
    FROM orders
"""


def stays(s: Sample) -> DataFrame:
    return s.table("orders").select(
        F.col("o_orderkey").alias("stay"), F.col("o_custkey").alias("person"),
        F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("outcome"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0).alias("treated"),
    )


GROUPS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

# --- follow-up: days from order to last shipment, kept if not negative --------
FOLLOW_UP_SQL = f"""
    SELECT o.stay, o.grp, o.outcome, CAST(max(x.day) AS DOUBLE) AS days
    FROM ({STAYS_SQL}) o JOIN ({OBSERVATIONS_SQL}) x ON o.stay = x.stay
    GROUP BY o.stay, o.grp, o.outcome HAVING max(x.day) >= 0
"""


def follow_up(s: Sample) -> DataFrame:
    lines = s.table("lineitem")
    last = lines.groupBy(F.col("l_orderkey").alias("stay")).agg(F.max("l_shipdate").alias("last_ship"))
    orders = s.table("orders").select(F.col("o_orderkey").alias("stay"), "o_orderdate")
    days = F.datediff("last_ship", "o_orderdate")
    timed = last.join(orders, "stay").select("stay", days.cast("double").alias("days")).where("days >= 0")
    return stays(s).join(timed, "stay").select("stay", "grp", "outcome", "days")
