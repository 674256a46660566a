"""Queries for filters, joins, aggregates, windows and feature operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.catalog.registry import Sample, register
from episodica.catalog.views import (
    CHARTS_SQL,
    CODED_SQL,
    OBSERVATIONS_SQL,
    charts,
    coded,
    observations,
)
from episodica.functions.columns import keep_range_by_name, present, vital_status, whole_hours
from episodica.operators.episodes import first_episode, lookup, number_episodes, qualifying_keys
from episodica.operators.rules import (
    CodeRule,
    classify_codes,
    event_flags,
    event_flags_by_dictionary,
    exclude_flagged,
    Source,
    exposure_flags,
    flags_for_all,
)
from episodica.operators.windows import (
    attach_series_summary,
    extreme_ratio,
    in_window,
    measurement_extremes,
    merge_series,
    number_rows,
    pivot_extremes,
    ratio_of_extremes,
    summarise_window,
    tagged_extremes,
)

DAY_1 = (0, 1440)
WEEK_1 = (0, 10080)


# --- offset windows -----------------------------------------------------------
@register("offset_window", f"""
    SELECT stay, l_linenumber, day, quantity FROM ({OBSERVATIONS_SQL}) WHERE day BETWEEN -30 AND 30
""")
def offset_window(s: Sample) -> DataFrame:
    return in_window(observations(s), "day", (-30, 30)).select("stay", "l_linenumber", "day", "quantity")


@register("window_summary", f"""
    SELECT user_id, max(value) AS value_max, min(value) AS value_min, round(avg(value), 6) AS value_avg
    FROM ({CHARTS_SQL}) WHERE minute BETWEEN 0 AND 10080 GROUP BY user_id
""")
def window_summary(s: Sample) -> DataFrame:
    out = summarise_window(
        charts(s), "user_id", "minute", WEEK_1,
        {"value_max": ("max", "value"), "value_min": ("min", "value"), "value_avg": ("avg", "value")},
    )
    return out.withColumn("value_avg", F.round("value_avg", 6))


@register("window_sum", f"""
    SELECT user_id, round(sum(value), 4) AS value_24h
    FROM ({CHARTS_SQL}) WHERE minute BETWEEN 0 AND 1440 GROUP BY user_id
""")
def window_sum(s: Sample) -> DataFrame:
    out = summarise_window(charts(s), "user_id", "minute", DAY_1, {"value_24h": ("sum", "value")})
    return out.withColumn("value_24h", F.round("value_24h", 4))


# --- pivots and ranges ---------------------------------------------------------
EVENT_LIMITS = {"click": (0.5, 150), "view": (1, 120), "purchase": (0.1, 200), "signup": (2, 300)}
EVENT_OUTPUTS = {
    "click_max": ("max", "click"), "view_max": ("max", "view"), "purchase_max": ("max", "purchase"),
    "signup_low": ("min", "signup"), "error_max": ("max", "error"),
}
CLEAN_CASE = """CASE WHEN event_type = 'click' AND (value < 0.5 OR value > 150) THEN NULL
             WHEN event_type = 'view' AND (value < 1 OR value > 120) THEN NULL
             WHEN event_type = 'purchase' AND (value < 0.1 OR value > 200) THEN NULL
             WHEN event_type = 'signup' AND (value < 2 OR value > 300) THEN NULL
             ELSE value END"""


@register("range_clean", f"""
    SELECT event_id, event_type, {CLEAN_CASE} AS clean_value FROM events
""")
def range_clean(s: Sample) -> DataFrame:
    return s.table("events").select(
        "event_id", "event_type", keep_range_by_name("event_type", "value", EVENT_LIMITS).alias("clean_value")
    )


@register("pivot_max", """
    SELECT user_id, max(value) FILTER (event_type = 'click') AS click_max,
           max(value) FILTER (event_type = 'view') AS view_max,
           max(value) FILTER (event_type = 'purchase') AS purchase_max,
           min(value) FILTER (event_type = 'signup') AS signup_low,
           max(value) FILTER (event_type = 'error') AS error_max
    FROM events GROUP BY user_id
""")
def pivot_max(s: Sample) -> DataFrame:
    return pivot_extremes(s.table("events"), ["user_id"], "event_type", "value", EVENT_OUTPUTS)


LAB_SQL = f"""
    SELECT u.user_id, max(CASE WHEN event_type = 'click' THEN v END) AS click_max,
           max(CASE WHEN event_type = 'view' THEN v END) AS view_max,
           max(CASE WHEN event_type = 'purchase' THEN v END) AS purchase_max,
           min(CASE WHEN event_type = 'signup' THEN v END) AS signup_low,
           max(CASE WHEN event_type = 'error' THEN v END) AS error_max
    FROM (SELECT DISTINCT user_id FROM events) u
    LEFT JOIN (SELECT user_id, event_type, minute, {CLEAN_CASE} AS v FROM ({CHARTS_SQL})) e
      ON u.user_id = e.user_id AND e.minute BETWEEN 0 AND 1440
    GROUP BY u.user_id
"""


def _labs(s: Sample) -> DataFrame:
    events = charts(s)
    return measurement_extremes(
        events, events, "user_id", "event_type", "value", "minute", DAY_1, EVENT_LIMITS, EVENT_OUTPUTS
    )


@register("lab_extremes", f"""
    SELECT *, round(CASE WHEN purchase_max > 0 AND view_max > 0 THEN purchase_max / view_max END, 6) AS ratio
    FROM ({LAB_SQL})
""")
def lab_extremes(s: Sample) -> DataFrame:
    out = ratio_of_extremes(_labs(s), "purchase_max", "view_max", "ratio")
    return out.withColumn("ratio", F.round("ratio", 6))


@register("ratio_extreme", f"""
    WITH r AS (SELECT user_id, purchase_max / view_max AS ratio,
                      row_number() OVER (PARTITION BY user_id ORDER BY purchase_max / view_max DESC) AS rn
               FROM ({LAB_SQL}) WHERE purchase_max > 0 AND view_max > 0)
    SELECT user_id, round(max(CASE WHEN rn = 1 THEN ratio END), 6) AS ratio_max FROM r GROUP BY user_id
""")
def ratio_extreme(s: Sample) -> DataFrame:
    out = ratio_of_extremes(_labs(s), "purchase_max", "view_max", "ratio").where("ratio IS NOT NULL")
    return out.select("user_id", F.round("ratio", 6).alias("ratio_max"))


@register("safe_ratio", f"""
    WITH r AS (SELECT stay, price / coalesce(nullif(floor(discount * 20), 0), 21) AS ratio
               FROM ({OBSERVATIONS_SQL}) WHERE price IS NOT NULL AND discount IS NOT NULL),
    k AS (SELECT stay, ratio, row_number() OVER (PARTITION BY stay ORDER BY ratio) AS rn FROM r)
    SELECT stay, round(max(CASE WHEN rn = 1 THEN ratio END), 4) AS ratio_min FROM k GROUP BY stay
""")
def safe_ratio(s: Sample) -> DataFrame:
    rows = observations(s).withColumn("step", F.floor(F.col("discount") * 20).cast("double"))
    out = extreme_ratio(rows, "stay", "price", "step", "ratio_min", "min", 21)
    return out.withColumn("ratio_min", F.round("ratio_min", 4))


# --- code rules ----------------------------------------------------------------
def _flag_sql(tests: dict[str, str]) -> str:
    flags = ", ".join(f"CAST(max(CASE WHEN {t} THEN 1 ELSE 0 END) AS INTEGER) AS {n}" for n, t in tests.items())
    return (
        f"SELECT o.o_orderkey AS stay, {flags} FROM orders o "
        f"LEFT JOIN ({CODED_SQL}) c ON o.o_orderkey = c.stay GROUP BY o.o_orderkey"
    )


def _flags(s: Sample, rules: list[CodeRule]) -> DataFrame:
    base = s.table("orders").select(F.col("o_orderkey").alias("stay"))
    return flags_for_all(base, event_flags(coded(s), "stay", "code", rules), "stay", [r.flag for r in rules])


@register("code_prefix_flag", _flag_sql({
    "promo_low": "c.code LIKE 'PROMO|Brand#1%'",
    "heavy": "c.code LIKE 'LARGE|Brand#2%' OR c.code LIKE 'MEDIUM|Brand#3%'",
}))
def code_prefix_flag(s: Sample) -> DataFrame:
    return _flags(s, [
        CodeRule("promo_low", prefixes=("PROMO|Brand#1",)),
        CodeRule("heavy", prefixes=("LARGE|Brand#2", "MEDIUM|Brand#3")),
    ])


@register("code_pattern_flag", _flag_sql({
    "any_ring": "c.code LIKE '%|Brand#7|%ring'",
    "inner": "c.code LIKE 'SMALL|%|red%' OR c.code LIKE 'ECONOMY|Brand#1%|%bolt'",
}))
def code_pattern_flag(s: Sample) -> DataFrame:
    return _flags(s, [
        CodeRule("any_ring", patterns=("%|Brand#7|%ring",)),
        CodeRule("inner", patterns=("SMALL|%|red%", "ECONOMY|Brand#1%|%bolt")),
    ])


EXACT_CODES = ("PROMO|Brand#7|hot rod", "PROMO|Brand#7|hot  rod", "SMALL|Brand#2|red bolt", "LARGE|Brand#11|old gear")
EXACT_LIST = ", ".join(f"'{c}'" for c in EXACT_CODES)


@register("code_exact_flag", _flag_sql({
    "named": " OR ".join(f"c.code LIKE '{c}'" for c in EXACT_CODES),
    "spaced": "c.code LIKE 'PROMO|Brand#7|hot  rod'",
}))
def code_exact_flag(s: Sample) -> DataFrame:
    return _flags(s, [
        CodeRule("named", exact=EXACT_CODES), CodeRule("spaced", exact=("PROMO|Brand#7|hot  rod",)),
    ])


NAMES = ("red widget", "blue bolt", "hot gear", "cold rod")


@register("code_in_list", """
    SELECT l.l_orderkey AS stay, CAST(count(*) AS BIGINT) AS n_listed
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
    WHERE p.p_name IN ('red widget', 'blue bolt', 'hot gear', 'cold rod') GROUP BY 1
""")
def code_in_list(s: Sample) -> DataFrame:
    lines = s.table("lineitem").select(F.col("l_orderkey").alias("stay"), F.col("l_partkey").alias("p_partkey"))
    listed = s.table("part").where(F.col("p_name").isin(*NAMES)).select("p_partkey")
    return lines.join(listed, "p_partkey").groupBy("stay").agg(F.count(F.lit(1)).alias("n_listed"))


@register("case_order_flag", _flag_sql({
    "promo_active": "CASE WHEN c.code LIKE 'PROMO|Brand#1%' THEN false ELSE coalesce(c.code LIKE 'PROMO%', false) END",
}))
def case_order_flag(s: Sample) -> DataFrame:
    return _flags(s, [CodeRule("promo_active", prefixes=("PROMO",), veto=("PROMO|Brand#1",))])


GROUP_RULES = [
    CodeRule("promo", prefixes=("PROMO|Brand#1", "PROMO|Brand#2"), exact=("PROMO|Brand#5|hot rod",)),
    CodeRule("small", prefixes=("SMALL",), patterns=("ECONOMY|%|small%",)),
    CodeRule("rings", patterns=("%|%|red ring", "%|%|blue ring")),
    CodeRule("bolts", patterns=("LARGE|%bolt", "MEDIUM|%bolt")),
    CodeRule("listed", exact=EXACT_CODES),
    CodeRule("large", prefixes=("LARGE|Brand#11", "LARGE|Brand#12", "LARGE|Brand#13")),
    CodeRule("standard", prefixes=("STANDARD|Brand#9",), exact=("STANDARD|Brand#8|old gear",)),
    CodeRule("excluded", prefixes=("ECONOMY|Brand#25",)),
]
GROUP_TESTS = {
    "promo": "c.code LIKE 'PROMO|Brand#1%' OR c.code LIKE 'PROMO|Brand#2%' OR c.code = 'PROMO|Brand#5|hot rod'",
    "small": "c.code LIKE 'SMALL%' OR c.code LIKE 'ECONOMY|%|small%'",
    "rings": "c.code LIKE '%|%|red ring' OR c.code LIKE '%|%|blue ring'",
    "bolts": "c.code LIKE 'LARGE|%bolt' OR c.code LIKE 'MEDIUM|%bolt'",
    "listed": f"c.code IN ({EXACT_LIST})",
    "large": "c.code LIKE 'LARGE|Brand#11%' OR c.code LIKE 'LARGE|Brand#12%' OR c.code LIKE 'LARGE|Brand#13%'",
    "standard": "c.code LIKE 'STANDARD|Brand#9%' OR c.code = 'STANDARD|Brand#8|old gear'",
    "excluded": "c.code LIKE 'ECONOMY|Brand#25%'",
}


@register("comorbidity_flags", _flag_sql(GROUP_TESTS))
def comorbidity_flags(s: Sample) -> DataFrame:
    return _flags(s, GROUP_RULES)


@register("code_dictionary", f"""
    SELECT code, CAST(code LIKE 'SMALL%' AS INTEGER) AS small, CAST(code LIKE '%ring' AS INTEGER) AS ring
    FROM (SELECT DISTINCT code FROM ({CODED_SQL})) WHERE code LIKE 'SMALL%' OR code LIKE '%ring'
""")
def code_dictionary(s: Sample) -> DataFrame:
    rules = [CodeRule("small", prefixes=("SMALL",)), CodeRule("ring", patterns=("%ring",))]
    return classify_codes(coded(s), "code", rules)


CARE_RULES = [
    CodeRule("active", prefixes=("PROMO", "STANDARD|Brand#2"), veto=("PROMO|Brand#1",)),
    CodeRule("tracked", prefixes=("STANDARD|Brand#2",)),
    CodeRule("low_dose", exact=("SMALL|Brand#2|red bolt", "SMALL|Brand#2|red  bolt")),
    CodeRule("any_gear", patterns=("%|%|%gear",)),
]


@register("intervention_flags", _flag_sql({
    "active": "CASE WHEN c.code LIKE 'PROMO|Brand#1%' THEN false "
              "ELSE coalesce(c.code LIKE 'PROMO%' OR c.code LIKE 'STANDARD|Brand#2%', false) END",
    "tracked": "c.code LIKE 'STANDARD|Brand#2%'",
    "low_dose": "c.code IN ('SMALL|Brand#2|red bolt', 'SMALL|Brand#2|red  bolt')",
    "any_gear": "c.code LIKE '%|%|%gear'",
}))
def intervention_flags(s: Sample) -> DataFrame:
    base = s.table("orders").select(F.col("o_orderkey").alias("stay"))
    flags = event_flags_by_dictionary(coded(s), "stay", "code", CARE_RULES)
    return flags_for_all(base, flags, "stay", [r.flag for r in CARE_RULES])


# --- cohort, joins and exposure ---------------------------------------------------
@register("culture_positive", f"""
    SELECT stay, flag, day FROM ({OBSERVATIONS_SQL})
    WHERE flag NOT LIKE 'N' AND flag IS NOT NULL AND day BETWEEN -100 AND 100
""")
def culture_positive(s: Sample) -> DataFrame:
    rows = in_window(observations(s), "day", (-100, 100))
    return rows.where(F.col("flag").isNotNull() & ~F.col("flag").like("N")).select("stay", "flag", "day")


QUALIFYING_SQL = f"""
    SELECT DISTINCT c.stay, CAST(floor(o.o_totalprice / 50000) AS BIGINT) AS score
    FROM ({CODED_SQL}) c
    JOIN (SELECT DISTINCT concat_ws('|', p_type, p_brand, p_name) AS code FROM part WHERE p_size <= 5) k
      ON c.code = k.code AND c.quantity BETWEEN 10 AND 30
    JOIN orders o ON c.stay = o.o_orderkey AND floor(o.o_totalprice / 50000) >= 2
"""


@register("cohort_flag", QUALIFYING_SQL)
def cohort_flag(s: Sample) -> DataFrame:
    listed = s.table("part").where("p_size <= 5").select(
        F.concat_ws("|", "p_type", "p_brand", "p_name").alias("code")
    )
    scores = s.table("orders").select(
        F.col("o_orderkey").alias("stay"), F.floor(F.col("o_totalprice") / 50000).alias("score")
    )
    events = coded(s).where(F.col("quantity").between(10, 30))
    return qualifying_keys(events, listed, scores, "stay", "code", "score", 2)


@register("full_outer_null_rejected", """
    SELECT d.l_orderkey AS stay, d.l_linenumber AS line, c.l_partkey AS culture_part, o.o_orderpriority AS priority
    FROM (SELECT * FROM lineitem WHERE l_quantity <= 3) d
    FULL OUTER JOIN (SELECT * FROM lineitem WHERE l_quantity >= 49) c ON d.l_orderkey = c.l_orderkey
    JOIN orders o ON d.l_orderkey = o.o_orderkey AND o.o_totalprice >= 100000
""")
def full_outer_null_rejected(s: Sample) -> DataFrame:
    lines = s.table("lineitem")
    d = lines.where("l_quantity <= 3").select(F.col("l_orderkey").alias("stay"), F.col("l_linenumber").alias("line"))
    c = lines.where("l_quantity >= 49").select(
        F.col("l_orderkey").alias("c_stay"), F.col("l_partkey").alias("culture_part")
    )
    scores = s.table("orders").where("o_totalprice >= 100000").select(
        F.col("o_orderkey").alias("stay"), F.col("o_orderpriority").alias("priority")
    )
    # The later inner join on the left key drops rows found only on the right.
    both = d.join(c, d.stay == c.c_stay, "full")
    return both.join(scores, both.stay == scores.stay).select(both.stay, "line", "culture_part", "priority")


SITE_ROWS = [("A", "Core"), ("R", "Skin"), ("R", "Bladder")]


@register("lookup_join", f"""
    SELECT o.stay, o.l_linenumber, o.day, m.site,
           CASE WHEN m.site IN ('Core', 'Bladder') THEN 1 ELSE 0 END AS is_core
    FROM ({OBSERVATIONS_SQL}) o
    JOIN (VALUES ('A', 'Core'), ('R', 'Skin'), ('R', 'Bladder')) m(flag, site) ON o.flag = m.flag
    WHERE o.day BETWEEN 0 AND 200
""")
def lookup_join(s: Sample) -> DataFrame:
    sites = s.spark.createDataFrame(SITE_ROWS, "flag string, site string")
    rows = lookup(in_window(observations(s), "day", (0, 200)), sites, ["flag"])
    core = F.when(F.col("site").isin("Core", "Bladder"), 1).otherwise(0)
    return rows.select("stay", "l_linenumber", "day", "site", core.alias("is_core"))


@register("inner_residual", """
    SELECT o.o_orderkey AS stay, c.c_mktsegment AS segment, o.o_totalprice AS price
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal >= 5000 AND o.o_orderstatus = 'F'
""")
def inner_residual(s: Sample) -> DataFrame:
    people = s.table("customer").where("c_acctbal >= 5000")
    rows = s.table("orders").where("o_orderstatus = 'F'")
    return rows.join(people, rows.o_custkey == people.c_custkey).select(
        F.col("o_orderkey").alias("stay"), F.col("c_mktsegment").alias("segment"), F.col("o_totalprice").alias("price")
    )


@register("left_join_on_filter", """
    SELECT o.o_orderkey AS stay, l.l_linenumber AS line, l.l_quantity AS quantity
    FROM orders o LEFT JOIN lineitem l
      ON o.o_orderkey = l.l_orderkey AND l.l_quantity BETWEEN 45 AND 50 AND l.l_returnflag IN ('A', 'R')
""")
def left_join_on_filter(s: Sample) -> DataFrame:
    right = s.table("lineitem").where(
        F.col("l_quantity").between(45, 50) & F.col("l_returnflag").isin("A", "R")
    ).select(F.col("l_orderkey").alias("stay"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    return s.table("orders").select(F.col("o_orderkey").alias("stay")).join(right, "stay", "left")


@register("exposure_flag", f"""
    SELECT o.o_orderkey AS stay,
           max(CASE WHEN a.stay IS NOT NULL OR b.stay IS NOT NULL THEN 1 ELSE 0 END) AS exposed,
           max(CASE WHEN b.stay IS NOT NULL THEN 1 ELSE 0 END) AS cooled
    FROM orders o
    LEFT JOIN (SELECT DISTINCT stay FROM ({OBSERVATIONS_SQL}) WHERE quantity >= 45 AND day BETWEEN -60 AND 300) a
      ON o.o_orderkey = a.stay
    LEFT JOIN (SELECT DISTINCT stay FROM ({OBSERVATIONS_SQL}) WHERE price > 90000) b ON o.o_orderkey = b.stay
    GROUP BY o.o_orderkey
""")
def exposure_flag(s: Sample) -> DataFrame:
    rows = observations(s)
    drug = Source(rows, F.col("day").between(-60, 300) & (F.col("quantity") >= 45))
    code = Source(rows, F.col("price") > 90000)
    base = s.table("orders").select(F.col("o_orderkey").alias("stay"))
    return exposure_flags(base, "stay", {"exposed": [drug, code], "cooled": [code]})


@register("exclude_anti", """
    SELECT o_orderkey AS stay, o_totalprice AS price FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount >= 0.09)
""")
def exclude_anti(s: Sample) -> DataFrame:
    base = s.table("orders").select(F.col("o_orderkey").alias("stay"), F.col("o_totalprice").alias("price"))
    flagged = s.table("lineitem").where("l_discount >= 0.09").select(F.col("l_orderkey").alias("stay"))
    return exclude_flagged(base, flagged, "stay")


# --- series ------------------------------------------------------------------------
@register("merge_series", f"""
    SELECT user_id, minute, value AS pressure FROM ({CHARTS_SQL}) WHERE event_type = 'click' AND value IS NOT NULL
    UNION ALL
    SELECT user_id, minute, value FROM ({CHARTS_SQL})
    WHERE event_type = 'view' AND value IS NOT NULL AND minute BETWEEN 0 AND 1440
""")
def merge_series_query(s: Sample) -> DataFrame:
    return _series(charts(s))


def _series(rows: DataFrame) -> DataFrame:
    invasive = rows.where("event_type = 'click'")
    cuff = in_window(rows.where("event_type = 'view'"), "minute", DAY_1)
    return merge_series([(invasive, "value"), (cuff, "value")], ["user_id", "minute"], "pressure")


@register("mn_join_preagg", f"""
    WITH m AS (SELECT user_id, value AS pressure FROM ({CHARTS_SQL}) WHERE event_type = 'click'
               UNION ALL SELECT user_id, value FROM ({CHARTS_SQL})
               WHERE event_type = 'view' AND minute BETWEEN 0 AND 1440)
    SELECT v.user_id, max(v.value) AS rate_max, round(avg(v.value), 6) AS rate_avg,
           min(m.pressure) AS pressure_min, round(avg(m.pressure), 6) AS pressure_avg
    FROM ({CHARTS_SQL}) v LEFT JOIN m ON v.user_id = m.user_id
    WHERE v.event_type = 'error' AND v.minute >= 0 AND v.minute <= 10080 GROUP BY v.user_id
""")
def mn_join_preagg(s: Sample) -> DataFrame:
    rows = charts(s)
    left = summarise_window(
        rows.where("event_type = 'error'"), "user_id", "minute", WEEK_1,
        {"rate_max": ("max", "value"), "rate_avg": ("avg", "value")},
    )
    out = attach_series_summary(
        left, _series(rows), "user_id", {"pressure_min": ("min", "pressure"), "pressure_avg": ("avg", "pressure")}
    )
    return out.withColumns({c: F.round(c, 6) for c in ("rate_avg", "pressure_avg")})


@register("extreme_rows", """
    WITH r AS (
      SELECT user_id, event_type, value, event_type IN ('click', 'view') AS core,
        row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_type DESC) AS hi,
        row_number() OVER (PARTITION BY user_id ORDER BY value ASC NULLS LAST, event_type ASC) AS lo,
        row_number() OVER (PARTITION BY user_id, event_type IN ('click', 'view')
                           ORDER BY value DESC NULLS LAST, event_type DESC) AS part_hi,
        row_number() OVER (PARTITION BY user_id, event_type IN ('click', 'view')
                           ORDER BY value ASC NULLS LAST, event_type ASC) AS part_lo
      FROM events)
    SELECT user_id,
      max(value) FILTER (hi = 1) AS max_all, max(event_type) FILTER (hi = 1) AS max_all_event_type,
      max(value) FILTER (lo = 1) AS min_all, max(event_type) FILTER (lo = 1) AS min_all_event_type,
      max(value) FILTER (part_hi = 1 AND core) AS max_core,
      max(event_type) FILTER (part_hi = 1 AND core) AS max_core_event_type,
      max(value) FILTER (part_lo = 1 AND core) AS min_core,
      max(event_type) FILTER (part_lo = 1 AND core) AS min_core_event_type,
      max(value) FILTER (part_hi = 1 AND NOT core) AS max_peri,
      max(event_type) FILTER (part_hi = 1 AND NOT core) AS max_peri_event_type,
      max(value) FILTER (part_lo = 1 AND NOT core) AS min_peri,
      max(event_type) FILTER (part_lo = 1 AND NOT core) AS min_peri_event_type
    FROM r GROUP BY user_id
""")
def extreme_rows(s: Sample) -> DataFrame:
    core = F.col("event_type").isin("click", "view")
    return tagged_extremes(
        s.table("events"), "user_id", "value", "event_type", {"all": None, "core": core, "peri": ~core}
    )


FULL_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@register("full_ranking", f"""
    SELECT l_returnflag, l_extendedprice, {', '.join(FULL_ORDER)},
           row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC NULLS LAST, {', '.join(FULL_ORDER)}) AS row_number
    FROM lineitem
""")
def full_ranking(s: Sample) -> DataFrame:
    lines = s.table("lineitem").select("l_returnflag", "l_extendedprice", *FULL_ORDER)
    return number_rows(lines, ["l_returnflag"], [F.desc_nulls_last("l_extendedprice"), *FULL_ORDER])


@register("ranked_series", """
    SELECT stay, quantity, price FROM (
      SELECT l_orderkey AS stay, l_quantity AS quantity, l_extendedprice AS price,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC NULLS LAST,
                                l_extendedprice DESC NULLS LAST) AS rn
      FROM lineitem) WHERE rn = 1
""")
def ranked_series(s: Sample) -> DataFrame:
    w = Window.partitionBy("stay").orderBy(F.desc_nulls_last("quantity"), F.desc_nulls_last("price"))
    rows = s.table("lineitem").select(
        F.col("l_orderkey").alias("stay"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price")
    )
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


# --- episodes -----------------------------------------------------------------------
@register("first_stay", """
    WITH e AS (SELECT o.* FROM orders o WHERE EXISTS (
                 SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 40)),
    n AS (SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate NULLS FIRST, o_orderkey) AS seqnum
          FROM e)
    SELECT o_custkey AS person, o_orderkey AS stay, o_totalprice AS price, CAST(seqnum AS INTEGER) AS seqnum
    FROM n WHERE seqnum = 1 AND o_totalprice >= 100000 AND o_orderstatus = 'F'
""")
def first_stay(s: Sample) -> DataFrame:
    heavy = s.table("lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("o_orderkey"))
    eligible = s.table("orders").join(heavy, "o_orderkey", "left_semi")
    numbered = number_episodes(eligible, "o_custkey", ["o_orderdate", "o_orderkey"])
    return numbered.where("seqnum = 1 AND o_totalprice >= 100000 AND o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("stay"),
        F.col("o_totalprice").alias("price"), "seqnum",
    )


@register("length_of_stay", f"""
    SELECT event_id, round(minute / 60.0) AS los_hours, round(-minute / 60.0) AS before_hours,
           round(round(minute / 60.0) / 24.0, 6) AS los_days
    FROM ({CHARTS_SQL})
""")
def length_of_stay(s: Sample) -> DataFrame:
    hours = whole_hours("minute")
    return charts(s).select(
        "event_id", hours.alias("los_hours"), whole_hours(-F.col("minute")).alias("before_hours"),
        F.round(hours / 24.0, 6).alias("los_days"),
    )


@register("assemble_stay", """
    WITH lines AS (SELECT l_orderkey, max(l_quantity) AS quantity_max, round(avg(l_extendedprice), 6) AS price_avg,
                          max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
                   FROM lineitem GROUP BY 1),
    costly AS (SELECT l_orderkey, min(l_discount) AS discount_min FROM lineitem WHERE l_extendedprice > 80000 GROUP BY 1),
    stay AS (SELECT o.o_custkey AS person, o.o_orderkey AS stay, n.n_name AS region, c.c_mktsegment AS unit,
               CASE WHEN lower(o.o_orderstatus) LIKE '%f%' THEN 1 WHEN lower(o.o_orderstatus) LIKE '%o%' THEN 0 END
                 AS died,
               l.quantity_max, l.price_avg, coalesce(l.returned, 0) AS returned, k.discount_min,
               CASE WHEN k.discount_min IS NOT NULL THEN 1 ELSE 0 END AS costly_flag,
               CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS INTEGER) AS seqnum
             FROM orders o JOIN lines l ON o.o_orderkey = l.l_orderkey
             LEFT JOIN costly k ON o.o_orderkey = k.l_orderkey
             LEFT JOIN customer c ON o.o_custkey = c.c_custkey
             LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey)
    SELECT * FROM stay WHERE seqnum = 1
""")
def assemble_stay(s: Sample) -> DataFrame:
    lines = s.table("lineitem").withColumnRenamed("l_orderkey", "stay")
    summary = lines.groupBy("stay").agg(
        F.max("l_quantity").alias("quantity_max"), F.round(F.avg("l_extendedprice"), 6).alias("price_avg"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"),
    )
    costly = lines.where("l_extendedprice > 80000").groupBy("stay").agg(F.min("l_discount").alias("discount_min"))
    status = F.lower("o_orderstatus")
    orders = s.table("orders").select(
        F.col("o_custkey").alias("person"), F.col("o_orderkey").alias("stay"),
        F.when(status.contains("f"), 1).when(status.contains("o"), 0).alias("died"),
    )
    people = s.table("customer").select(
        F.col("c_custkey").alias("person"), F.col("c_mktsegment").alias("unit"), "c_nationkey"
    )
    nations = s.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    firsts = first_episode(orders.join(summary, "stay"), "person", ["stay"])
    return (
        firsts.join(costly, "stay", "left").join(people, "person", "left").join(nations, "c_nationkey", "left")
        .select("person", "stay", "region", "unit", "died", "quantity_max", "price_avg",
                F.coalesce("returned", F.lit(0)).alias("returned"), "discount_min",
                present("discount_min").alias("costly_flag"), F.lit(1).alias("seqnum"))
    )


@register("status_recode", """
    WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Expired' WHEN 'O' THEN 'ALIVE' ELSE 'pending' END AS st,
                      CASE o_orderpriority WHEN '1-URGENT' THEN 'Female' WHEN '2-HIGH' THEN 'Male'
                           WHEN '3-MEDIUM' THEN 'FEMALE' ELSE 'other' END AS sx FROM orders)
    SELECT o_orderkey AS stay,
           CASE WHEN lower(st) LIKE '%alive%' THEN 0 WHEN lower(st) LIKE '%expired%' THEN 1 END AS mortality,
           CASE WHEN lower(sx) LIKE '%female%' THEN 0 WHEN lower(sx) LIKE '%male%' THEN 1 END AS sex
    FROM t
""")
def status_recode(s: Sample) -> DataFrame:
    from episodica.functions.columns import sex_code

    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    text = s.table("orders").select(
        F.col("o_orderkey").alias("stay"),
        F.when(status == "F", "Expired").when(status == "O", "ALIVE").otherwise("pending").alias("st"),
        F.when(priority == "1-URGENT", "Female").when(priority == "2-HIGH", "Male")
        .when(priority == "3-MEDIUM", "FEMALE").otherwise("other").alias("sx"),
    )
    return text.select("stay", vital_status("st").alias("mortality"), sex_code("sx").alias("sex"))
