"""Back-office queries. Orders stand for documents and tasks, customers for users, nations for tenants, events for logs.

Every query takes its moment from NOW, never from the clock, and orders totally before it cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table

NOW = "1998-07-01 12:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


# --- predicates and projections -------------------------------------------------------------------------------


@query("filter_tenant", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7")
def filter_tenant(spark, sf_dir):
    return customers(spark, sf_dir).where("c_nationkey = 7").select("c_custkey", "c_name")


@query("filter_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'")
def filter_range(spark, sf_dir):
    return orders(spark, sf_dir).where("o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-02-01'").select("o_orderkey")


@query("filter_end_of_day", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1997-03-05 23:59:59' AND o_orderdate >= TIMESTAMP '1997-03-05'")
def filter_end_of_day(spark, sf_dir):
    """Bounds from text: a day that can't be read leaves its side open."""
    low, high, bad = (F.to_timestamp_ntz(F.lit(d)) if d else F.lit(None).cast("timestamp_ntz") for d in ("1997-03-05", "1997-03-05", None))
    end = high + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    at = F.col("o_orderdate")
    return orders(spark, sf_dir).where((at >= low) & (at <= end) & (bad.isNull() | (at >= bad))).select("o_orderkey")


@query("filter_in", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
@query("filter_in_whole", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in_whole(spark, sf_dir):
    return orders(spark, sf_dir).where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus")


@query("filter_not_in", "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus NOT IN ('F') AND o_orderdate IS NOT NULL GROUP BY 1")
def filter_not_in(spark, sf_dir):
    return orders(spark, sf_dir).where(~F.col("o_orderstatus").isin("F") & F.col("o_orderdate").isNotNull()).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("filter_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_type ILIKE 'prom%'")
def filter_ilike(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%RED%") | F.col("p_type").ilike("prom%")).select("p_partkey", "p_name")


@query("filter_day", "SELECT event_id FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15'")
def filter_day(spark, sf_dir):
    day = F.lit("2024-01-15").cast("timestamp_ntz")
    return events(spark, sf_dir).where((F.col("ts") >= day) & (F.col("ts") < day + F.expr("INTERVAL 1 DAY"))).select("event_id")


@query("filter_never", "SELECT o_orderkey FROM orders WHERE false")
def filter_never(spark, sf_dir):
    return orders(spark, sf_dir).where(F.lit(False)).select("o_orderkey")


@query("filter_columns", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey <= l_linenumber")
def filter_columns(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_suppkey <= l_linenumber").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("visible_by_role", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 42 OR (c_nationkey = 3 AND 'coordinador' IN ('admin_estudio', 'coordinador'))")
def visible_by_role(spark, sf_dir):
    """Own rows, and for managers those of their tenant."""
    user, tenant, role = 42, 3, "coordinador"
    seen = F.col("o_custkey") == user
    if role in ("admin_estudio", "coordinador"):
        seen = seen | (F.col("c_nationkey") == tenant)
    return orders(spark, sf_dir).join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).where(seen).select("o_orderkey")


@query("display_names", "SELECT o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'Abierto' WHEN 'F' THEN 'Finalizado' ELSE o_orderstatus END AS shown, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def display_names(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for x in ("O", "Abierto", "F", "Finalizado")))
    state = F.col("o_orderstatus")
    return orders(spark, sf_dir).select(state, F.coalesce(F.try_element_at(names, state), state).alias("shown")).groupBy("o_orderstatus", "shown").agg(F.count("*").alias("n"))


# --- joins ----------------------------------------------------------------------------------------------------


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000")
def join_inner(spark, sf_dir):
    return orders(spark, sf_dir).where("o_totalprice > 450000").join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query(
    "left_join_balance",
    "SELECT c_custkey, balance FROM customer LEFT JOIN "
    "(SELECT user_id, round(sum(value), 2) AS balance FROM events WHERE event_type = 'purchase' GROUP BY 1) ON c_custkey = user_id ORDER BY balance DESC NULLS LAST, c_custkey",
)
@query(
    "left_join_balance_whole",
    "SELECT c_custkey, balance FROM customer LEFT JOIN "
    "(SELECT user_id, round(sum(value), 2) AS balance FROM events WHERE event_type = 'purchase' GROUP BY 1) ON c_custkey = user_id ORDER BY balance DESC NULLS LAST, c_custkey",
)
def left_join_balance_whole(spark, sf_dir):
    """Every user, in order; the sort keys stand for the place number."""
    credit = events(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("balance"))
    rows = customers(spark, sf_dir).join(credit, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "balance")
    return rows.orderBy(F.col("balance").desc_nulls_last(), "c_custkey")


@query("semi_assigned", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_assigned(spark, sf_dir):
    urgent = orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'")
    return customers(spark, sf_dir).join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("exists_or", "SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)")
def exists_or(spark, sf_dir):
    big = orders(spark, sf_dir).where("o_totalprice > 490000").select("o_custkey").distinct().withColumn("has", F.lit(True))
    return customers(spark, sf_dir).join(big, F.col("c_custkey") == F.col("o_custkey"), "left").where((F.col("c_acctbal") < 0) | F.col("has")).select("c_custkey")


@query("anti_unlinked", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def anti_unlinked(spark, sf_dir):
    open_ = orders(spark, sf_dir).where("o_orderstatus = 'O'")
    return customers(spark, sf_dir).join(open_, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


DUE = "SELECT o_orderkey, o_custkey, date_diff('day', CAST(" + NOW_SQL + " AS DATE), CAST(o_orderdate AS DATE)) AS days FROM orders"


@query(
    "reminders_due",
    f"WITH d AS ({DUE}), s AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) SELECT o_orderkey, CAST(days AS INTEGER) AS days, CASE days WHEN 1 THEN 'urgente' WHEN 2 THEN 'proximo' ELSE 'recordatorio' END AS kind "
    "FROM d WHERE days IN (1, 2, 3) AND o_orderkey NOT IN (SELECT o_orderkey FROM s)",
)
def reminders_due(spark, sf_dir):
    """Tasks due in one, two or three days for which no reminder went out yet."""
    sent = orders(spark, sf_dir).where("o_orderkey % 3 = 0").select("o_orderkey")
    days = F.datediff(F.col("o_orderdate").cast("date"), now().cast("date"))
    kind = F.when(F.col("days") == 1, "urgente").when(F.col("days") == 2, "proximo").otherwise("recordatorio")
    due = orders(spark, sf_dir).select("o_orderkey", days.alias("days")).where(F.col("days").isin(1, 2, 3))
    return due.join(sent, "o_orderkey", "left_anti").withColumn("kind", kind)


@query(
    "case_team",
    "SELECT n_name AS tenant, c_mktsegment AS team, count(DISTINCT c_custkey)::BIGINT AS users, count(o_orderkey)::BIGINT AS tasks FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL",
)
def case_team(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(customers(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = orders(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("tasks"))
    rows = rows.join(counts, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy(F.col("n_name").alias("tenant"), F.col("c_mktsegment").alias("team")).agg(F.count("*").alias("users"), F.coalesce(F.sum("tasks"), F.lit(0)).alias("tasks"))


@query(
    "custom_fields",
    "SELECT o_custkey, max(o_totalprice) FILTER (o_orderstatus = 'O') AS open_max, max(o_totalprice) FILTER (o_orderstatus = 'F') AS done_max FROM orders GROUP BY 1",
)
def custom_fields(spark, sf_dir):
    """Entity-attribute-value rows as columns."""
    rows = orders(spark, sf_dir).groupBy("o_custkey").pivot("o_orderstatus", ["O", "F"]).agg(F.max("o_totalprice"))
    return rows.select("o_custkey", F.col("O").alias("open_max"), F.col("F").alias("done_max"))


# --- aggregates -----------------------------------------------------------------------------------------------


@query(
    "dashboard_counts",
    f"SELECT count(*)::BIGINT AS total, count(*) FILTER (o_orderdate >= {NOW_SQL} - INTERVAL 7 DAY AND o_orderdate <= {NOW_SQL})::BIGINT AS week, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS open_, "
    f"count(*) FILTER (o_orderstatus <> 'F' AND o_orderdate < {NOW_SQL})::BIGINT AS overdue, count(DISTINCT o_custkey)::BIGINT AS users, "
    f"round(count(*) FILTER (o_orderdate >= {NOW_SQL} - INTERVAL 7 DAY AND o_orderdate <= {NOW_SQL}) / 7.0, 1)::DOUBLE AS per_day FROM orders",
)
def dashboard_counts(spark, sf_dir):
    at, state = F.col("o_orderdate"), F.col("o_orderstatus")
    week = (at >= now() - F.expr("INTERVAL 7 DAY")) & (at <= now())
    return orders(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_if(week).alias("week"), F.count_if(state == "O").alias("open_"), F.count_if((state != "F") & (at < now())).alias("overdue"),
        F.countDistinct("o_custkey").alias("users"), F.round(F.count_if(week) / 7.0, 1).alias("per_day"),
    )


@query("type_mode", "SELECT p_type, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 1")
def type_mode(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "p_type").limit(1)


@query("sum_or_zero", "SELECT coalesce(sum(CAST(l_quantity AS BIGINT)), 0)::BIGINT AS total FROM lineitem WHERE l_returnflag = 'none'")
def sum_or_zero(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'none'").agg(F.coalesce(F.sum(F.col("l_quantity").cast("long")), F.lit(0)).alias("total"))


@query("active_users", "SELECT count(DISTINCT user_id)::BIGINT AS users FROM events WHERE ts >= TIMESTAMP '2024-01-01 09:30:00' AND ts <= TIMESTAMP '2024-01-20 09:30:00'")
def active_users(spark, sf_dir):
    """Distinct users since the first of the month; the cut keeps the time of day."""
    at = F.lit("2024-01-20 09:30:00").cast("timestamp_ntz")
    first = at - F.make_dt_interval(F.dayofmonth(at) - 1)
    return events(spark, sf_dir).where((F.col("ts") >= first) & (F.col("ts") <= at)).agg(F.countDistinct("user_id").alias("users"))


@query("tenant_activity", "SELECT c_nationkey AS tenant, count(DISTINCT c_custkey)::BIGINT AS users, count(event_id)::BIGINT AS events, max(ts) AS last_seen FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def tenant_activity(spark, sf_dir):
    seen = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    rows = customers(spark, sf_dir).join(seen, F.col("user_id") == F.col("c_custkey"), "left")
    return rows.groupBy(F.col("c_nationkey").alias("tenant")).agg(F.count("*").alias("users"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.max("last").alias("last_seen"))


@query("plan_counts", "SELECT c_mktsegment AS plan, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def plan_counts(spark, sf_dir):
    return customers(spark, sf_dir).groupBy(F.col("c_mktsegment").alias("plan")).agg(F.count("*").alias("n"))


@query(
    "team_compliance",
    "SELECT o_custkey AS user_id, count(*)::BIGINT AS tasks, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS done, round_even(100.0 * count(*) FILTER (o_orderstatus = 'F' AND o_totalprice < 250000) / "
    "greatest(count(*) FILTER (o_orderstatus = 'F'), 1) + CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 100 ELSE 0 END, 0)::DOUBLE AS on_time FROM orders GROUP BY ROLLUP (o_custkey)",
)
def team_compliance(spark, sf_dir):
    """Per user and in total; a user without finished tasks is at 100."""
    done = F.count_if(F.col("o_orderstatus") == "F")
    fine = F.count_if((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 250000))
    rate = F.when(done > 0, F.bround(100.0 * fine / F.greatest(done, F.lit(1)), 0)).otherwise(100.0)
    return orders(spark, sf_dir).rollup(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("tasks"), done.alias("done"), rate.alias("on_time"))


@query("pipeline_states", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS pending, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS running, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS finished FROM orders GROUP BY 1")
def pipeline_states(spark, sf_dir):
    state = F.col("o_orderstatus")
    return orders(spark, sf_dir).groupBy("o_custkey").agg(*(F.count_if(state == k).alias(n) for k, n in (("O", "pending"), ("P", "running"), ("F", "finished"))))


@query(
    "calendar_month",
    "WITH d AS (SELECT CAST(unnest(range(DATE '1997-04-28', DATE '1997-06-02', INTERVAL 1 DAY)) AS DATE) AS day), o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*)::BIGINT AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1) "
    "SELECT d.day, CAST(isodow(d.day) AS INTEGER) AS weekday, month(d.day) = 5 AS in_month, coalesce(n, 0)::BIGINT AS n, first_key FROM d LEFT JOIN o ON d.day = o.day",
)
def calendar_month(spark, sf_dir):
    """Whole weeks, Monday first, around a month, with what lies on each day."""
    first = F.lit("1997-05-01").cast("date")
    low, high = F.date_trunc("week", first).cast("date"), F.date_add(F.date_trunc("week", F.last_day(first)).cast("date"), 6)
    days = spark.range(1).select(F.explode(F.sequence(low, high)).alias("day"))
    got = orders(spark, sf_dir).groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))
    rows = F.broadcast(days).join(got, "day", "left")
    return rows.select("day", (F.weekday("day") + 1).alias("weekday"), (F.month("day") == F.month(first)).alias("in_month"), F.coalesce("n", F.lit(0)).alias("n"), "first_key")


@query("addon_total", "SELECT c_mktsegment, sum(CAST(c_acctbal AS DECIMAL(12,2)))::DECIMAL(22,2) AS total, CAST(sum(CAST(c_acctbal AS DECIMAL(12,2))) + count(*) * 15 AS DECIMAL(22,2)) AS with_seats FROM customer GROUP BY 1")
def addon_total(spark, sf_dir):
    total = F.sum(F.col("c_acctbal").cast("decimal(12,2)"))
    return customers(spark, sf_dir).groupBy("c_mktsegment").agg(total.cast("decimal(22,2)").alias("total"), (total + F.count("*") * 15).cast("decimal(22,2)").alias("with_seats"))


@query("max_per_group", "SELECT o_custkey, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def max_per_group(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("o_custkey").agg(F.max("o_orderkey").alias("last_key"))


# --- order, limits, windows, sets -----------------------------------------------------------------------------


@query("topk_recent", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def topk_recent(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(20)


@query(
    "case_rank_order",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS rank, o_orderdate FROM orders ORDER BY rank, o_orderdate ASC NULLS LAST, o_orderkey",
)
@query(
    "case_rank_order_whole",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS rank, o_orderdate FROM orders ORDER BY rank, o_orderdate ASC NULLS LAST, o_orderkey",
)
def case_rank_order_whole(spark, sf_dir):
    """Every order, in order; the sort keys stand for the place number."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    rows = orders(spark, sf_dir).select("o_orderkey", rank.alias("rank"), "o_orderdate")
    return rows.orderBy("rank", F.col("o_orderdate").asc_nulls_last(), "o_orderkey")


@query("latest_per_user", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_per_user(spark, sf_dir):
    return events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(
    "distinct_topk_ips",
    "WITH r AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type <> 'error'), "
    "g AS (SELECT user_id, event_type AS ip, max(ts) AS last FROM r WHERE n <= 15 GROUP BY ALL) SELECT user_id, ip FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY last DESC, ip) <= 2",
)
def distinct_topk_ips(spark, sf_dir):
    """The last distinct addresses among each user's 15 latest successes."""
    by = Window.partitionBy("user_id")
    rows = events(spark, sf_dir).where("event_type <> 'error'").withColumn("n", F.row_number().over(by.orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where("n <= 15")
    last = rows.groupBy("user_id", F.col("event_type").alias("ip")).agg(F.max("ts").alias("last"))
    return last.withColumn("n", F.row_number().over(by.orderBy(F.col("last").desc(), "ip"))).where("n <= 2").select("user_id", "ip")


@query(
    "unusual_ip",
    "WITH s AS (SELECT user_id, event_type, event_id, ts FROM events), p AS (SELECT a.event_id, count(b.event_id) AS seen, count(b.event_id) FILTER (b.event_type = a.event_type) AS same FROM s a LEFT JOIN s b "
    "ON a.user_id = b.user_id AND b.event_type <> 'error' AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) GROUP BY 1) SELECT event_id, (seen > 0 AND same = 0) AS unusual FROM p",
)
def unusual_ip(spark, sf_dir):
    """Whether an address differs from all those of the user's earlier successes, if there were any: two running counts, so that
    no row holds a history."""
    success = F.col("event_type") != "error"
    before = lambda *keys: Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen, same = (F.coalesce(F.count_if(success).over(before(*keys)), F.lit(0)) for keys in (("user_id",), ("user_id", "event_type")))
    return events(spark, sf_dir).select("event_id", ((seen > 0) & (same == 0)).alias("unusual"))


@query("union_lists", "SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_custkey = 5 UNION ALL SELECT 'event', event_id FROM events WHERE user_id = 5")
def union_lists(spark, sf_dir):
    a = orders(spark, sf_dir).where("o_custkey = 5").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    return a.unionByName(events(spark, sf_dir).where("user_id = 5").select(F.lit("event").alias("kind"), F.col("event_id").alias("id")))


@query("set_union", "SELECT DISTINCT event_type AS kind FROM events UNION SELECT DISTINCT o_orderpriority FROM orders")
def set_union(spark, sf_dir):
    a = events(spark, sf_dir).select(F.col("event_type").alias("kind")).distinct()
    return a.union(orders(spark, sf_dir).select("o_orderpriority").distinct()).distinct()


@query(
    "repeated_names",
    "SELECT p_partkey, p_name || CASE WHEN n > 1 THEN ' ' || n ELSE '' END AS name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part)",
)
def repeated_names(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy(F.lower("p_name")).orderBy("p_partkey"))
    rows = table(spark, sf_dir, "part").withColumn("n", n)
    return rows.select("p_partkey", F.when(F.col("n") > 1, F.concat("p_name", F.lit(" "), F.col("n").cast("string"))).otherwise(F.col("p_name")).alias("name"))


# --- dates, conditions, scalars -------------------------------------------------------------------------------


@query(
    "deadline_status",
    f"WITH h AS (SELECT o_orderkey, date_diff('second', {NOW_SQL}, o_orderdate) AS s FROM orders) SELECT o_orderkey, CASE WHEN s < 0 THEN 'vencido' WHEN s <= 86400 THEN 'urgente' WHEN s <= 172800 THEN 'importante' END AS status, "
    "CASE WHEN s < 0 THEN 0 ELSE greatest(1, ceil(s / 86400.0)) END::BIGINT AS days_left FROM h",
)
def deadline_status(spark, sf_dir):
    left = F.timestamp_diff("SECOND", now(), F.col("o_orderdate"))
    rows = orders(spark, sf_dir).select("o_orderkey", left.alias("s"))
    status = F.when(F.col("s") < 0, "vencido").when(F.col("s") <= 86400, "urgente").when(F.col("s") <= 172800, "importante")
    days = F.when(F.col("s") < 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("s") / 86400.0)))
    return rows.select("o_orderkey", status.alias("status"), days.cast("long").alias("days_left"))


@query(
    "page_equivalents",
    "SELECT doc_id, greatest(1, ceil(len(regexp_split_to_array(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '[ \\t\\n\\r]+')) / 500.0))::BIGINT AS pages FROM documents",
)
def page_equivalents(spark, sf_dir):
    words = F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.ceil(F.size(words) / 500.0)).cast("long").alias("pages"))


@query(
    "plan_gate",
    "WITH p(plan, max_users, stats) AS (VALUES ('BUILDING', 40, true), ('MACHINERY', 25, false)), u AS (SELECT c_nationkey AS tenant, min(c_mktsegment) AS plan, count(*) AS users FROM customer GROUP BY 1) "
    "SELECT tenant, users < coalesce(max_users, 10) AS may_add, coalesce(stats, false) AS may_see FROM u LEFT JOIN p USING (plan)",
)
def plan_gate(spark, sf_dir):
    """What a tenant's plan allows; unknown plans fall back to the smallest."""
    plans = spark.createDataFrame([("BUILDING", 40, ["stats"]), ("MACHINERY", 25, [])], "plan string, max_users int, features array<string>")
    users = customers(spark, sf_dir).groupBy(F.col("c_nationkey").alias("tenant")).agg(F.min("c_mktsegment").alias("plan"), F.count("*").alias("users"))
    rows = users.join(F.broadcast(plans), "plan", "left")
    return rows.select("tenant", (F.col("users") < F.coalesce("max_users", F.lit(10))).alias("may_add"), F.coalesce(F.array_contains("features", "stats"), F.lit(False)).alias("may_see"))


@query(
    "password_policy",
    "SELECT c_custkey, length(pw) >= 8 AND regexp_matches(pw, '[A-Z]') AND regexp_matches(pw, '[a-z]') AND regexp_matches(pw, '[0-9]') AND regexp_matches(pw, '[^A-Za-z0-9]') AS fine FROM "
    "(SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN lower(c_name) ELSE 'aB1#' END AS pw FROM customer)",
)
def password_policy(spark, sf_dir):
    pw = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).when(F.col("c_custkey") % 3 == 1, F.lower("c_name")).otherwise("aB1#")
    fine = F.length(pw) >= 8
    for p in ("[A-Z]", "[a-z]", "[0-9]", "[^A-Za-z0-9]"):
        fine = fine & pw.rlike(p)
    return customers(spark, sf_dir).select("c_custkey", fine.alias("fine"))


@query(
    "cost_estimate",
    "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(CASE WHEN l_suppkey % 5 = 0 THEN 150 ELSE l_suppkey % 5 * 100 END * CASE WHEN l_linenumber % 4 = 0 THEN 20 ELSE l_linenumber % 4 * 10 END + CASE WHEN l_partkey % 3 = 0 THEN 3 ELSE l_partkey % 3 END * 200 + 800 AS BIGINT) AS cost FROM lineitem",
)
def cost_estimate(spark, sf_dir):
    """Hours by rate, hearings and fixed costs; zero counts as not given."""
    given = lambda c, default: F.coalesce(F.nullif(c, F.lit(0)), F.lit(default))
    cost = given(F.col("l_suppkey") % 5 * 100, 150) * given(F.col("l_linenumber") % 4 * 10, 20) + given(F.col("l_partkey") % 3, 3) * 200 + 500 + 300
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", cost.cast("long").alias("cost"))


@query("suggested_package", "SELECT c_custkey, CASE WHEN c_acctbal < 20 THEN 300 WHEN c_acctbal <= 200 THEN 800 ELSE 2000 END::INTEGER AS pages FROM customer")
def suggested_package(spark, sf_dir):
    b = F.col("c_acctbal")
    return customers(spark, sf_dir).select("c_custkey", F.when(b < 20, 300).when(b <= 200, 800).otherwise(2000).alias("pages"))


@query(
    "code_validity",
    f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'inactive' WHEN p_size >= 40 THEN 'used_up' WHEN p_partkey % 7 = 0 THEN 'expired' ELSE 'valid' END AS state FROM part",
)
def code_validity(spark, sf_dir):
    state = F.when(F.col("p_size") % 2 == 0, "inactive").when(F.col("p_size") >= 40, "used_up").when(F.col("p_partkey") % 7 == 0, "expired").otherwise("valid")
    return table(spark, sf_dir, "part").select("p_partkey", state.alias("state"))


@query("shortened", "SELECT c_custkey, CASE WHEN length(c_name) > 10 THEN substr(c_name, 1, 3) || '...' || right(c_name, 3) ELSE c_name END AS shown FROM customer")
def shortened(spark, sf_dir):
    n = F.col("c_name")
    return customers(spark, sf_dir).select("c_custkey", F.when(F.length(n) > 10, F.concat(F.substring(n, 1, 3), F.lit("..."), F.right(n, F.lit(3)))).otherwise(n).alias("shown"))


@query("token_hash", "SELECT c_custkey, sha256(c_name) AS token FROM customer")
def token_hash(spark, sf_dir):
    return customers(spark, sf_dir).select("c_custkey", F.sha2(F.col("c_name").cast("binary"), 256).alias("token"))


@query("json_props", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k, to_json({'id': event_id, 'k': CAST(props->>'k' AS INTEGER)})::VARCHAR AS back FROM events")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return events(spark, sf_dir).select("event_id", k.alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), k.alias("k"))).alias("back"))


@query("job_timings", "SELECT event_type, count(*)::BIGINT AS jobs, round(avg(value), 3) AS mean_ms, max(value) AS worst_ms FROM events GROUP BY 1")
def job_timings(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("jobs"), F.round(F.avg("value"), 3).alias("mean_ms"), F.max("value").alias("worst_ms"))


@query(
    "calendar_lists",
    "SELECT CAST(o_orderdate AS DATE) AS day, count(*)::BIGINT AS n, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS entries FROM orders GROUP BY 1",
)
def calendar_lists(spark, sf_dir):
    """What lies on each day, as a list in order."""
    rows = orders(spark, sf_dir).groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("e"))
    return rows.select("day", "n", F.array_join(F.transform("e", lambda e: F.concat(e["o_orderkey"].cast("string"), F.lit(":"), e["o_orderstatus"])), ",").alias("entries"))
