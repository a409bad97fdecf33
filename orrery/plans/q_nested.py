"""Nested / explode / semi-join queries (E1-E5, F4-F6, J1-J5, J11, J12, A10-A13, Q-E, Q-R, Q-AE).

``explode_join_mart`` rebuilds the shape of the reference's wash-location
mart over TPC-H tables: per customer a nested list of order-priority
"factions" with their status sets (built by Spark from ``orders``), per order
a nested list of line "commodities" (built from ``lineitem``); then inline
both, join on (customer, priority) and on order key, aggregate the matching
lines per station as text and attach the customer dimension.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators.nested import explode_with_position, has_any, inline_rows, joined_text
from orrery.plans.catalog import register
from orrery.sources.tables import table


def system_docs(orders):
    """Per customer: ``factions`` = list<struct<name, active_states>> and ``ts``."""
    fac = orders.groupBy("o_custkey", "o_orderpriority").agg(
        F.sort_array(F.collect_set("o_orderstatus")).alias("active_states"),
        F.max("o_orderdate").alias("ts"),
    )
    return fac.groupBy("o_custkey").agg(
        F.max("ts").alias("ts"),
        F.collect_list(F.struct(F.col("o_orderpriority").alias("name"), "active_states")).alias("factions"),
    )


def market_docs(lineitem):
    """Per order: ``commodities`` = list<struct<name, buy_price, stock, flag>> and ``market_ts``."""
    return lineitem.groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("market_ts"),
        F.collect_list(
            F.struct(
                F.col("l_partkey").cast("string").alias("name"),
                F.col("l_extendedprice").alias("buy_price"),
                F.col("l_quantity").alias("stock"),
                F.col("l_returnflag").alias("flag"),
            )
        ).alias("commodities"),
    )


@register(
    "explode_join_mart",
    oracle="""
    SELECT o.o_custkey AS system, 'S' || o.o_orderkey AS station, o.o_orderkey AS market_id, o.o_orderpriority AS faction,
           string_agg(i.item, ';' ORDER BY i.item) AS commodities, any_value(last_order) AS infra_ts, any_value(i.last_ship) AS market_ts,
           any_value(c_mktsegment) AS power, any_value(c_nationkey) AS state
    FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS last_order,
                 bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey, o_orderpriority) AS failing FROM orders) o
    JOIN (SELECT l_orderkey, l_returnflag, l_quantity, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS last_ship,
                 printf('%d:%d:%d', l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_quantity) AS BIGINT)) AS item
          FROM lineitem) i ON i.l_orderkey = o.o_orderkey AND i.l_returnflag <> 'N' AND i.l_quantity > 0
    JOIN customer ON c_custkey = o.o_custkey
    WHERE failing
    GROUP BY o.o_custkey, o.o_orderkey, o.o_orderpriority
    """,
    headline=True,
)
def explode_join_mart(spark, sf):
    orders = table(spark, sf, "orders")
    infra = (
        inline_rows(system_docs(orders), "factions")
        .filter(has_any("active_states", ["F"]))
        .select(F.col("o_custkey").alias("system"), F.col("name").alias("faction"), F.col("ts").alias("infra_ts"))
        .distinct()
    )
    stations = orders.filter(F.col("o_orderkey").isNotNull()).select(
        F.col("o_custkey").alias("system"),
        F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("station"),
        F.col("o_orderkey").alias("market_id"),
        F.col("o_orderpriority").alias("faction"),
    )
    # Goods are filtered inside the list, so only wanted ones become rows.
    wanted = F.filter("commodities", lambda c: c["flag"].isin("A", "R") & (c["stock"] > 0))
    comm = inline_rows(market_docs(table(spark, sf, "lineitem")).withColumn("commodities", wanted), "commodities")
    item = F.concat_ws(
        ":",
        F.col("name"),
        F.round(F.col("buy_price") * 100).cast("bigint").cast("string"),
        F.round(F.col("stock")).cast("bigint").cast("string"),
    )
    swc = stations.join(infra, ["system", "faction"]).join(comm, F.col("market_id") == F.col("l_orderkey"))
    wash = swc.groupBy("system", "station", "market_id", "faction").agg(
        joined_text(F.collect_list(item)).alias("commodities"),
        F.max("infra_ts").alias("infra_ts"),
        F.max("market_ts").alias("market_ts"),
    )
    cust = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("system"), F.col("c_mktsegment").alias("power"), F.col("c_nationkey").alias("state")
    )
    return wash.join(cust, "system")


@register(
    "dimension_profile",
    oracle="""
    SELECT dim, count(*) AS n, round(avg(CAST(x AS DOUBLE)), 6) AS mean_x,
           CAST(min(x) AS DOUBLE) AS min_x, CAST(max(x) AS DOUBLE) AS max_x
    FROM (SELECT generate_subscripts(embedding, 1) AS dim, unnest(embedding) AS x FROM embeddings) t
    GROUP BY dim
    """,
)
def dimension_profile(spark, sf):
    """Q-AE/E5: flatten the nested vector column with 1-based positions."""
    e = table(spark, sf, "embeddings")
    flat = explode_with_position(e, "embedding", "x", pos="dim", keep=["vec_id"])
    return flat.groupBy(F.col("dim").cast("bigint").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("x").cast("double")), 6).alias("mean_x"),
        F.min("x").cast("double").alias("min_x"),
        F.max("x").cast("double").alias("max_x"),
    )


@register(
    "exists_flag",
    oracle="""
    SELECT c_custkey, c_name,
           EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey
                   AND o.o_orderpriority = '1-URGENT') AS has_urgent
    FROM customer c
    """,
)
def exists_flag(spark, sf):
    """correlated EXISTS as a boolean column (decorrelated to an ExistenceJoin)."""
    c = table(spark, sf, "customer").alias("c")
    o = table(spark, sf, "orders").alias("o")
    sub = o.where((F.col("o.o_custkey") == F.col("c.c_custkey").outer()) & (F.col("o.o_orderpriority") == "1-URGENT"))
    return c.select("c_custkey", "c_name", sub.exists().alias("has_urgent"))


@register(
    "semi_join",
    oracle="""
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    """,
)
def semi_join(spark, sf):
    """IN-subquery as a left semi join."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi")


@register(
    "anti_join",
    oracle="""
    SELECT c_custkey, c_name FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
    """,
)
def anti_join(spark, sf):
    """Customers without a finished order, a left anti join."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti")


@register(
    "distinct_configs",
    oracle="""
    SELECT cfg.brand AS brand, cfg.size AS size, n FROM (
      SELECT {'brand': p_brand, 'size': p_size} AS cfg, count(*) AS n FROM part GROUP BY 1) t
    """,
)
def distinct_configs(spark, sf):
    """Q-R: group by a struct value (distinct configurations with counts)."""
    p = table(spark, sf, "part")
    g = p.groupBy(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")).alias("cfg"))
    return g.agg(F.count(F.lit(1)).alias("n")).select("cfg.brand", "cfg.size", "n")


@register(
    "left_join_default",
    oracle="""
    SELECT c.c_custkey, c.c_name, coalesce(n.n_name, '') AS n_name, coalesce(o.n_orders, 0) AS n_orders
    FROM customer c
    LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey
    """,
)
def left_join_default(spark, sf):
    """Left joins to a dimension and to an aggregated subquery,
    NULL-defaulted."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    out = c.join(n, "c_nationkey", "left").join(o, "c_custkey", "left")
    return out.select(
        "c_custkey", "c_name",
        F.coalesce(F.col("n_name"), F.lit("")).alias("n_name"),
        F.coalesce(F.col("n_orders"), F.lit(0)).cast("bigint").alias("n_orders"),
    )
