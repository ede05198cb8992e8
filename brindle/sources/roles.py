"""The retail roles of the star tables: sales lines, the dense demand grid, inventory snapshots, prices, promotions.

Money is exact decimal arithmetic until a result is cast to double, so sums do not depend on the order of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A promotion starts every so many days from the first day on, so the days before the first are out of bounds.  Their names and
#: lengths take turns; every seventh lasts ``LONG`` days and overlaps others.
EVERY, NAMES, DAYS, LONG = 30, ("opening", "winter", "spring"), (14, 10, 21), 100
#: Lines of a part, where sales are dealt out by order, which pays from so many parts on.
ORDER_LINES, DEALT_FROM = 500_000, 16
#: From so many rows on, products and stores are hashed within their partition before sales are dealt out by order.
HASHED_FROM = 2_000_000
REORDER_POINT, SAFETY_STOCK, FIRST_STOCK = 20, 5, 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, d: str, by_order: bool = False, dealt_out: bool = True) -> DataFrame:
    """One row a sales line with its store, region, product and money.

    ``by_order`` is for what groups lines by order: orders get their stores and lines their products first, and both are dealt
    out by order last, in parts whose number follows the counted lines (Spark's own number at least), so that no task grows with the tables.
    Many products or stores are hashed within their partition, so no task sorts what meets them and none holds them all.
    Without ``dealt_out`` only the order of the joins is such, so lines travel twice, not three times; for sums, which large parts shorten.
    """
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"))
    store = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, d, "region").select("r_regionkey", "r_name")
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    lines = table(spark, d, "lineitem")
    gross = F.col("l_extendedprice").cast("decimal(18,2)")
    off = gross * F.col("l_discount").cast("decimal(4,2)")
    placed = lambda df: (
        df.join(store, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    same_order, same_part = F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_partkey") == F.col("p_partkey")
    if by_order:
        parts = math.ceil(lines.count() / ORDER_LINES) if dealt_out else 0
        dealt = lambda df, key: df.repartition(parts, key) if parts >= DEALT_FROM else df
        hashed = lambda df: df.hint("shuffle_hash") if parts >= DEALT_FROM and df.count() >= HASHED_FROM else df
        part, store = hashed(part), hashed(store)
        joined = dealt(lines.join(part, same_part), "l_orderkey").join(dealt(placed(orders), "o_orderkey"), same_order)
    else:
        joined = placed(lines.join(orders, same_order)).join(part, same_part)
    return joined.select(
        F.col("l_orderkey").alias("order_id"), "order_date", F.to_date("l_shipdate").alias("sale_date"), F.col("c_custkey").alias("store_id"),
        F.col("c_nationkey").alias("cell_id"), F.col("n_regionkey").alias("region_id"), F.col("r_name").alias("region_name"), F.col("c_mktsegment").alias("channel"),
        F.col("l_partkey").alias("sku_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), (F.col("l_suppkey") % 4).alias("warehouse_id"),
        F.col("l_quantity").cast("long").alias("units"), gross.alias("gross"), off.alias("discount"), (gross - off).alias("net"),
        (F.col("l_discount") >= 0.05).alias("is_promo"), F.col("l_linestatus").alias("line_status"), F.col("l_returnflag").alias("return_flag"), F.col("l_linenumber").alias("line_number"),
    )


def ends(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last day with sales: low, high (one row)."""
    day = F.to_date("l_shipdate")
    return table(spark, d, "lineitem").agg(F.min(day).alias("low"), F.max(day).alias("high"))


def calendar(spark: SparkSession, d: str) -> DataFrame:
    """Every day from the first to the last with sales."""
    return ends(spark, d).filter("low is not null").select(F.explode(F.sequence("low", "high")).alias("d"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The month ends within the calendar (one row a month)."""
    return calendar(spark, d).select(F.col("d").alias("snapshot_date")).filter(F.col("snapshot_date") == F.last_day("snapshot_date"))


def split_day(spark: SparkSession, d: str, share: float) -> str:
    """The day that ends the first ``share`` of the calendar."""
    low, high = ends(spark, d).first()
    return str(low + (high - low) * share)


def split_sql(share: float) -> str:
    """:func:`split_day` for DuckDB, over the common table expression ``calendar``."""
    return f"(SELECT min(d) + floor((max(d) - min(d)) * {share})::INT FROM calendar)"


def grid(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Every day x cell x category with its units, zero where nothing was sold.  ``rows``: the sales, or their sums by day, cell and category."""
    cells = table(spark, d, "nation").select(F.col("n_nationkey").alias("cell_id"), F.col("n_regionkey").alias("region_id"))
    categories = table(spark, d, "part").select(F.col("p_type").alias("category")).distinct()
    sold = (sales(spark, d) if rows is None else rows).groupBy(F.col("sale_date").alias("d"), "cell_id", "category")
    sold = sold.agg(F.sum("units").alias("sold"), F.sum("net").alias("net"), F.max("is_promo").alias("promo"))
    # The product of three dimensions (days, cells and categories; no fact) is the grid itself.
    dense = calendar(spark, d).crossJoin(cells).crossJoin(categories)
    full = dense.join(sold, ["d", "cell_id", "category"], "left")
    return full.select("d", "cell_id", "region_id", "category", F.coalesce("sold", F.lit(0)).alias("units"), F.coalesce(F.col("net").cast("double"), F.lit(0.0)).alias("revenue"), F.coalesce("promo", F.lit(False)).alias("is_promo"))


def moved(spark: SparkSession, d: str) -> DataFrame:
    """Receipts less issues (change) of the days, warehouses and categories that have any."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    change = F.sum(F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).otherwise(-F.col("l_quantity")).cast("long"))
    return rows.groupBy(F.to_date("l_shipdate").alias("d"), (F.col("l_suppkey") % 4).alias("warehouse_id"), F.col("p_type").alias("category")).agg(change.alias("change"))


def inventory(spark: SparkSession, d: str, changes: DataFrame | None = None) -> DataFrame:
    """Daily stock of every warehouse x category: the first stock plus the running receipts less issues.  ``changes``: a stored :func:`moved`."""
    from pyspark.sql import Window

    changes = moved(spark, d) if changes is None else changes
    warehouses = spark.range(4).select(F.col("id").alias("warehouse_id"))
    categories = table(spark, d, "part").select(F.col("p_type").alias("category")).distinct()
    full = calendar(spark, d).crossJoin(warehouses).crossJoin(categories).join(changes, ["d", "warehouse_id", "category"], "left")
    running = Window.partitionBy("warehouse_id", "category").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("change", F.coalesce("change", F.lit(0)))
    return full.select("d", "warehouse_id", "category", "change", (F.lit(FIRST_STOCK) + F.sum("change").over(running)).alias("available"))


def prices(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """Weekly prices with an inclusive validity, by cell and category.  ``rows``: the sales, or their sums by day, cell and category."""
    week = F.trunc("sale_date", "week")
    # Cut to ten-thousandths in whole numbers, so that no rounding of halves comes in.
    price = F.expr("cast(sum(net) * 10000 as bigint) div sum(units)") / 10000
    weekly = (sales(spark, d) if rows is None else rows).groupBy("cell_id", "category", week.alias("valid_from")).agg(price.alias("price"))
    return weekly.select("cell_id", "category", "valid_from", F.date_add("valid_from", 6).alias("valid_to"), "price")


def promotions(spark: SparkSession, d: str) -> DataFrame:
    """One row a promotion: promotion_id, promotion_name, start_date, end_date, days (one in ``EVERY`` days of the calendar)."""
    k = F.col("k")
    days = F.when(k % 7 == 3, LONG).otherwise(F.element_at(F.array(*map(F.lit, DAYS)), k % 3 + 1))
    rows = ends(spark, d).filter("low is not null").select("low", F.explode(F.sequence(F.lit(0), F.floor(F.datediff("high", "low") / EVERY).cast("int"))).alias("k"))
    rows = rows.select((k + 1).alias("promotion_id"), F.element_at(F.array(*map(F.lit, NAMES)), k % 3 + 1).alias("promotion_name"), F.expr(f"date_add(low, {EVERY} * k)").alias("start_date"), days.alias("days"))
    return rows.select("promotion_id", "promotion_name", "start_date", F.expr("date_add(start_date, days - 1)").alias("end_date"), "days")


# The same roles for DuckDB, as common table expressions.
SQL_ROLES = {
    "sales": """sales AS (
  SELECT l_orderkey AS order_id, o_orderdate::DATE AS order_date, l_shipdate::DATE AS sale_date, c_custkey AS store_id, c_nationkey AS cell_id, n_regionkey AS region_id,
         r_name AS region_name, c_mktsegment AS channel, l_partkey AS sku_id, p_brand AS brand, p_type AS category, l_suppkey % 4 AS warehouse_id, l_quantity::BIGINT AS units,
         l_extendedprice::DECIMAL(18,2) AS gross, l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2) AS discount,
         l_extendedprice::DECIMAL(18,2) - l_extendedprice::DECIMAL(18,2) * l_discount::DECIMAL(4,2) AS net,
         l_discount >= 0.05 AS is_promo, l_linestatus AS line_status, l_returnflag AS return_flag, l_linenumber AS line_number
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)""",
    "calendar": "calendar AS (SELECT unnest(generate_series(low, high, INTERVAL 1 DAY))::DATE AS d FROM (SELECT min(l_shipdate::DATE) AS low, max(l_shipdate::DATE) AS high FROM lineitem))",
    "grid": """grid AS (
  SELECT c.d, n_nationkey AS cell_id, n_regionkey AS region_id, p.category, coalesce(s.sold, 0)::BIGINT AS units, coalesce(s.net, 0)::DOUBLE AS revenue, coalesce(s.promo, false) AS is_promo
  FROM calendar c CROSS JOIN nation CROSS JOIN (SELECT DISTINCT p_type AS category FROM part) p
  LEFT JOIN (SELECT sale_date, cell_id, category, sum(units) AS sold, sum(net) AS net, bool_or(is_promo) AS promo FROM sales GROUP BY ALL) s
  ON s.sale_date = c.d AND s.cell_id = n_nationkey AND s.category = p.category)""",
    "inventory": f"""inventory AS MATERIALIZED (
  SELECT d, warehouse_id, category, change, ({FIRST_STOCK} + sum(change) OVER (PARTITION BY warehouse_id, category ORDER BY d))::BIGINT AS available FROM (
    SELECT c.d, w.warehouse_id, p.category, coalesce(m.change, 0)::BIGINT AS change
    FROM calendar c CROSS JOIN (SELECT unnest(range(4)) AS warehouse_id) w CROSS JOIN (SELECT DISTINCT p_type AS category FROM part) p
    LEFT JOIN (SELECT l_shipdate::DATE AS d, l_suppkey % 4 AS warehouse_id, p_type AS category, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END) AS change
               FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) m
    ON m.d = c.d AND m.warehouse_id = w.warehouse_id AND m.category = p.category))""",
    "prices": """prices AS (
  SELECT cell_id, category, date_trunc('week', sale_date)::DATE AS valid_from, (date_trunc('week', sale_date) + INTERVAL 6 DAY)::DATE AS valid_to,
         ((sum(net) * 10000)::BIGINT // sum(units)::BIGINT) / 10000::DOUBLE AS price FROM sales GROUP BY ALL)""",
    "promotions": f"""promotions AS (
  SELECT (k + 1)::INT AS promotion_id, ({list(NAMES)})[k % 3 + 1] AS promotion_name, low + ({EVERY} * k)::INT AS start_date, low + ({EVERY} * k)::INT + days - 1 AS end_date, days
  FROM (SELECT low, k, (CASE WHEN k % 7 = 3 THEN {LONG} ELSE ({list(DAYS)})[k % 3 + 1] END)::INT AS days
        FROM (SELECT min(d) AS low, unnest(range((max(d) - min(d)) // {EVERY} + 1)) AS k FROM calendar)))""",
}
_NEEDS = {"grid": ["calendar", "sales"], "inventory": ["calendar"], "prices": ["sales"], "promotions": ["calendar"]}


def oracle(body: str, *roles: str) -> str:
    """``body`` behind the common table expressions of ``roles`` and what they need; ``body`` may start with its own."""
    names: list[str] = []
    for r in roles:
        names += [x for x in [*_NEEDS.get(r, []), r] if x not in names]
    ctes = ",\n".join(SQL_ROLES[n] for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}" if ctes else body
    return f"WITH {ctes}\n{body}" if ctes else body
