"""Synthetic shop tables, hash-seeded: the same rows on every run and cluster layout.

Each job takes the keys or days to make rows for, from ``spark.range`` or another table.

Faults are planned by day before anything is made (``fault_plan``, ``with_faults``). The days carry
them in the column ``faults``, which volume, orders and items hand on and heed, so a fault on the items
reaches the order totals; ``planted_faults`` is the ground truth.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowhelm.functions.scalars import hash_fraction
from rowhelm.operators.inject import (
    FAULT_CATEGORY_SHIFT,
    FAULT_NEGATIVE,
    FAULT_NULLS,
    FAULT_SIGNS,
    FAULT_VOLUME_DROP,
    KEEP_SHARE,
    NEGATIVE_SHARE,
    NORMAL_WEIGHTS,
    NULL_SHARE,
    SHIFTED_WEIGHTS,
    pick_weighted,
)

# The categories with their price ranges, and the weighted choices.
PRICE_RANGES = {
    "Electronics": (50, 1000),
    "Clothing": (20, 200),
    "Home": (30, 500),
    "Books": (10, 50),
    "Sports": (25, 300),
}
CATEGORIES = list(PRICE_RANGES)
STATUS_WEIGHTS = {"pending": 0.10, "completed": 0.75, "cancelled": 0.10, "refunded": 0.05}
ITEM_COUNT_WEIGHTS = {"1": 0.40, "2": 0.30, "3": 0.15, "4": 0.10, "5": 0.05}
QUANTITY_WEIGHTS = {"1": 0.70, "2": 0.20, "3": 0.10}
CUSTOMERS = 10_000
WEEKEND_FACTOR = 1.2
NOISE = 0.1

RANK_BLOCK = 4096
ORDER_BLOCK = 10_000
PLANNED = "faults"


def fault_plan(spark: SparkSession, faults: Mapping[int, str | Sequence[str]]) -> DataFrame:
    """``(day_idx, fault)`` from the fault or faults of each day number."""
    rows = [(day, f) for day, planned in sorted(faults.items()) for f in ([planned] if isinstance(planned, str) else planned)]
    unknown = sorted({f for _, f in rows} - set(FAULT_SIGNS))
    if unknown:
        raise ValueError(f"unknown faults: {', '.join(unknown)}")
    return spark.createDataFrame(rows, "day_idx bigint, fault string")


def with_faults(days: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``faults``, the sorted names planned for each day; empty on the other days."""
    per_day = plan.groupBy("day_idx").agg(F.sort_array(F.collect_set("fault")).alias(PLANNED))
    none = F.array().cast("array<string>")
    return days.join(per_day, "day_idx", "left").withColumn(PLANNED, F.coalesce(PLANNED, none))


def planted_faults(days: DataFrame) -> DataFrame:
    """The ground truth ``(day, fault)``: what is planned for a day that exists."""
    return days.select("day", F.explode(PLANNED).alias("fault"))


def _planned_in(df: DataFrame) -> list[str]:
    return [PLANNED] if PLANNED in df.columns else []


def _on_fault(df: DataFrame, fault: str, then: Column, otherwise: Column) -> Column:
    """``then`` on the days with the fault; without a plan the column is not looked for."""
    return F.when(F.array_contains(PLANNED, fault), then).otherwise(otherwise) if _planned_in(df) else otherwise


def _pick(fraction: Column, weights: dict[str, float]) -> Column:
    return pick_weighted(fraction, list(weights), list(weights.values()))


def _uniform_int(fraction: Column, low: int, high: int) -> Column:
    return (F.floor(fraction * (high - low + 1)) + low).cast("bigint")


def synth_products(ids: DataFrame, key: str = "id", seed: int = 42) -> DataFrame:
    """One product per key: an evenly drawn category and a price in its range."""
    number = F.col("product_no")
    category = F.element_at(
        F.array(*[F.lit(c) for c in CATEGORIES]),
        _uniform_int(hash_fraction(seed, "category", number), 1, len(CATEGORIES)).cast("int"),
    )
    ranges = F.create_map(
        *[x for c, (low, high) in PRICE_RANGES.items() for x in (F.lit(c), F.array(F.lit(float(low)), F.lit(float(high))))]
    )
    low, high = ranges[F.col("category")][0], ranges[F.col("category")][1]
    return (
        ids.select(F.col(key).cast("bigint").alias("product_no"))
        .withColumn("category", category)
        .select(
            "product_no",
            F.format_string("PROD_%04d", number).alias("product_id"),
            F.concat(F.lit("Product "), number.cast("string")).alias("name"),
            "category",
            F.round(low + (high - low) * hash_fraction(seed, "price", number), 2).alias("base_price"),
        )
    )


def synth_daily_volume(days: DataFrame, base: Column | int = 1000, seed: int = 42) -> DataFrame:
    """``(day, day_idx, order_count)``: a base volume, busier weekends and +-10 % noise.

    Planned volume drops keep half of the day's orders.
    """
    weekend = F.when(F.col("day_idx") % 7 >= 5, F.lit(WEEKEND_FACTOR)).otherwise(F.lit(1.0))
    noise = (1 - NOISE) + 2 * NOISE * hash_fraction(seed, "volume", F.col("day_idx"))
    base = F.lit(base) if isinstance(base, int) else base
    count = F.floor(base * weekend * noise)
    count = _on_fault(days, FAULT_VOLUME_DROP, F.floor(count * KEEP_SHARE), count)
    return days.select("day", "day_idx", count.cast("bigint").alias("order_count"), *_planned_in(days))


def synth_orders(volume: DataFrame, seed: int = 42) -> DataFrame:
    """``order_count`` orders for each day of :func:`synth_daily_volume`, numbered through.

    A day is cut into blocks that are spread over the cluster before they are filled, so
    that a single busy day is not written by one task. Their number of partitions is given, or adaptive
    execution would put the few rows of the blocks, and all that is made from them, into one. Planned
    missing customers are NULL in a fifth of the day's orders.
    """
    planned = _planned_in(volume)
    partitions = int(volume.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One row per day, so a single window is small.
    earlier = Window.partitionBy(F.lit(1)).orderBy("day_idx").rowsBetween(Window.unboundedPreceding, -1)
    last = F.floor((F.col("order_count") - 1) / ORDER_BLOCK)
    blocks = (
        volume.withColumn("offset", F.coalesce(F.sum("order_count").over(earlier), F.lit(0)))
        .filter(F.col("order_count") > 0)
        .select("day", "offset", "order_count", *planned, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("block"))
        .repartition(partitions, "day", "block")
    )
    start = F.col("block") * ORDER_BLOCK + 1
    end = F.least(start + ORDER_BLOCK - 1, F.col("order_count"))
    orders = blocks.select("day", "offset", *planned, F.explode(F.sequence(start, end)).alias("in_day")).select(
        "day", *planned, (F.col("offset") + F.col("in_day")).alias("order_no")
    )
    number = F.col("order_no")
    customer = F.format_string("CUST_%05d", _uniform_int(hash_fraction(seed, "customer", number), 1, CUSTOMERS))
    known = F.when(hash_fraction(seed, "missing customer", number) >= NULL_SHARE, customer)
    minute = _uniform_int(hash_fraction(seed, "minute", number), 0, 24 * 60 - 1)
    return orders.select(
        F.format_string("ORD_%06d", number).alias("order_id"),
        _on_fault(orders, FAULT_NULLS, known, customer).alias("customer_id"),
        (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(mins=minute.cast("int"))).alias("order_date"),
        _pick(hash_fraction(seed, "status", number), STATUS_WEIGHTS).alias("status"),
        _pick(hash_fraction(seed, "items", number), ITEM_COUNT_WEIGHTS).cast("bigint").alias("item_count"),
        *planned,
    )


def ranked_products(products: DataFrame) -> DataFrame:
    """``(category, rank, category_size, product_id, base_price)``, ranks from 0 per category.

    Five categories would make five tasks of one window over all products. So products are
    ranked within blocks of keys, and the blocks of a category are lined up by their sizes.
    """
    blocked = products.withColumn("block", F.floor(F.col("product_no") / RANK_BLOCK))
    in_block = Window.partitionBy("category", "block").orderBy("product_no")
    by_block = Window.partitionBy("category").orderBy("block")
    sizes = (
        blocked.groupBy("category", "block")
        .agg(F.count(F.lit(1)).alias("size"))
        .withColumn("offset", F.coalesce(F.sum("size").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("category_size", F.sum("size").over(Window.partitionBy("category")))
    )
    return (
        blocked.withColumn("rank", F.row_number().over(in_block) - 1)
        .join(sizes.drop("size"), ["category", "block"])
        .select("category", (F.col("rank") + F.col("offset")).alias("rank"), "category_size", "product_id", "base_price")
    )


def _drawn(weights: Sequence[float], sizes: Mapping[str, int]) -> dict[str, float]:
    """An item is drawn among the categories that have products, so no order loses items."""
    drawn = {c: w for c, w in zip(CATEGORIES, weights) if c in sizes}
    all_weights = 1.0 if len(drawn) == len(CATEGORIES) else sum(drawn.values()) or 1.0
    return {c: w / all_weights for c, w in drawn.items()}


def synth_items(
    orders: DataFrame,
    products: DataFrame,
    seed: int = 42,
    weights: list[float] | None = None,
) -> DataFrame:
    """One to five items per order; the product is found by category and rank.

    A category is drawn first, then one of its products. The join key is (category, rank),
    which spreads a popular category over all its products. The join is a merge join by hint: the lines
    are made from few rows, so by their estimated size they would be broadcast. On days with the planned
    faults the categories have other weights, or a twentieth of the prices is negative.
    """
    planned = _planned_in(orders)
    # At most one row per category of the fixed list.
    counted = products.filter(F.col("category").isin(CATEGORIES)).groupBy("category").count().collect()
    sizes = {row["category"]: row["count"] for row in counted}
    if not sizes:
        raise ValueError("no products of a known category")
    drawn, shifted = _drawn(weights or NORMAL_WEIGHTS, sizes), _drawn(SHIFTED_WEIGHTS, sizes)
    category_size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("category")]
    lines = orders.select("order_id", *planned, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("item_count"))).alias("line"))
    key = [F.col("order_id"), F.col("line")]
    fraction = hash_fraction(seed, "item category", *key)
    lines = lines.select(
        "order_id",
        "line",
        *planned,
        _on_fault(lines, FAULT_CATEGORY_SHIFT, _pick(fraction, shifted), _pick(fraction, drawn)).alias("category"),
        hash_fraction(seed, "product", *key).alias("product_fraction"),
        _pick(hash_fraction(seed, "quantity", *key), QUANTITY_WEIGHTS).cast("bigint").alias("quantity"),
        ((1 - NOISE) + 2 * NOISE * hash_fraction(seed, "item price", *key)).alias("price_factor"),
    )
    lines = lines.withColumn("rank", F.floor(F.col("product_fraction") * category_size).cast("bigint"))
    price = F.round(F.col("base_price") * F.col("price_factor"), 2)
    negative = F.when(hash_fraction(seed, "negative price", *key) < NEGATIVE_SHARE, -F.abs(price)).otherwise(price)
    price = _on_fault(lines, FAULT_NEGATIVE, negative, price)
    return lines.join(ranked_products(products).drop("category_size").hint("merge"), ["category", "rank"]).select(
        F.format_string("ITEM_%s_%d", "order_id", "line").alias("item_id"),
        "order_id",
        "product_id",
        "quantity",
        price.alias("unit_price"),
        F.round(price * F.col("quantity"), 2).alias("line_total"),
    )


def synth_order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """The orders with ``total_amount``, the sum of price times quantity of their items; 0 without items."""
    totals = items.groupBy("order_id").agg(
        F.round(F.sum(F.col("unit_price") * F.col("quantity")), 2).alias("total_amount")
    )
    return orders.join(totals, "order_id", "left").fillna(0.0, ["total_amount"])
