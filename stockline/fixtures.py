"""Domain tables derived from the TPC-H-like test data (integer arithmetic only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# An item key joins seller and card; sellers and cards both stay below this number.
KEY_BASE = 1_000_000_000

CONDITIONS = ["Near Mint", "NM", "nm", "near mint", "Lightly Played", "lightly played",
              " Mint ", "POOR", "Damaged", "", "Excellent", "Played"]
FOILS = ["true", "false", '"yes"', '"off"', '"maybe"', "1"]
LANGUAGES = ["en", "IT", "e", " Japanese ", ""]
SIGNED = ["true", '"no"', "0", "null"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _key() -> Column:
    return F.col("l_suppkey") * KEY_BASE + F.col("l_partkey")


def _items(spark: SparkSession, sf_dir: str, flags: list[str]) -> DataFrame:
    return (table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin(flags))
            .groupBy("l_suppkey", "l_partkey")
            .agg(F.sum("l_quantity").cast("int").alias("quantity"),
                 F.max("l_shipdate").cast("timestamp").alias("updated_at")))


def _price(shift: int) -> Column:
    return (100 + (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + shift) % 5000).cast("int")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, ["A", "R"]).select(
        _key().alias("id"), F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("blueprint_id"),
        _key().cast("string").alias("external_stock_id"), "quantity",
        _price(0).alias("price_cents"), "updated_at")


def export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir, ["N", "R"]).select(
        F.when((F.col("l_suppkey") + F.col("l_partkey")) % 89 != 0, _key()).alias("id"),
        F.col("l_suppkey").alias("user_id"),
        F.when(F.col("l_partkey") % 97 != 0, F.col("l_partkey")).alias("blueprint_id"),
        "quantity", _price(7).alias("price_cents"), _key().alias("seq"))


def catalog_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = table(spark, sf_dir, "part")
    kind = F.split("p_type", " ")[0]
    number = F.col("p_partkey")
    rules = {
        "cards_prints": kind.isin("STANDARD", "MEDIUM"),
        "op_prints": kind == "PROMO",
        "pk_prints": (kind == "SMALL") | (number % 13 == 0),
        "sealed_products": (kind == "LARGE") | (number % 17 == 0),
    }
    return {
        name: part.where(rule).select((number * 10 + priority).alias("id"), number.alias("blueprint_id"))
        for priority, (name, rule) in enumerate(rules.items(), start=1)
    }


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flattened order events, one row per order line."""
    orders = table(spark, sf_dir, "orders")
    cause = (F.when(F.col("o_orderkey") % 4 == 0, "order.update")
             .when(F.col("o_orderkey") % 4 == 1, "order.destroy").otherwise("order.create"))
    state = (F.when(F.col("o_orderstatus") == "F", "paid")
             .when(F.col("o_orderstatus") == "P", "canceled").otherwise("pending"))
    return (table(spark, sf_dir, "lineitem")
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("l_suppkey").alias("user_id"), _key().cast("string").alias("product_id"),
                    F.col("l_quantity").cast("int").alias("quantity"),
                    F.col("o_orderkey").alias("order_id"),
                    F.col("o_orderdate").cast("timestamp").alias("ts"),
                    F.col("l_linenumber").alias("ln"), cause.alias("cause"), state.alias("state"),
                    F.when(F.col("o_custkey") % 3 == 0, "paid").alias("previous_state")))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested order events: one row per order and seller, as the feed delivers them."""
    item = F.struct("ln", "product_id", "quantity")
    return (lines(spark, sf_dir)
            .groupBy("order_id", "user_id", "ts", "cause", "state", "previous_state")
            .agg(F.array_sort(F.collect_list(item)).alias("_items"))
            .select(
                F.concat_ws("-", "order_id", "user_id").alias("id"), "cause",
                F.lit("live").alias("mode"), "ts", "user_id",
                F.struct(
                    F.col("order_id").alias("id"), "state", "previous_state",
                    F.struct(uuid_text(F.col("user_id")).alias("id")).alias("seller"),
                    F.transform("_items", lambda i: F.struct(i.product_id.alias("product_id"),
                                                             i.quantity.alias("quantity")))
                    .alias("order_items")).alias("data")))


def uuid_text(number: Column) -> Column:
    digits = F.lpad(F.lower(F.hex(number)), 32, "0")
    return F.concat_ws("-", F.substring(digits, 1, 8), F.substring(digits, 9, 4),
                       F.substring(digits, 13, 4), F.substring(digits, 17, 4), F.substring(digits, 21, 12))


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("p_partkey")
    text = F.concat(
        F.lit('{"condition":"'), _pick(CONDITIONS, number), F.lit('","mtg_foil":'), _pick(FOILS, number),
        F.lit(',"mtg_language":"'), _pick(LANGUAGES, number), F.lit('","signed":'), _pick(SIGNED, number),
        F.lit(',"cmc":3,"graded":true,"artist":"A'), (number % 60).cast("string"), F.lit('"}'))
    return table(spark, sf_dir, "part").select(number.alias("blueprint_id"), text.alias("properties"))


def full_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory with every column of the domain schema."""
    return (inventory(spark, sf_dir).join(props(spark, sf_dir), "blueprint_id", "left")
            .select("id", "user_id", "blueprint_id", "quantity", "price_cents", "properties",
                    F.when(F.col("blueprint_id") % 53 != 0, F.col("external_stock_id")).alias("external_stock_id"),
                    F.when(F.col("blueprint_id") % 3 == 0, F.lit("first edition")).alias("description"),
                    F.when(F.col("blueprint_id") % 4 == 0, F.lit("shelf")).alias("user_data_field"),
                    F.when(F.col("blueprint_id") % 5 != 0, F.col("blueprint_id") % 5 == 1).alias("graded"),
                    F.col("updated_at").alias("created_at"), "updated_at"))


def full_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (export(spark, sf_dir).withColumn("_card", F.col("seq") % KEY_BASE)
            .join(props(spark, sf_dir).withColumnRenamed("blueprint_id", "_card"), "_card", "left")
            .select("user_id", "id", "blueprint_id", "quantity", "price_cents",
                    F.when(F.col("_card") % 2 == 0, F.lit("from export")).alias("description"),
                    F.lit(None).cast("string").alias("user_data_field"),
                    F.when(F.col("_card") % 4 == 0, F.lit(True)).alias("graded"),
                    F.col("properties").alias("properties_hash"), "seq"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.max("l_linenumber")
    card = F.col("l_partkey")
    return (table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(m.alias("m"))
            .select(_key().alias("item_id"), F.col("l_suppkey").alias("user_id"),
                    F.when(F.col("m") % 2 == 0, F.col("m") - 2).cast("int").alias("quantity"),
                    F.when(F.col("m") % 3 == 0, 500 + F.col("m")).cast("int").alias("price_cents"),
                    F.lit(None).cast("string").alias("description"),
                    F.when(F.col("m") % 4 == 0, F.lit("  ")).when(F.col("m") % 4 == 1, F.lit("shelf"))
                    .alias("user_data_field"),
                    F.when(F.col("m") == 5, F.lit(True)).alias("graded"),
                    F.when(card % 20 == 0, F.concat(F.lit('{"condition":"'), _pick(CONDITIONS, F.col("m")),
                                                    F.lit('","signed":false,"artist":null}')))
                    .alias("properties")))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line as a purchase request; ids are unique per seller."""
    orders = table(spark, sf_dir, "orders")
    request = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    return (table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
            .agg(F.sum("l_quantity").cast("int").alias("quantity"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(request.alias("request_id"), F.col("l_orderkey").alias("order_id"), _key().alias("item_id"),
                    F.col("l_suppkey").alias("user_id"), "quantity", F.col("o_orderdate").cast("timestamp").alias("ts")))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        number.alias("user_id"), (F.col("s_acctbal") > 0).alias("has_token"),
        F.when(number % 4 != 0, F.concat(F.lit("secret-"), number.cast("string"))).alias("webhook_secret"),
        _pick(["idle", "initial_sync", "active", "error"], number).alias("sync_status"),
        F.when(number % 3 == 0, F.timestamp_seconds(1_700_000_000 + number)).alias("last_sync_at"),
        F.when(number % 4 == 3, F.lit("Remote error")).alias("last_error"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_orderkey")
    kind = (F.when(F.col("o_orderpriority").startswith("1"), "sync_delete")
            .when(F.col("o_orderpriority").startswith("2"), "sync_update").otherwise("bulk_sync"))
    status = (F.when(F.col("o_orderstatus") == "F", "completed")
              .when(F.col("o_orderstatus") == "P", "failed").otherwise("pending"))
    return table(spark, sf_dir, "orders").select(
        number.alias("operation_id"), F.col("o_custkey").alias("user_id"), kind.alias("operation_type"),
        status.alias("status"),
        F.when(number % 5 != 0, F.struct((number % 101).cast("int").alias("progress_percent"),
                                         (number % 7).cast("int").alias("processed")))
        .alias("operation_metadata"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_id")
    kind = F.col("event_type")
    status = (F.when((kind == "error") & (number % 2 == 0), 429).when(kind == "error", 500)
              .when((kind == "signup") & (number % 5 == 0), 404).otherwise(200))
    return table(spark, sf_dir, "events").select(
        number.alias("request_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("endpoint"), F.col("value").alias("duration_s"), status.alias("status_code"))


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as decimals, so that sums do not depend on the order of addition."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("name"), (F.col("user_id") % 3).alias("label"),
        F.col("value").cast("decimal(12,2)").alias("value"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        number.alias("seq"),
        _pick(["start", "success", "failure", "suspend", "remove", "setup"], number).alias("event"),
        F.when(number % 6 == 2, F.concat(F.lit("error "), (number % 10).cast("string"))).alias("error"),
        F.when(number % 6 == 5, F.concat(F.lit("new-"), number.cast("string"))).alias("webhook_secret"))
