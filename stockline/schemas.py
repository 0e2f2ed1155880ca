"""Schemas of the stored tables and of the feeds, as DDL text."""

from __future__ import annotations

INVENTORY = (
    "id long, user_id string, blueprint_id int, quantity int, price_cents int, properties string, "
    "external_stock_id string, description string, user_data_field string, graded boolean, "
    "created_at timestamp, updated_at timestamp")

SETTINGS = (
    "user_id string, has_token boolean, webhook_secret string, sync_status string, "
    "last_sync_at timestamp, last_error string, created_at timestamp, updated_at timestamp")

PROGRESS_DDL = ("total_products: long, total_chunks: long, processed_chunks: long, progress_percent: int, "
                "processed: long, created: long, updated: long, skipped: long")

OPERATIONS = (
    "id long, user_id string, operation_id string, operation_type string, status string, "
    f"operation_metadata struct<{PROGRESS_DDL}>, created_at timestamp, completed_at timestamp")

CATALOG = ("id long, blueprint_id int")

EXPORT = (
    "id long, blueprint_id long, expansion_id long, quantity int, price_cents int, description string, "
    "user_data_field string, graded boolean, properties_hash string, name_en string")

ORDER_EVENT = (
    "id string, cause string, mode string, data struct<id: long, state: string, previous_state: string, "
    "seller: struct<id: string>, order_items: array<struct<product_id: string, quantity: int>>>")

EVENT_ENVELOPE = "received_at timestamp, user_id string, signature string, body string"

SERVICE_LOG = (
    "timestamp string, level string, logger string, message string, trace_id string, user_id string, "
    "request_id string, operation string, duration_seconds double, data string")

# Catalog tables in order of priority.
CATALOG_TABLES = ["cards_prints", "op_prints", "pk_prints", "sealed_products"]

# States of a seller's synchronisation.
SYNC_STATUSES = ["idle", "initial_sync", "active", "error"]
