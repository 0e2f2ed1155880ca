"""Registered queries: sources, catalog and bulk synchronisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockline import fixtures as fx
from stockline.operators import catalog as c
from stockline.operators import products as p
from stockline.plans import bulk
from stockline.registry.views import with_views
from stockline.session import cut

QUERIES = {}


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function
    return add


def resolved(spark, sf_dir, **options):
    return c.resolve_catalog(c.catalog_union(fx.catalog_tables(spark, sf_dir), distinct=False), **options)


def outcomes(spark, sf_dir):
    return bulk.classify_export(fx.export(spark, sf_dir), resolved(spark, sf_dir), fx.inventory(spark, sf_dir))


@query(with_views("catalog export", """
    SELECT print_id, table_name, blueprint_id, priority FROM catalog
    WHERE blueprint_id IN (SELECT blueprint_id FROM export)"""))
def catalog_union(spark, sf_dir):
    return c.catalog_union(fx.catalog_tables(spark, sf_dir), needed=fx.export(spark, sf_dir))


@query(with_views("resolved", "SELECT * FROM resolved"))
def resolve_catalog(spark, sf_dir):
    return resolved(spark, sf_dir)


@query(with_views("catalog", """
    SELECT blueprint_id, print_id, table_name FROM catalog
    QUALIFY row_number() OVER (PARTITION BY blueprint_id ORDER BY priority DESC, print_id)=1"""))
def resolve_catalog_last(spark, sf_dir):
    return resolved(spark, sf_dir, on_conflict="last")


@query(with_views("export resolved", """
    SELECT e.user_id, e.id, e.blueprint_id, r.print_id, r.table_name
    FROM export e LEFT JOIN resolved r ON e.blueprint_id=r.blueprint_id
    WHERE coalesce(e.id,0)<>0 AND coalesce(e.blueprint_id,0)<>0"""))
def map_to_catalog(spark, sf_dir):
    mapped = c.map_to_catalog(p.valid_products(fx.export(spark, sf_dir)), resolved(spark, sf_dir))
    return mapped.select("user_id", "id", "blueprint_id", "print_id", "table_name")


@query(with_views("export", """
    SELECT * FROM export WHERE coalesce(id,0)<>0 AND coalesce(blueprint_id,0)<>0"""))
def valid_products(spark, sf_dir):
    return p.valid_products(fx.export(spark, sf_dir))


@query(with_views("export resolved", """
    SELECT e.id, e.blueprint_id, e.user_id, e.seq, r.print_id, r.table_name
    FROM export e JOIN resolved r ON e.blueprint_id=r.blueprint_id
    WHERE e.id<>0 AND e.blueprint_id<>0 AND r.table_name<>'op_prints'"""))
def exclude_sources(spark, sf_dir):
    mapped = c.map_to_catalog(p.valid_products(fx.export(spark, sf_dir)), resolved(spark, sf_dir))
    return p.exclude_sources(mapped).select("id", "blueprint_id", "user_id", "seq", "print_id", "table_name")


@query(with_views("outcomes", """
    SELECT user_id, seq, id, blueprint_id,
           CASE outcome WHEN 'skip_invalid' THEN 'missing id' WHEN 'skip_unmapped' THEN 'no catalog mapping'
                ELSE 'excluded source' END AS reason
    FROM outcomes WHERE outcome LIKE 'skip%'"""))
def skip_reason(spark, sf_dir):
    return (p.skipped_products(fx.export(spark, sf_dir), resolved(spark, sf_dir))
            .select("user_id", "seq", "id", "blueprint_id", "reason"))


@query(with_views("full_export", """
    SELECT seq, quantity, price_cents, coalesce(description,'') AS description,
           coalesce(user_data_field,'') AS user_data_field, coalesce(graded,false) AS graded,
           coalesce(properties_hash,'{}') AS properties_hash FROM full_export"""))
def with_defaults(spark, sf_dir):
    return p.with_defaults(fx.full_export(spark, sf_dir), reconcile=True).select(
        "seq", "quantity", "price_cents", "description", "user_data_field", "graded", "properties_hash")


@query("""
    SELECT l_suppkey AS user_id, l_partkey AS blueprint_id, max(l_orderkey*8+l_linenumber) AS seq,
           CAST(arg_max(l_quantity, (l_orderkey*8+l_linenumber)*100+l_quantity) AS INT) AS quantity
    FROM lineitem GROUP BY l_suppkey, l_partkey""")
def last_write(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("blueprint_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_quantity").cast("int").alias("quantity"))
    ranked = rows.withColumn("rank", F.col("seq") * 100 + F.col("quantity"))
    return p.last_write(ranked, ["user_id", "blueprint_id"], "rank").drop("rank")


@query(with_views("export", """
    SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS position,
           CAST((row_number() OVER (PARTITION BY user_id ORDER BY seq)-1)//100 AS BIGINT) AS chunk,
           CAST(ceil(count(*) OVER (PARTITION BY user_id)/100.0) AS BIGINT) AS total_chunks FROM export"""))
def chunk_index(spark, sf_dir):
    return p.chunk_index(fx.export(spark, sf_dir), size=100).select(
        "user_id", "seq", "position", "chunk", "total_chunks")


_CHUNKS = with_views("outcomes", """
    , numbered AS (SELECT user_id, outcome,
          CAST((row_number() OVER (PARTITION BY user_id ORDER BY seq)-1)//100 AS BIGINT) AS chunk FROM outcomes)
    , chunks AS (SELECT user_id, chunk, count(*) AS processed, count(*) FILTER (outcome='created') AS created,
          count(*) FILTER (outcome='updated') AS updated, count(*) FILTER (outcome LIKE 'skip%') AS skipped
          FROM numbered GROUP BY ALL)""")


def _chunk_counts(spark, sf_dir):
    chunked = p.chunk_index(fx.export(spark, sf_dir), size=100)
    return bulk.chunk_summary(bulk.classify_export(chunked, resolved(spark, sf_dir), fx.inventory(spark, sf_dir)))


@query(_CHUNKS + "SELECT * FROM chunks")
def chunk_summary(spark, sf_dir):
    return _chunk_counts(spark, sf_dir)


@query(_CHUNKS + """
    , batches AS (SELECT user_id, chunk//3 AS batch, count(*) AS n, sum(processed) AS p, sum(created) AS c,
                  sum(updated) AS u, sum(skipped) AS s FROM chunks GROUP BY ALL)
    , totals AS (SELECT user_id, count(*) AS total_chunks, CAST(sum(processed) AS BIGINT) AS total_products
                 FROM chunks GROUP BY user_id)
    SELECT user_id, batch, total_products, total_chunks, CAST(sum(n) OVER w AS BIGINT) AS processed_chunks,
           CAST(trunc(CAST(sum(n) OVER w AS DOUBLE)/CAST(total_chunks AS DOUBLE)*100) AS INT) AS progress_percent,
           CAST(sum(p) OVER w AS BIGINT) AS processed, CAST(sum(c) OVER w AS BIGINT) AS created,
           CAST(sum(u) OVER w AS BIGINT) AS updated, CAST(sum(s) OVER w AS BIGINT) AS skipped
    FROM batches JOIN totals USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY batch)""")
def sync_progress(spark, sf_dir):
    return bulk.sync_progress(cut(_chunk_counts(spark, sf_dir), "chunks"))


@query(with_views("export inventory", """
    SELECT e.user_id, e.blueprint_id, CAST(e.id AS VARCHAR) AS external_stock_id, i.id AS item_id
    FROM export e LEFT JOIN inventory i ON i.user_id=e.user_id AND i.blueprint_id=e.blueprint_id
         AND i.external_stock_id=CAST(e.id AS VARCHAR)
    WHERE coalesce(e.id,0)<>0 AND coalesce(e.blueprint_id,0)<>0"""))
def match_inventory(spark, sf_dir):
    return (bulk.match_inventory(bulk.prepare_products(fx.export(spark, sf_dir)), fx.inventory(spark, sf_dir))
            .select("user_id", "blueprint_id", "external_stock_id", "item_id"))


@query(with_views("outcomes", "SELECT user_id, seq, id, blueprint_id, outcome FROM outcomes"))
def bulk_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir).select("user_id", "seq", "id", "blueprint_id", "outcome")


@query(with_views("outcomes", """
    SELECT user_id, count(*) AS total_products, count(*) AS processed,
           count(*) FILTER (outcome='created') AS created, count(*) FILTER (outcome='updated') AS updated,
           count(*) FILTER (outcome LIKE 'skip%') AS skipped
    FROM outcomes GROUP BY user_id"""))
def sync_summary(spark, sf_dir):
    return bulk.sync_summary(outcomes(spark, sf_dir))


@query(with_views("full_export full_inventory resolved", """
    , changes AS (SELECT e.* FROM full_export e JOIN resolved r ON e.blueprint_id=r.blueprint_id
        WHERE e.id<>0 AND e.blueprint_id<>0 AND r.table_name<>'op_prints')
    SELECT i.id, coalesce(i.user_id,c.user_id) AS user_id, coalesce(i.blueprint_id,c.blueprint_id) AS blueprint_id,
           coalesce(c.quantity,i.quantity) AS quantity, coalesce(c.price_cents,i.price_cents) AS price_cents,
           coalesce(c.properties_hash,i.properties) AS properties,
           CASE WHEN i.id IS NULL THEN CAST(c.id AS VARCHAR) ELSE i.external_stock_id END AS external_stock_id,
           i.description, i.user_data_field, i.graded,
           CASE WHEN i.id IS NULL THEN TIMESTAMP '2030-01-01' ELSE i.created_at END AS created_at,
           CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE i.updated_at END AS updated_at
    FROM full_inventory i FULL JOIN changes c ON i.user_id=c.user_id AND i.blueprint_id=c.blueprint_id
         AND i.external_stock_id=CAST(c.id AS VARCHAR)"""))
def bulk_sync(spark, sf_dir):
    return bulk.bulk_sync(fx.full_export(spark, sf_dir), resolved(spark, sf_dir), fx.full_inventory(spark, sf_dir),
                          F.lit("2030-01-01 00:00:00").cast("timestamp"))


@query("""SELECT DISTINCT l_suppkey AS user_id, l_partkey%50 AS expansion_id FROM lineitem""")
def user_expansions(spark, sf_dir):
    export = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("user_id"), (F.col("l_partkey") % 50).alias("expansion_id"))
    return p.user_expansions(export)
