"""Registered queries: properties, text rules, edits, purchases, reconciliation and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockline import fixtures as fx
from stockline.functions import properties as props
from stockline.functions import quality as q
from stockline.functions import text as tx
from stockline.operators import edits as ed
from stockline.operators import listings as ls
from stockline.operators import purchases as pu
from stockline.plans import reconcile as rc
from stockline.registry.bulk import resolved
from stockline.registry.views import VIEWS, uuid_sql, with_views

QUERIES = {}
NOW = "2030-01-01 00:00:00"


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function
    return add


def now():
    return F.lit(NOW).cast("timestamp")


def condition_sql(text):
    return f"""CASE trim({text}) WHEN 'Lightly Played' THEN 'Slightly Played' WHEN 'Damaged' THEN 'Poor'
        WHEN 'NM' THEN 'Near Mint' WHEN 'SP' THEN 'Slightly Played' WHEN 'MP' THEN 'Moderately Played'
        WHEN 'HP' THEN 'Heavily Played' WHEN 'PL' THEN 'Played' WHEN 'PO' THEN 'Poor'
        ELSE CASE lower(trim({text})) WHEN 'mint' THEN 'Mint' WHEN 'near mint' THEN 'Near Mint'
        WHEN 'slightly played' THEN 'Slightly Played' WHEN 'moderately played' THEN 'Moderately Played'
        WHEN 'played' THEN 'Played' WHEN 'heavily played' THEN 'Heavily Played' WHEN 'poor' THEN 'Poor' END END"""


def flag_sql(column, key):
    value = f"json_extract_string({column},'$.{key}')"
    return (f"CASE json_type({column},'$.{key}') WHEN 'BOOLEAN' THEN {value}='true' "
            f"WHEN 'VARCHAR' THEN lower({value}) IN ('true','1','yes','on') "
            f"WHEN 'NULL' THEN false ELSE {value}<>'0' END")


_COND = condition_sql("json_extract_string(properties,'$.condition')")
_LANG = "trim(json_extract_string(properties,'$.mtg_language'))"


@query(with_views("props", f"SELECT blueprint_id, {_COND} AS condition FROM props"))
def normalize_condition(spark, sf_dir):
    text = props.as_text(F.element_at(props.parse(F.col("properties")), "condition"))
    return fx.props(spark, sf_dir).select("blueprint_id", props.normalize_condition(text).alias("condition"))


@query(with_views("props", f"""
    SELECT blueprint_id, {flag_sql('properties', 'mtg_foil')} AS foil, {flag_sql('properties', 'signed')} AS signed,
           json_extract_string(properties,'$.mtg_foil')='maybe' AS foil_error FROM props"""))
def parse_flag(spark, sf_dir):
    values = fx.props(spark, sf_dir).select("blueprint_id", props.parse(F.col("properties")).alias("v"))
    foil = F.element_at("v", "mtg_foil")
    return values.select("blueprint_id", props.parse_flag(foil).alias("foil"),
                         props.parse_flag(F.element_at("v", "signed")).alias("signed"),
                         props.flag_error(foil).alias("foil_error"))


@query(with_views("props", f"""
    SELECT blueprint_id, CASE WHEN length({_LANG})>=2 THEN lower(substr({_LANG},1,2)) END AS language FROM props"""))
def parse_language(spark, sf_dir):
    text = props.as_text(F.element_at(props.parse(F.col("properties")), "mtg_language"))
    return fx.props(spark, sf_dir).select("blueprint_id", props.parse_language(text).alias("language"))


def _fields(frame, column, *keep):
    read = [F.get_json_object(column, f"$.{k}").alias(k)
            for k in ("condition", "mtg_foil", "mtg_language", "signed", "cmc", "graded", "artist")]
    return frame.select(*keep, *read)


@query(with_views("props", f"""
    SELECT blueprint_id, {_COND} AS condition,
           CASE WHEN {flag_sql('properties', 'mtg_foil')} THEN 'true' ELSE 'false' END AS mtg_foil,
           CASE WHEN length({_LANG})>=2 THEN lower(substr({_LANG},1,2)) END AS mtg_language,
           CASE WHEN {flag_sql('properties', 'signed')} THEN 'true' ELSE 'false' END AS signed,
           CAST(NULL AS VARCHAR) AS cmc, CAST(NULL AS VARCHAR) AS graded,
           json_extract_string(properties,'$.artist') AS artist,
           CASE WHEN {_COND} IS NULL THEN 1 ELSE 0 END
             + CASE WHEN json_extract_string(properties,'$.mtg_foil')='maybe' THEN 1 ELSE 0 END
             + CASE WHEN length({_LANG})<2 THEN 1 ELSE 0 END AS faults
    FROM props"""))
def clean_properties(spark, sf_dir):
    cleaned = fx.props(spark, sf_dir).select(
        "blueprint_id", props.clean_properties(F.col("properties")).alias("clean"),
        F.coalesce(F.size(F.split(props.property_errors(F.col("properties")), "; ")), F.lit(0)).alias("faults"))
    return _fields(cleaned, "clean", "blueprint_id", "faults")


@query(with_views("props", """
    SELECT blueprint_id, json_extract_string(properties,'$.condition') AS condition,
           json_extract_string(properties,'$.mtg_foil') AS mtg_foil,
           json_extract_string(properties,'$.mtg_language') AS mtg_language,
           json_extract_string(properties,'$.signed') AS signed, CAST(NULL AS VARCHAR) AS cmc,
           CAST(NULL AS VARCHAR) AS graded, json_extract_string(properties,'$.artist') AS artist,
           '3' AS kept_cmc FROM props"""))
def editable_properties(spark, sf_dir):
    edited = fx.props(spark, sf_dir).select(
        "blueprint_id", props.editable_properties(F.col("properties")).alias("e"),
        F.get_json_object(props.editable_properties(F.col("properties"), True), "$.cmc").alias("kept_cmc"))
    return _fields(edited, "e", "blueprint_id", "kept_cmc")


@query(f"""
    SELECT o_orderkey AS number, CASE WHEN o_orderkey%5<4 THEN {uuid_sql('o_orderkey')} END AS id FROM orders""")
def canonical_uuid(spark, sf_dir):
    number = F.col("o_orderkey")
    text = fx.uuid_text(number)
    form = (F.when(number % 5 == 1, F.upper(F.replace(text, F.lit("-"), F.lit(""))))
            .when(number % 5 == 2, F.concat(F.lit("{"), text, F.lit("}")))
            .when(number % 5 == 3, F.concat(F.lit("urn:uuid:"), text))
            .when(number % 5 == 4, F.concat(text, F.lit("0"))).otherwise(text))
    return fx.table(spark, sf_dir, "orders").select(number.alias("number"), q.canonical_uuid(form).alias("id"))


def _mixed_rows(spark, sf_dir):
    items = fx.inventory(spark, sf_dir)
    card = F.col("blueprint_id")
    return items.select(
        "id", F.when(card % 7 != 0, fx.uuid_text(F.col("user_id"))).otherwise("no-uuid").alias("user_id"),
        F.when(card % 11 != 0, card).alias("blueprint_id"),
        F.when(card % 13 == 0, F.concat(F.lit("x"), F.col("external_stock_id")))
        .when(card % 13 == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("external_stock_id")))
        .alias("external_stock_id"),
        (F.col("quantity") - 5).alias("quantity"), F.when(card % 17 == 0, -F.col("price_cents"))
        .otherwise(F.col("price_cents")).alias("price_cents"))


_RULES = {"user_id": "uuid", "blueprint_id": "blueprint_id", "external_stock_id": "stock_id",
          "quantity": "quantity", "price_cents": "price"}
_ERRORS = """
    SELECT id, blueprint_id, external_stock_id, list_filter([
        CASE WHEN blueprint_id%7=0 THEN 'user_id: Invalid user_id format: must be a valid UUID' END,
        CASE WHEN blueprint_id%11=0 THEN 'blueprint_id: blueprint_id must be an integer'
             WHEN blueprint_id<=0 THEN 'blueprint_id: blueprint_id must be positive' END,
        CASE WHEN blueprint_id%13=0 THEN 'external_stock_id: external_stock_id must be numeric' END,
        CASE WHEN quantity<5 THEN 'quantity: quantity must be >= 0' END,
        CASE WHEN blueprint_id%17=0 THEN 'price_cents: price_cents must be >= 0' END], lambda x: x IS NOT NULL) AS e
    FROM inventory"""


@query(with_views("inventory", f"""
    SELECT id, array_to_string(e,'; ') AS errors, CAST(NULL AS VARCHAR) AS stock_id FROM ({_ERRORS}) WHERE len(e)>0
    UNION ALL SELECT id, '', CASE WHEN blueprint_id%13<>1 THEN external_stock_id END FROM ({_ERRORS}) WHERE len(e)=0"""))
def validate_rows(spark, sf_dir):
    good, bad = q.validate_rows(_mixed_rows(spark, sf_dir), _RULES)
    shown = F.array_join(F.transform("errors", lambda e: F.concat(e.field, F.lit(": "), e.message)), "; ")
    return bad.select("id", shown.alias("errors"), F.lit(None).cast("string").alias("stock_id")).unionByName(
        good.select("id", F.lit("").alias("errors"), F.col("external_stock_id").alias("stock_id")))


def _trim_sql(column):
    return f"regexp_replace({column}, '^[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+$', '', 'g')"


def _basic_sql(column):
    text = f"nullif({_trim_sql(column)},'')"
    for pattern in tx.BASIC_MARKUP:
        text = f"regexp_replace({text},'(?i){pattern}','','g')"
    return text


@query(f"SELECT doc_id, {_basic_sql('text')} AS text FROM documents")
def scrub_text(spark, sf_dir):
    return tx.clean_text_columns(fx.table(spark, sf_dir, "documents"), {"text": "scrub_text"}).select("doc_id", "text")


@query(f"""
    SELECT page_id, {_basic_sql('html')} AS html, url_encode(url) AS url FROM pages""")
def clean_text_columns(spark, sf_dir):
    return tx.clean_text_columns(fx.table(spark, sf_dir, "pages"), {
        "html": "scrub_text", "url": "percent_encode"}).select("page_id", "html", "url")


_MARKUP_SQL = f"nullif({_trim_sql('html')},'')"
for _pattern in (r"<script[^>]*>.*?</script>", "javascript:", r"on[\p{L}\p{N}_]+\s*=", "vbscript:", "data:text/html"):
    _MARKUP_SQL = f"regexp_replace({_MARKUP_SQL},'(?is){_pattern}','','g')"


@query(f"SELECT page_id, {_MARKUP_SQL} AS html FROM pages")
def scrub_markup(spark, sf_dir):
    return tx.clean_text_columns(fx.table(spark, sf_dir, "pages"), {"html": "scrub_markup"}).select("page_id", "html")


@query("""
    SELECT page_id, CASE WHEN contains(p,'..') OR starts_with(p,'/') THEN 'Path traversal detected' END AS error,
           CASE WHEN NOT (contains(p,'..') OR starts_with(p,'/')) THEN
                array_to_string(list_filter(string_split(replace(p,chr(92),'/'),'/'), lambda x: x NOT IN ('','.')),'/') END AS path
    FROM (SELECT page_id, CASE page_id%4 WHEN 0 THEN url WHEN 1 THEN replace(url,'/','\\') WHEN 2 THEN '/'||url
                 ELSE replace(url,'://','/./../') END AS p FROM pages)""")
def clean_path(spark, sf_dir):
    number = F.col("page_id")
    path = (F.when(number % 4 == 0, F.col("url"))
            .when(number % 4 == 1, F.replace("url", F.lit("/"), F.lit("\\")))
            .when(number % 4 == 2, F.concat(F.lit("/"), F.col("url")))
            .otherwise(F.replace("url", F.lit("://"), F.lit("/./../"))))
    return (fx.table(spark, sf_dir, "pages").select("page_id", path.alias("p"))
            .select("page_id", tx.path_error(F.col("p")).alias("error"), tx.clean_path(F.col("p")).alias("path")))


@query(r"""
    SELECT doc_id, regexp_matches(text, '(?i)'';?\s*(DROP|DELETE|UPDATE|INSERT|ALTER|CREATE|EXEC|EXECUTE)')
           OR regexp_matches(text,'(?i)UNION\s+SELECT') OR contains(text,'--') OR contains(text,'/*')
           OR contains(text,'*/') AS suspicious FROM documents""")
def flag_sql_patterns(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", tx.flag_sql_patterns(F.col("text")).alias("suspicious"))


@query("""SELECT page_id, url_encode(url) AS encoded, url AS decoded, url_encode(html) AS html FROM pages""")
def percent_encode(spark, sf_dir):
    encoded = tx.percent_encode(F.col("url"))
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", encoded.alias("encoded"), tx.percent_decode(encoded).alias("decoded"),
        tx.percent_encode(F.col("html")).alias("html"))


@query(with_views("patches", """
    SELECT item_id, quantity, price_cents, CASE WHEN trim(user_data_field)<>'' THEN user_data_field END AS user_data_field,
           array_to_string(list_filter([CASE WHEN quantity<1 THEN 'Quantity must be >= 0' END,
             CASE WHEN quantity IS NULL AND price_cents IS NULL AND graded IS NULL AND properties IS NULL
                  AND coalesce(trim(user_data_field),'')='' THEN 'At least one field must be provided for update' END],
             lambda x: x IS NOT NULL),'; ') AS errors FROM patches"""))
def validate_patch(spark, sf_dir):
    shifted = fx.patches(spark, sf_dir).withColumn("quantity", F.col("quantity") - 1)
    return ed.validate_patch(shifted).select(
        "item_id", (F.col("quantity") + 1).alias("quantity"), "price_cents", "user_data_field",
        F.array_join("errors", "; ").alias("errors"))


_PATCHED = with_views("full_inventory patches", """
    , clean AS (SELECT * REPLACE (CASE WHEN trim(user_data_field)<>'' THEN user_data_field END AS user_data_field)
                FROM patches WHERE coalesce(quantity,0)>=0 AND coalesce(price_cents,0)>=0
                  AND NOT (quantity IS NULL AND price_cents IS NULL AND graded IS NULL AND properties IS NULL
                           AND coalesce(trim(user_data_field),'')=''))
    , j AS (SELECT i.*, p.item_id, p.quantity AS pq, p.price_cents AS pp, p.user_data_field AS pu, p.graded AS pg,
                   p.properties AS pr FROM full_inventory i LEFT JOIN clean p ON i.id=p.item_id)""")


def _patches(spark, sf_dir):
    return ed.validate_patch(fx.patches(spark, sf_dir)).where(F.size("errors") == 0).drop("errors")


@query(_PATCHED + """
    SELECT id, coalesce(pq,quantity) AS quantity, coalesce(pp,price_cents) AS price_cents,
           coalesce(pu,user_data_field) AS user_data_field, coalesce(pg,graded) AS graded,
           CASE WHEN pr IS NULL THEN json_extract_string(properties,'$.condition')
                ELSE json_extract_string(pr,'$.condition') END AS condition,
           CASE WHEN pr IS NULL THEN json_extract_string(properties,'$.signed') ELSE 'false' END AS signed,
           json_extract_string(properties,'$.artist') AS artist,
           json_extract_string(properties,'$.mtg_foil') AS mtg_foil,
           CASE WHEN item_id IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE updated_at END AS updated_at
    FROM j""")
def apply_patches(spark, sf_dir):
    patched = ed.apply_patches(fx.full_inventory(spark, sf_dir), _patches(spark, sf_dir), now())
    return patched.select(
        "id", "quantity", "price_cents", "user_data_field", "graded",
        *[F.get_json_object("properties", f"$.{k}").alias(k) for k in ("condition", "signed", "artist", "mtg_foil")],
        "updated_at")


@query(_PATCHED + """
    , flags AS (SELECT *, pq IS NOT NULL AND pq<>quantity AS quantity_changed,
        pp IS NOT NULL AND pp<>price_cents AS price_changed, false AS description_changed,
        pu IS NOT NULL AND pu IS DISTINCT FROM user_data_field AS user_data_field_changed,
        pg IS NOT NULL AND pg IS DISTINCT FROM graded AS graded_changed, pr IS NOT NULL AS properties_changed,
        coalesce(pr IS NOT NULL AND (json_extract_string(pr,'$.condition')<>json_extract_string(properties,'$.condition')
          OR json_type(properties,'$.signed')<>'BOOLEAN' OR json_extract_string(properties,'$.signed')<>'false'),false) AS e
        FROM j WHERE item_id IS NOT NULL)
    SELECT id, user_id, external_stock_id, quantity_changed, price_changed, description_changed,
           user_data_field_changed, graded_changed, properties_changed,
           quantity_changed OR price_changed OR user_data_field_changed OR graded_changed OR e AS effective_change,
           external_stock_id IS NOT NULL AND (quantity_changed OR price_changed OR user_data_field_changed
             OR graded_changed OR properties_changed) AS sync_needed
    FROM flags""")
def detect_changes(spark, sf_dir):
    return ed.detect_changes(fx.full_inventory(spark, sf_dir), _patches(spark, sf_dir))


@query("""
    WITH p AS (SELECT l_suppkey AS user_id, l_partkey AS item_id, (l_orderkey*8+l_linenumber)*100+CAST(l_quantity AS INT) AS seq,
               CAST(l_quantity AS INT) AS n, l_linenumber AS ln FROM lineitem)
    SELECT user_id, item_id, CAST(arg_max(n, seq) FILTER (ln%2=0) AS INT) AS quantity,
           CAST(arg_max(n, seq) FILTER (ln%2=1) AS INT) AS price_cents,
           arg_max('c'||CAST(n AS VARCHAR), seq) FILTER (ln%3=0) AS condition,
           arg_max(CAST(n AS VARCHAR), seq) FILTER (ln%3=1) AS rank
    FROM p GROUP BY user_id, item_id""")
def collapse_patches(spark, sf_dir):
    n = F.col("l_quantity").cast("int")
    ln = F.col("l_linenumber")
    raw = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
        ((F.col("l_orderkey") * 8 + ln) * 100 + n).alias("seq"),
        F.when(ln % 2 == 0, n).alias("quantity"), F.when(ln % 2 == 1, n).alias("price_cents"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("user_data_field"),
        F.lit(None).cast("boolean").alias("graded"),
        F.when(ln % 3 == 0, F.concat(F.lit('{"condition":"c'), n.cast("string"), F.lit('","rank":null}')))
        .when(ln % 3 == 1, F.concat(F.lit('{"rank":'), n.cast("string"), F.lit("}"))).alias("properties"))
    return ed.collapse_patches(raw, "seq").select(
        "user_id", "item_id", "quantity", "price_cents",
        *[F.get_json_object("properties", f"$.{k}").alias(k) for k in ("condition", "rank")])


_BODY = ("id long, price double, quantity int, description string, user_data_field string, graded boolean, "
         "properties struct<condition: string, signed: boolean, mtg_foil: boolean, mtg_language: string, "
         "artist: string, cmc: int, graded: boolean>")


@query(with_views("full_inventory", f"""
    SELECT id AS item_id, CASE WHEN external_stock_id IS NULL THEN 'skipped' ELSE 'queued' END AS status,
           CASE WHEN external_stock_id IS NULL THEN 'no_external_stock_id' END AS reason,
           CASE WHEN external_stock_id IS NOT NULL THEN id END AS product_id,
           CASE WHEN external_stock_id IS NOT NULL THEN CAST(price_cents AS DOUBLE)/100.0 END AS price,
           CASE WHEN external_stock_id IS NOT NULL THEN quantity END AS quantity,
           CASE WHEN external_stock_id IS NOT NULL THEN description END AS description,
           CASE WHEN external_stock_id IS NOT NULL THEN graded END AS graded,
           CASE WHEN external_stock_id IS NOT NULL THEN {_COND} END AS condition,
           CASE WHEN external_stock_id IS NOT NULL THEN {flag_sql('properties', 'signed')} END AS signed,
           CASE WHEN external_stock_id IS NOT NULL AND {flag_sql('properties', 'mtg_foil')} THEN true END AS mtg_foil,
           CASE WHEN external_stock_id IS NOT NULL AND {_LANG}<>'' THEN lower(substr({_LANG},1,2)) END AS mtg_language,
           CASE WHEN external_stock_id IS NOT NULL THEN json_extract_string(properties,'$.artist') END AS artist,
           CAST(NULL AS INT) AS cmc
    FROM full_inventory"""))
def build_update_payload(spark, sf_dir):
    body = F.from_json("body", _BODY)
    return ed.build_update_payload(fx.full_inventory(spark, sf_dir)).withColumn("b", body).select(
        "item_id", "status", "reason", F.col("b.id").alias("product_id"), "b.price", "b.quantity", "b.description",
        "b.graded", "b.properties.condition", "b.properties.signed", "b.properties.mtg_foil",
        "b.properties.mtg_language", "b.properties.artist", "b.properties.cmc")


@query(with_views("inventory purchases", """
    , wanted AS (SELECT DISTINCT item_id+order_id%2 AS item_id, user_id FROM purchases)
    SELECT id, user_id, 'kept' AS part FROM inventory i WHERE NOT EXISTS
        (SELECT 1 FROM wanted w WHERE w.item_id=i.id AND w.user_id=i.user_id)
    UNION ALL SELECT id, i.user_id, 'deleted' FROM inventory i JOIN wanted w ON w.item_id=i.id AND w.user_id=i.user_id
    UNION ALL SELECT item_id, user_id, 'missing' FROM wanted w WHERE NOT EXISTS
        (SELECT 1 FROM inventory i WHERE w.item_id=i.id AND w.user_id=i.user_id)"""))
def delete_items(spark, sf_dir):
    wanted = fx.purchases(spark, sf_dir).withColumn("item_id", F.col("item_id") + F.col("order_id") % 2)
    kept, deleted, missing = ed.delete_items(fx.inventory(spark, sf_dir), wanted)
    parts = {"kept": kept, "deleted": deleted, "missing": missing}
    result = None
    for name, frame in parts.items():
        part = frame.select("id", "user_id", F.lit(name).alias("part"))
        result = part if result is None else result.unionByName(part)
    return result


@query(with_views("purchases requests", """
    , answers AS (SELECT request_id, status_code, CASE status_code WHEN 200 THEN 'ok' WHEN 500 THEN
        CASE WHEN request_id%3=0 THEN 'Not_Found' ELSE 'boom' END ELSE 'http' END AS message FROM requests)
    SELECT p.request_id, item_id, user_id,
           CASE WHEN status_code<400 OR status_code=404 OR message='Not_Found' THEN 'success' ELSE 'error' END AS status,
           coalesce(status_code=404 OR message='Not_Found',false) AS already_deleted,
           CASE WHEN status_code=404 OR message='Not_Found' THEN 'Product was already deleted' WHEN status_code<400 THEN 'ok'
                ELSE 'Failed to delete product: '||coalesce(message,'') END AS message
    FROM purchases p LEFT JOIN answers a ON p.order_id=a.request_id"""))
def delete_results(spark, sf_dir):
    number = F.col("request_id")
    code = F.col("status_code")
    answers = fx.requests(spark, sf_dir).select(
        "request_id", "status_code",
        F.when(code == 200, "ok").when(code == 500, F.when(number % 3 == 0, "Not_Found").otherwise("boom"))
        .otherwise("http").alias("message"))
    deletes = fx.purchases(spark, sf_dir).select(
        F.col("request_id").alias("name"), "item_id", "user_id", F.col("order_id").alias("request_id"))
    return ed.delete_results(deletes, answers).select(
        F.col("name").alias("request_id"), "item_id", "user_id", "status", "already_deleted", "message")


@query(with_views("inventory export", """
    , wanted AS (SELECT user_id, CASE WHEN blueprint_id%10=0 THEN 'x'||external_stock_id ELSE external_stock_id END
                 AS external_stock_id FROM inventory)
    SELECT w.user_id, w.external_stock_id, coalesce(e.quantity>0,false) AS available,
           CAST(coalesce(e.quantity,0) AS BIGINT) AS quantity,
           CASE WHEN e.id IS NULL THEN 'Product '||w.external_stock_id||' not found in inventory' END AS error
    FROM wanted w LEFT JOIN export e ON e.user_id=w.user_id AND CAST(e.id AS VARCHAR)=w.external_stock_id"""))
def check_availability(spark, sf_dir):
    stock = F.col("external_stock_id")
    wanted = fx.inventory(spark, sf_dir).select(
        "user_id", F.when(F.col("blueprint_id") % 10 == 0, F.concat(F.lit("x"), stock)).otherwise(stock)
        .alias("external_stock_id"))
    return pu.check_availability(wanted, fx.export(spark, sf_dir))


# Requests are put on few items, so that each has many.
_BUSY = with_views("purchases full_inventory export", """
    , wanted AS (SELECT request_id, (item_id//1000000000)*1000000000+(item_id%40) AS item_id, user_id,
                 quantity%12+1 AS quantity, ts FROM purchases)
    , q AS (SELECT w.*, i.external_stock_id, CAST(i.quantity AS BIGINT) AS l0,
                   CAST(coalesce(e.quantity,0) AS BIGINT) AS r0,
                   row_number() OVER (PARTITION BY w.item_id ORDER BY w.ts, w.request_id) AS k
            FROM wanted w LEFT JOIN full_inventory i ON i.id=w.item_id AND i.user_id=w.user_id
            LEFT JOIN export e ON e.user_id=i.user_id AND CAST(e.id AS VARCHAR)=i.external_stock_id)
    , walk AS (
        SELECT item_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS request_id, l0 AS before, l0 AS l, r0 AS r,
               CAST(NULL AS VARCHAR) AS error FROM q WHERE k=1
        UNION ALL
        SELECT q.item_id, q.k, q.request_id, w.l,
               CASE WHEN q.external_stock_id IS NULL THEN w.l WHEN least(w.l,w.r)>=q.quantity THEN w.l-q.quantity ELSE w.r END,
               CASE WHEN q.external_stock_id IS NOT NULL AND least(w.l,w.r)>=q.quantity THEN w.r-q.quantity ELSE w.r END,
               CASE WHEN q.l0 IS NULL THEN 'Inventory item not found'
                    WHEN w.l<q.quantity THEN 'Insufficient quantity. Available: '
                      ||CAST(CASE WHEN q.external_stock_id IS NULL THEN w.l ELSE w.r END AS VARCHAR)
                      ||', Requested: '||CAST(q.quantity AS VARCHAR)
                    WHEN q.external_stock_id IS NULL THEN 'Missing external_stock_id'
                    WHEN w.r<q.quantity THEN 'Insufficient quantity on marketplace. Available: '||CAST(w.r AS VARCHAR)
                      ||', Requested: '||CAST(q.quantity AS VARCHAR) END
        FROM walk w JOIN q ON q.item_id=w.item_id AND q.k=w.k+1)""")


def busy_purchases(spark, sf_dir):
    item = F.col("item_id")
    return fx.purchases(spark, sf_dir).select(
        "request_id", (F.floor(item / fx.KEY_BASE) * fx.KEY_BASE + item % 40).alias("item_id"), "user_id",
        (F.col("quantity") % 12 + 1).alias("quantity"), "ts")


@query(_BUSY + """
    SELECT request_id, item_id, CASE WHEN error='Inventory item not found' THEN 'not_found'
             WHEN error IS NULL THEN 'success' ELSE 'error' END AS status,
           before AS quantity_before, l AS quantity_after, error,
           CASE WHEN error IS NULL THEN CASE WHEN r>0 THEN 'increment' ELSE 'delete' END END AS remote_action
    FROM walk WHERE k>0""")
def decide_purchases(spark, sf_dir):
    return pu.decide_purchases(busy_purchases(spark, sf_dir), fx.full_inventory(spark, sf_dir),
                               fx.export(spark, sf_dir)).select(
        "request_id", "item_id", "status", "quantity_before", "quantity_after", "error", "remote_action")


@query(_BUSY + """
    SELECT i.id, CAST(coalesce(s.l,i.quantity) AS INT) AS quantity FROM full_inventory i
    LEFT JOIN (SELECT item_id, l FROM walk QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k DESC)=1) s
    ON s.item_id=i.id""")
def settle_purchases(spark, sf_dir):
    inventory = fx.full_inventory(spark, sf_dir)
    decisions = pu.decide_purchases(busy_purchases(spark, sf_dir), inventory, fx.export(spark, sf_dir))
    return pu.settle_purchases(inventory, decisions).select("id", "quantity")


# Every seventh seller has no settings.
@query(_BUSY.replace("WITH RECURSIVE ", "WITH RECURSIVE settings AS (" + VIEWS["settings"][1] + "), ", 1) + """
    , c AS (SELECT q.*, s.user_id IS NOT NULL AS known, coalesce(s.has_token,false) AS token FROM q
            LEFT JOIN settings s ON s.user_id=q.user_id AND s.user_id%7<>0)
    SELECT c.request_id, c.item_id, CASE WHEN error='Inventory item not found' THEN 'not_found'
             WHEN error IS NULL THEN 'success' ELSE 'error' END AS status,
           before AS quantity_before, l AS quantity_after, error
    FROM walk w JOIN c ON c.item_id=w.item_id AND c.k=w.k WHERE token
    UNION ALL
    SELECT request_id, item_id, CASE WHEN l0 IS NULL THEN 'not_found' WHEN l0<quantity OR external_stock_id IS NULL THEN 'error'
             ELSE 'refused' END, l0, l0,
           CASE WHEN l0 IS NULL THEN 'Inventory item not found'
                WHEN l0<quantity THEN 'Insufficient quantity. Available: '||CAST(l0 AS VARCHAR)||', Requested: '
                  ||CAST(quantity AS VARCHAR)
                WHEN external_stock_id IS NULL THEN 'Missing external_stock_id'
                WHEN NOT known THEN 'User not found in sync settings' ELSE 'no token' END
    FROM c WHERE NOT token""")
def connected_purchases(spark, sf_dir):
    settings = fx.settings(spark, sf_dir).where(F.col("user_id") % 7 != 0)
    return pu.decide_purchases(busy_purchases(spark, sf_dir), fx.full_inventory(spark, sf_dir),
                               fx.export(spark, sf_dir), settings).select(
        "request_id", "item_id", "status", "quantity_before", "quantity_after", "error")


_RECONCILED = with_views("full_export full_inventory resolved", """
    , r AS (SELECT e.*, i.id AS item_id, i.id IS NOT NULL AS known, c.print_id,
              CASE WHEN e.id IS NULL THEN 'Product id missing'
                   WHEN i.id IS NULL AND c.print_id IS NULL THEN 'Blueprint '||coalesce(CAST(e.blueprint_id AS VARCHAR),'None')
                        ||' not found in mapping' END AS error
            FROM full_export e LEFT JOIN resolved c ON c.blueprint_id=e.blueprint_id
            LEFT JOIN full_inventory i ON i.user_id=e.user_id AND i.external_stock_id=CAST(e.id AS VARCHAR))
    , o AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'error' WHEN known THEN 'updated' ELSE 'created' END AS outcome
            FROM r)""")


def _outcomes(spark, sf_dir):
    return rc.reconcile_outcomes(fx.full_export(spark, sf_dir), resolved(spark, sf_dir),
                                 fx.full_inventory(spark, sf_dir))


@query(_RECONCILED + "SELECT seq, item_id, outcome, error FROM o")
def match_by_stock_id(spark, sf_dir):
    return _outcomes(spark, sf_dir).select("seq", "item_id", "outcome", "error")


@query(_RECONCILED + """
    SELECT i.id, i.external_stock_id, coalesce(o.quantity,i.quantity) AS quantity,
           coalesce(o.price_cents,i.price_cents) AS price_cents,
           CASE WHEN o.seq IS NULL THEN i.description ELSE coalesce(o.description,'') END AS description,
           CASE WHEN o.seq IS NULL THEN i.graded ELSE coalesce(o.graded,false) END AS graded,
           CASE WHEN o.seq IS NULL THEN i.properties ELSE o.properties_hash END AS properties,
           CASE WHEN o.seq IS NULL THEN i.updated_at ELSE TIMESTAMP '2030-01-01' END AS updated_at
    FROM full_inventory i LEFT JOIN (SELECT * FROM o WHERE outcome='updated') o ON o.item_id=i.id
    UNION ALL SELECT NULL, CAST(id AS VARCHAR), quantity, price_cents, coalesce(description,''), coalesce(graded,false),
           properties_hash, TIMESTAMP '2030-01-01' FROM o WHERE outcome='created'""")
def reconcile(spark, sf_dir):
    return rc.reconcile(_outcomes(spark, sf_dir), fx.full_inventory(spark, sf_dir), now()).select(
        "id", "external_stock_id", "quantity", "price_cents", "description", "graded", "properties", "updated_at")


@query(_RECONCILED + """
    SELECT user_id, count(*) FILTER (outcome='updated') AS updated, count(*) FILTER (outcome='created') AS created,
           count(*) FILTER (outcome='error') AS errors, count(*) FILTER (outcome<>'error') AS total_processed
    FROM o GROUP BY user_id""")
def reconcile_summary(spark, sf_dir):
    return rc.reconcile_summary(_outcomes(spark, sf_dir))


@query(_RECONCILED + """
    SELECT user_id, CAST(id AS VARCHAR) AS product_id, error FROM o WHERE outcome='error'""")
def reconcile_errors(spark, sf_dir):
    return rc.reconcile_errors(_outcomes(spark, sf_dir))


@query(with_views("inventory", "SELECT * FROM inventory WHERE quantity>20"))
def in_stock(spark, sf_dir):
    lowered = fx.inventory(spark, sf_dir).withColumn("quantity", F.col("quantity") - 20)
    return ls.in_stock(lowered).withColumn("quantity", (F.col("quantity") + 20).cast("int"))


@query(with_views("full_inventory", """
    SELECT id AS item_id, user_id AS seller_id, 'Venditore #'||substr(CAST(user_id AS VARCHAR),1,8) AS seller_display_name,
           blueprint_id, quantity, price_cents, json_extract_string(properties,'$.condition') AS condition,
           json_extract_string(properties,'$.mtg_language') AS mtg_language,
           row_number() OVER (PARTITION BY blueprint_id ORDER BY price_cents, id) AS rank
    FROM full_inventory WHERE quantity>0 QUALIFY rank<=5"""))
def top_listings(spark, sf_dir):
    top = ls.top_listings(fx.full_inventory(spark, sf_dir), 5)
    ranks = top.select(F.col("id").alias("item_id"), F.col("rank").cast("long").alias("rank"))
    return ls.listing_columns(top).drop("country").join(ranks, "item_id")


@query(with_views("inventory", """
    SELECT id, user_id, price_cents, quantity FROM inventory WHERE quantity>0 AND blueprint_id=17
    ORDER BY price_cents, id LIMIT 10"""))
def listings_for(spark, sf_dir):
    return ls.listings_for(fx.inventory(spark, sf_dir), 17, 10).select("id", "user_id", "price_cents", "quantity")


@query(with_views("inventory", """
    SELECT id, updated_at FROM inventory WHERE user_id=7 ORDER BY updated_at DESC, id LIMIT 50 OFFSET 20"""))
def inventory_page(spark, sf_dir):
    return ls.inventory_page(fx.inventory(spark, sf_dir), 7, 50, 20).select("id", "updated_at")


@query(with_views("inventory", "SELECT user_id, count(*) AS total FROM inventory GROUP BY user_id"))
def inventory_total(spark, sf_dir):
    return ls.inventory_total(fx.inventory(spark, sf_dir))


@query(with_views("inventory", """
    SELECT user_id, count(*) AS total_items, CAST(sum(quantity) AS BIGINT) AS total_quantity,
           avg(price_cents) AS avg_price FROM inventory GROUP BY user_id"""))
def inventory_stats(spark, sf_dir):
    return ls.inventory_stats(fx.inventory(spark, sf_dir))


@query(with_views("full_inventory", """
    SELECT id AS item_id, user_id AS seller_id, 'Venditore #'||substr(CAST(user_id AS VARCHAR),1,8) AS seller_display_name,
           CAST(NULL AS VARCHAR) AS country, blueprint_id, quantity, price_cents,
           json_extract_string(properties,'$.condition') AS condition,
           json_extract_string(properties,'$.mtg_language') AS mtg_language FROM full_inventory"""))
def listing_columns(spark, sf_dir):
    return ls.listing_columns(fx.full_inventory(spark, sf_dir))
