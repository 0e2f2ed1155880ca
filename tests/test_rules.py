"""Hand-made rows for the column rules, and comparison with Python's own functions."""

import base64
import hashlib
import hmac
import json
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import functions as F

from stockline.functions import properties as props
from stockline.functions import quality as q
from stockline.functions import signature as sig
from stockline.functions import text as tx
from stockline.operators import edits as ed
from stockline.operators import events as ev


def _apply(spark, values, rule, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.r for r in rows.select("i", rule(F.col("v")).alias("r")).orderBy("i").collect()]


def test_conditions(spark):
    cases = {"Mint": "Mint", " NM ": "Near Mint", "nm": None, "lightly played": None, "Lightly Played": "Slightly Played",
             "POOR": "Poor", "heavily played": "Heavily Played", "": None, "Damaged": "Poor", "\t Played\n": "Played",
             None: None, "PO": "Poor"}
    assert _apply(spark, list(cases), props.normalize_condition) == list(cases.values())


def test_flags_and_languages(spark):
    texts = ["true", "false", '"Yes"', '"off"', '"maybe"', "1", "0", "null", '""', "{}", '{"a":1}', "[]", "0.5"]
    flags = _apply(spark, texts, lambda v: props.parse_flag(F.parse_json(v)))
    assert flags == [True, False, True, False, False, True, False, False, False, False, True, False, True]
    errors = _apply(spark, texts, lambda v: props.flag_error(F.parse_json(v)))
    assert [t for t, e in zip(texts, errors) if e] == ['"maybe"']
    assert _apply(spark, ["English", " IT ", "e", "", None], props.parse_language) == ["en", "it", None, None, None]


def test_clean_properties(spark):
    dirty = {"condition": "NM", "signed": "yes", "mtg_foil": "off", "altered": 0, "x": None, "o": {"a": 1},
             "mtg_language": "e", "n": 1.5, "cmc": 3, "graded": True, "e": ""}
    clean = json.loads(_apply(spark, [json.dumps(dirty)], props.clean_properties)[0])
    assert clean == {"condition": "Near Mint", "signed": True, "mtg_foil": False, "altered": False, "x": None,
                     "o": {"a": 1}, "n": 1.5, "e": ""}
    editable = json.loads(_apply(spark, [json.dumps(dirty)], props.editable_properties)[0])
    assert "x" not in editable and editable["e"] == "" and "cmc" not in editable and "graded" not in editable
    assert _apply(spark, [None, "{}"], props.clean_properties) == ["{}", "{}"]
    messages = _apply(spark, [json.dumps({"condition": "nm", "signed": "maybe", "mtg_language": "e"}), json.dumps(dirty)],
                      props.property_errors)
    assert messages[0].count("; ") == 2 and "Invalid condition value: 'nm'" in messages[0]
    assert messages[1].startswith("Invalid language value: 'e'")


def test_update_payload(spark):
    rows = [
        (1, "u", "392763036", 5, 1600, None, "A3", True,
         '{"condition":"nm","signed":"maybe","altered":false,"mtg_foil":true,"mtg_language":"e","cmc":1}'),
        (2, "u", "7", 0, 1, "", None, None, '{"mtg_foil":"off","graded":true}'),
        (3, "u", None, 1, 1, None, None, None, None), (4, "u", "", 1, 1, None, None, None, "{}")]
    items = spark.createDataFrame(rows, "id long, user_id string, external_stock_id string, quantity int, price_cents int, "
                                        "description string, user_data_field string, graded boolean, properties string")
    got = {r.item_id: r for r in ed.build_update_payload(items).collect()}
    assert json.loads(got[1].body) == {
        "id": 392763036, "price": 16.0, "quantity": 5, "user_data_field": "A3", "graded": True,
        "properties": {"signed": False, "altered": False, "mtg_foil": True, "mtg_language": "e"}}
    assert json.loads(got[2].body) == {"id": 7, "price": 0.01, "quantity": 0, "description": ""}
    assert [got[i].reason for i in (1, 2, 3, 4)] == [None, None, "no_external_stock_id", "no_external_stock_id"]


def test_merge_and_changes(spark):
    schema = ("id long, user_id string, external_stock_id string, quantity int, price_cents int, description string, "
              "user_data_field string, graded boolean, properties string, updated_at timestamp")
    rows = [(1, "u", "9", 5, 10, None, None, None, '{"a":1,"condition":"NM"}', None),
            (2, "u", " ", 5, 10, None, None, None, None, None), (3, "u", "9", 5, 10, "d", None, None, "{}", None)]
    patches = [(1, "u", None, None, None, None, None, '{"condition":"","a":null,"b":false}'),
               (2, "u", 6, None, None, None, False, None), (3, "u", 5, 10, "d", None, None, None)]
    items = spark.createDataFrame(rows, schema)
    given = spark.createDataFrame(patches, "item_id long, user_id string, quantity int, price_cents int, description string, "
                                           "user_data_field string, graded boolean, properties string")
    after = {r.id: r for r in ed.apply_patches(items, given, F.current_timestamp()).collect()}
    assert json.loads(after[1].properties) == {"a": 1, "condition": "", "b": False}
    assert (after[2].quantity, after[2].graded, after[2].properties) == (6, False, None)
    assert all(r.updated_at for r in after.values())
    changes = {r.id: r for r in ed.detect_changes(items, given).collect()}
    assert changes[1].properties_changed and changes[1].sync_needed
    assert changes[2].quantity_changed and not changes[2].sync_needed
    assert not changes[3].sync_needed and not changes[3].effective_change
    # The same properties again differ from nothing; a part of them differs from the whole.
    same = given.where("item_id = 1").withColumn("properties", F.lit('{"condition":"NM","a":1}'))
    part = given.where("item_id = 1").withColumn("properties", F.lit('{"condition":"NM"}'))
    assert not ed.detect_changes(items, same).first().properties_changed
    partial = ed.detect_changes(items, part).first()
    assert partial.properties_changed and not partial.effective_change


def test_patch_rules(spark):
    rows = [(1, "u", -1, None, " ", None, None, None), (2, "u", None, -5, "x" * 5001, "y" * 1001, None, None),
            (3, "u", None, None, "  ", "", None, None), (4, "u", 0, 0, "ok", None, False, "{}")]
    given = spark.createDataFrame(rows, "item_id long, user_id string, quantity int, price_cents int, description string, "
                                        "user_data_field string, graded boolean, properties string")
    got = {r.item_id: r for r in ed.validate_patch(given).collect()}
    assert got[1].errors == ["Quantity must be >= 0"] and got[1].description is None
    assert len(got[2].errors) == 3
    assert got[3].errors == ["At least one field must be provided for update"]
    assert got[4].errors == []


def test_uuids(spark):
    texts = ["db24fb13-ec73-49b8-932c-f0043dd47e86", "{DB24FB13EC7349B8932CF0043DD47E86}",
             "urn:uuid:db24fb13-ec73-49b8-932c-f0043dd47e86", "db24fb13", "", "zz24fb13-ec73-49b8-932c-f0043dd47e86"]

    def python(text):
        try:
            return str(uuid.UUID(text))
        except ValueError:
            return None

    assert _apply(spark, texts, q.canonical_uuid) == [python(t) for t in texts]


def test_text_rules(spark):
    assert _apply(spark, ["  a<SCRIPT>b  ", "JavaScript:x onERROR=1", " ", None, "　x "], tx.scrub_text) == [
        "a>b", "x 1", None, None, "x"]
    # One pass: what a removal puts together stays.
    assert _apply(spark, ["java<scriptscript:"], tx.scrub_text) == ["javascript:"]
    assert _apply(spark, ["abcdef"], lambda v: tx.scrub_text(v, 3)) == ["abc"]
    full = ["<script src=x>\nalert(1)\n</SCRIPT>ok", "a onclick\n= b", "onél=x", "\x00 y", "data:text/html,z", "<script>"]
    assert _apply(spark, full, tx.scrub_markup) == ["ok", "a  b", "x", " y", ",z", "<script>"]
    assert _apply(spark, ["vbscript:", " "], tx.scrub_markup) == ["", None]
    assert _apply(spark, ["a//b/./c", "../x", "/etc", "a\\b", "a\x00b"], tx.clean_path) == ["a/b/c", None, None, "a/b", "ab"]
    sql = ["x'; drop table", "UNION  select", "a--b", "/* c", "d */", "plain", "'delete"]
    assert _apply(spark, sql, tx.flag_sql_patterns) == [True, True, True, True, True, False, True]


def test_percent_coding(spark):
    texts = ["a b*~/é", "100%", "%41+%zz%", "", "x_y.z-1", "日本"]
    assert _apply(spark, texts, tx.percent_encode) == [quote(t, safe="") for t in texts]
    assert _apply(spark, texts, tx.percent_decode) == [unquote(t) for t in texts]


def test_signatures(spark):
    secrets = {"a": "k", "b": "s" * 64, "c": "long" * 40, "d": "é中"}
    bodies = ["", '{"id":"1"}', "ü" * 500]
    rows = []
    for user, secret in secrets.items():
        for i, body in enumerate(bodies):
            mac = hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest()
            rows += [(user, f"{user}{i}ok", body, base64.b64encode(mac).decode(), "valid"),
                     (user, f"{user}{i}bad", body + "x", base64.b64encode(mac).decode(), "invalid")]
    rows += [("a", "none", "b", "", "unsigned"), ("a", "mal", "b", "%%%", "malformed"), ("n", "no", "b", "x", "no_secret"),
             ("?", "unknown", "b", "x", None)]
    events = spark.createDataFrame(rows, "user_id string, id string, body string, signature string, expected string")
    settings = spark.createDataFrame([*secrets.items(), ("n", None)], "user_id string, webhook_secret string")
    known, unknown = sig.attach_secrets(events, sig.signing_pads(settings))
    checked = sig.verify_signature(known).collect()
    assert all(r.signature_status == r.expected for r in checked) and len(checked) == len(rows) - 1
    assert [r.id for r in unknown.collect()] == ["unknown"]
    strict = {r.signature_status for r in sig.verify_signature(known, reject_invalid=True).collect()}
    assert strict == {"valid", "unsigned", "no_secret"}


def test_routing(spark):
    cases = [("order.create", "paid", None, "sell"), ("order.create", "pending", None, "ignored"),
             ("order.create", None, None, "ignored"), ("order.update", "canceled", None, "restore"),
             ("order.update", "request_for_cancel", "paid", "restore"), ("order.update", "shipped", "paid", "restore"),
             ("order.update", "paid", "paid", "ignored"), ("order.update", "paid", "pending", "ignored"),
             ("order.update", None, "paid", "restore"), ("order.destroy", None, None, "restore"), ("ping", "x", None, "ignored")]
    rows = spark.createDataFrame(cases, "cause string, state string, previous string, expected string")
    args = F.col("cause"), F.col("state"), F.col("previous")
    for r in rows.select("*", ev.route(*args).alias("a"), ev.ignore_reason(*args).alias("why")).collect():
        assert r.a == r.expected and (r.why is None) == (r.a != "ignored")
    assert rows.select(ev.ignore_reason(*args)).collect()[2][0] == "Order state is '', not 'paid'"


def test_quarantine(spark):
    rows = [("db24fb13-ec73-49b8-932c-f0043dd47e86", 1, " 12 ", 0, None), ("x", 0, "1a", -1, -1), (None, None, " ", None, 5)]
    frame = spark.createDataFrame(rows, "user_id string, blueprint_id int, external_stock_id string, quantity int, price_cents int")
    good, bad = q.validate_rows(frame, {"user_id": "uuid", "blueprint_id": "blueprint_id", "external_stock_id": "stock_id",
                                        "quantity": "quantity", "price_cents": "price"})
    assert good.count() == 1
    messages = {r.user_id: [(e.field, e.message, e.value) for e in r.errors] for r in bad.collect()}
    assert messages["x"][1] == ("blueprint_id", "blueprint_id must be positive", "0") and len(messages["x"]) == 5
    assert [m[0] for m in messages[None]] == ["user_id", "blueprint_id"]
