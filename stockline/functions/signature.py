"""HMAC-SHA256 signatures of event bodies, in built-in functions only.

The two padded keys depend on the secret alone, so they are computed once per seller and joined to
the events; per event two SHA-256 calls remain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEX = "0123456789abcdef"
BLOCK_BYTES = 64


def _xor_hex(text: Column, byte: int) -> Column:
    """XOR every byte of a 128-digit hex text with one byte value."""
    high = "".join(_HEX[i ^ (byte >> 4)] for i in range(16))
    low = "".join(_HEX[i ^ (byte & 15)] for i in range(16))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BYTES - 1)), lambda i: F.concat(
        F.translate(F.substring(text, i * 2 + 1, F.lit(1)), _HEX, high),
        F.translate(F.substring(text, i * 2 + 2, F.lit(1)), _HEX, low)))
    return F.when(text.isNotNull(), F.array_join(pairs, ""))


def signing_pads(settings: DataFrame) -> DataFrame:
    """user_id, webhook_secret and the inner and outer pad of every seller's secret."""
    secret = F.encode("webhook_secret", "UTF-8")
    key = F.when(F.octet_length(secret) > BLOCK_BYTES, F.sha2(secret, 256)).otherwise(F.lower(F.hex(secret)))
    block = F.rpad(key, BLOCK_BYTES * 2, "0")
    return (settings.select("user_id", "webhook_secret", block.alias("_block"))
            .select("user_id", "webhook_secret", F.unhex(_xor_hex(F.col("_block"), 0x36)).alias("inner_pad"),
                    F.unhex(_xor_hex(F.col("_block"), 0x5C)).alias("outer_pad")))


def hmac_sha256(body: Column, inner_pad: Column, outer_pad: Column) -> Column:
    """Hex digest of the signature; ``body`` is binary."""
    return F.sha2(F.concat(outer_pad, F.unhex(F.sha2(F.concat(inner_pad, body), 256))), 256)


def attach_secrets(events: DataFrame, pads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with their seller's pads, events of unknown sellers)."""
    joined = events.join(pads.withColumn("_known", F.lit(True)), "user_id", "left")
    known = F.col("_known").isNotNull()
    return joined.where(known).drop("_known"), joined.where(~known).select(*events.columns)


def verify_signature(events: DataFrame, reject_invalid: bool = False) -> DataFrame:
    """Add ``signature_status``: valid, invalid, malformed, unsigned or no_secret.

    Input: events from ``attach_secrets`` with a text ``body`` and a base64 ``signature``. Events
    with a bad signature are kept unless ``reject_invalid``.
    """
    given = F.try_to_binary(F.col("signature"), F.lit("base64"))
    computed = hmac_sha256(F.encode("body", "UTF-8"), F.col("inner_pad"), F.col("outer_pad"))
    status = (F.when(F.coalesce(F.col("webhook_secret"), F.lit("")) == "", "no_secret")
              .when(F.coalesce(F.col("signature"), F.lit("")) == "", "unsigned")
              .when(given.isNull(), "malformed")
              .when(F.lower(F.hex(given)) == computed, "valid").otherwise("invalid"))
    checked = events.withColumn("signature_status", status)
    if reject_invalid:
        checked = checked.where(~F.col("signature_status").isin("invalid", "malformed"))
    return checked
