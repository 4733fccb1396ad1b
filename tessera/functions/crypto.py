"""Encrypted fields: an AES-GCM envelope ``tsr1:<base64>`` built by JVM functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

PREFIX = "tsr1:"


def check_key(key: bytes | None) -> bytes:
    if key is None:
        raise QueryError("ENC_CONFIG_MISSING", "no encryption key is configured")
    if len(key) != 32:
        raise QueryError("ENC_KEY_INVALID", "the key must have 32 bytes")
    return key


def encrypt(value: Column, key: bytes) -> Column:
    sealed = F.base64(F.aes_encrypt(value.cast("binary"), F.lit(bytearray(check_key(key))), F.lit("GCM")))
    return F.when(value.isNotNull(), F.concat(F.lit(PREFIX), sealed))


def decrypt(value: Column, key: bytes, passthrough: bool = False) -> Column:
    """The plain text; text that isn't an envelope is an error, or passed through."""
    opened = F.decode(F.aes_decrypt(F.unbase64(F.substring(value, len(PREFIX) + 1, 1 << 30)), F.lit(bytearray(check_key(key))), F.lit("GCM")), "UTF-8")
    plain = value if passthrough else F.raise_error(F.lit("ENC_NOT_ENCRYPTED")).cast("string")
    return F.when(value.isNull(), F.lit(None).cast("string")).when(F.startswith(value, F.lit(PREFIX)), opened).otherwise(plain)
