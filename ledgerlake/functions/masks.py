"""Masks as native column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "***"
BLOCK = 64


def mask_hash(value: Column, salt: str, production: bool = False) -> Column:
    """Hexadecimal HMAC-SHA256 of the text under the salt; an empty salt is refused in production."""
    if not salt and production:
        raise ValueError("hash masking needs a salt in production")
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def mask_redact(value: Column) -> Column:
    return F.when(value.isNotNull(), REDACTED)


def mask_partial(value: Column, reveal: int = 2) -> Column:
    """Keeps `reveal` characters at either end; texts too short for that are redacted."""
    reveal = reveal if reveal > 0 else 2
    n = F.char_length(value)
    kept = F.concat(F.left(value, F.lit(reveal)), F.repeat(F.lit("*"), n - 2 * reveal), F.right(value, F.lit(reveal)))
    return F.when(n <= 2 * reveal + 1, REDACTED).otherwise(kept)


def warehouse_mask(value: Column, mask: Column | str) -> Column:
    """The masks as warehouses apply them: hash without salt, partial with 2 characters and no short rule."""
    mask = F.lit(mask) if isinstance(mask, str) else mask
    partial = F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), F.greatest(F.char_length(value) - 4, F.lit(0))), F.right(value, F.lit(2)))
    return F.when(mask == "hash", F.sha2(value, 256)).when(mask == "redact", REDACTED).when(mask == "partial", partial).otherwise(value)


def apply_mask(value: Column, mask: str, salt: str = "") -> Column:
    """Unknown masks let the value pass."""
    return {"hash": lambda: mask_hash(value, salt), "redact": lambda: mask_redact(value), "partial": lambda: mask_partial(value)}.get(mask, lambda: value)()
