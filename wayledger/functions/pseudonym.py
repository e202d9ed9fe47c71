"""Keyed plate pseudonyms (HMAC-SHA256) as a Column expression."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


class PlateHasher:
    """HMAC over canonical plates. The key comes from a secrets manager; there is no default."""

    def __init__(self, key: bytes | str) -> None:
        raw = key.encode("utf-8") if isinstance(key, str) else key
        if len(raw) < 32:
            raise ValueError("plate key must be at least 32 bytes")
        if len(raw) > _BLOCK:
            raw = hashlib.sha256(raw).digest()
        padded = raw.ljust(_BLOCK, b"\0")
        self._inner = bytes(b ^ 0x36 for b in padded)
        self._outer = bytes(b ^ 0x5C for b in padded)

    def hash(self, canonical: Column) -> Column:
        """Hex HMAC of a canonical plate; null stays null. Runs inside whole-stage codegen."""
        message = F.encode(canonical, "UTF-8")
        inner = F.unhex(F.sha2(F.concat(F.lit(self._inner), message), 256))
        return F.sha2(F.concat(F.lit(self._outer), inner), 256)
