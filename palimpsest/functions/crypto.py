"""Field encryption with AES-GCM as columns.

Whole files are better encrypted by the storage or by Parquet itself; these
protect single columns, each value with its own nonce and key number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


class KeyRing:
    """Keys of 16, 24 or 32 bytes by number; the newest encrypts, all decrypt."""

    def __init__(self, keys: dict[int, bytes]) -> None:
        if not keys or any(len(k) not in (16, 24, 32) for k in keys.values()):
            raise ValueError("keys must have 16, 24 or 32 bytes")
        self.keys = dict(keys)

    @property
    def active(self) -> int:
        return max(self.keys)

    def rotate(self, key: bytes) -> KeyRing:
        return KeyRing({**self.keys, self.active + 1: key})

    def encrypt(self, column: Column) -> Column:
        """struct<key_id, data>; null stays null."""
        data = F.aes_encrypt(column.cast("binary"), F.lit(self.keys[self.active]), F.lit("GCM"))
        return F.when(column.isNotNull(), F.struct(F.lit(self.active).alias("key_id"), data.alias("data")))

    def decrypt(self, column: Column) -> Column:
        found = F.lit(None).cast("binary")
        for number, key in self.keys.items():
            plain = F.try_aes_decrypt(column["data"], F.lit(key), F.lit("GCM"))
            found = F.when(column["key_id"] == number, plain).otherwise(found)
        return found.cast("string")
