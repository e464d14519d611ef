"""The reversible mapping of a case, sealed under a passphrase: scrypt gives the key, the engine's AES-GCM seals the rows."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: scrypt's cost and block parameters and the shortest passphrase.
N, R, P, SHORTEST = 1 << 15, 8, 1, 8


def key(passphrase: str, salt: bytes) -> bytes:
    if len(passphrase) < SHORTEST:
        raise ValueError(f"a passphrase has at least {SHORTEST} characters")
    return hashlib.scrypt(passphrase.encode(), salt=salt, n=N, r=R, p=P, maxmem=64 << 20, dklen=32)


def new_salt() -> bytes:
    return os.urandom(16)


def seal(mapping: DataFrame, passphrase: str, salt: bytes | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, salt, sealed) rows of (entity_id, original, replacement); columns in ``keep`` stay readable."""
    salt = salt or new_salt()
    row = F.to_json(F.struct("entity_id", "original", "replacement"))
    return mapping.select(*keep, F.lit(salt).alias("salt"), F.aes_encrypt(row, F.lit(key(passphrase, salt)), F.lit("GCM")).alias("sealed"))


def unseal(sealed: DataFrame, passphrase: str) -> DataFrame:
    """The mapping again; a wrong passphrase fails as GCM's tag does not match."""
    salts = [bytes(r.salt) for r in sealed.select("salt").distinct().collect()]
    chosen = F.lit(None).cast("binary")
    for s in salts:
        chosen = F.when(F.col("salt") == F.lit(s), F.lit(key(passphrase, s))).otherwise(chosen)
    row = F.aes_decrypt("sealed", chosen, F.lit("GCM")).cast("string")
    return sealed.select(F.from_json(row, "entity_id string, original string, replacement string").alias("r")).select("r.*")
