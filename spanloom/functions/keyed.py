"""Keyed, repeatable choices: HMAC-SHA256 built from the engine's own digest, so no row leaves the JVM.

Key blocks stand in the plan as hex literals. Set ``spark.sql.redaction.string.regex`` to ``[0-9a-fA-F]{64,}`` where plans,
the UI or event logs may be seen by others.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the amount factor and the date shift are derived from, and their ranges.
FACTOR_TEXT, SHIFT_TEXT = "összeg-szorzó", "dátum-eltolás"
FACTOR_LOW, FACTOR_HIGH, DEAD_LOW, DEAD_HIGH = 0.8, 1.25, 0.97, 1.03
SHIFT_LEAST, SHIFT_MOST = 30, 400


def pads(secret: str) -> tuple[str, str]:
    """Hex of the inner and the outer key block (RFC 2104)."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_hex(secret: str, message: Column) -> Column:
    inner, outer = pads(secret)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def keyed_index(secret: str, message: Column, n: Column | int) -> Column:
    """The first six bytes of the HMAC of the lower-cased message, modulo ``n``."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.pmod(F.conv(F.substring(hmac_hex(secret, F.lower(message)), 1, 12), 16, 10).cast("long"), size)


def index_of(secret: str, message: str, n: int) -> int:
    """``keyed_index`` for one message on the driver."""
    return int.from_bytes(hmac.digest(secret.encode(), message.lower().encode(), "sha256")[:6]) % n


def amount_factor(secret: str) -> float:
    """A case's factor: between .8 and 1.25 but not within three hundredths of one, to four places."""
    share = int.from_bytes(hmac.digest(secret.encode(), FACTOR_TEXT.encode(), "sha256")[:6]) % 1_000_000 / 1_000_000
    low, high = DEAD_LOW - FACTOR_LOW, FACTOR_HIGH - DEAD_HIGH
    at = share * (low + high)
    return int((FACTOR_LOW + at if at < low else DEAD_HIGH + (at - low)) * 10000 + 0.5) / 10000


def date_shift(secret: str) -> int:
    """A case's shift in days: 30 to 400 either way."""
    digest = hmac.digest(secret.encode(), SHIFT_TEXT.encode(), "sha256")
    size = SHIFT_LEAST + int.from_bytes(digest[:6]) % (SHIFT_MOST - SHIFT_LEAST + 1)
    return size if digest[6] & 1 else -size
