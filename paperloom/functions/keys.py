"""Hashes, keys and delays."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted keys, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def digest_mod_10(identifier: Column | str) -> Column:
    """int(sha256(id), 16) mod 10: all powers of 16 but the first end in 6."""
    digits = F.sha2(_col(identifier).cast("string"), 256)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s + F.conv(F.substring(digits, i, F.lit(1)), 16, 10).cast("long"))
    return (total * 6 + F.conv(F.substring(digits, 64, 1), 16, 10).cast("long")) % 10


def split_of(identifier: Column | str) -> Column:
    """test, validation or train by the document's hash, so that a document never lies in two."""
    at = digest_mod_10(identifier)
    return F.when(at == 0, "test").when(at == 1, "validation").otherwise("train")


def idempotency_key(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *[_col(p).cast("string") for p in parts]), 256)


_BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def pseudonym(key: bytes, tenant: Column | str, identifier: Column | str) -> Column:
    """learner- and base 32 of the first 12 bytes of HMAC-SHA-256 over tenant, NUL and identifier. The key is an option; it is never stored."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    message = F.encode(F.concat(_col(tenant).cast("string"), F.lit("\0"), _col(identifier).cast("string")), "UTF-8")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    padded = F.concat(F.substring(digest, 1, 24), F.lit("0"))  # 96 bits and 4 more: 20 letters of 5
    letter = lambda value: F.substring(F.lit(_BASE32), value.cast("int") + 1, F.lit(1))

    def four(i: Column) -> Column:  # five hex digits are four letters
        value = F.conv(F.substring(padded, i * 5 + 1, F.lit(5)), 16, 10).cast("long")
        return F.concat(*[letter(F.shiftright(value, s) % 32) for s in (15, 10, 5, 0)])

    return F.concat(F.lit("learner-"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), four), ""))


def backoff_seconds(attempt: Column | str, base: int = 15, most_doublings: int = 8, most: int = 3600) -> Column:
    """Delay before the next try: doubled each time, bounded."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), F.least(_col(attempt), F.lit(most_doublings)))).cast("int")
