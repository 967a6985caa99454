"""Hash-derived integers and seeds."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(text: Column) -> Column:
    """First 32 bits of the MD5 of a string, as a bigint; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def seed_material(block_hash: Column, submitter: Column, seed: Column) -> Column:
    """Text that a sampling seed is made of; no block hash, or ``default``, leaves the base seed alone."""
    block, who = F.trim(F.coalesce(block_hash, F.lit(""))), F.trim(F.coalesce(submitter, F.lit("")))
    base = F.concat(F.lit("base_seed="), seed.cast("string"))
    full = F.concat(F.lit("block_hash="), block, F.lit("|hotkey="), who, F.lit("|"), base)
    return F.when((block != "") & (block != "default"), full).otherwise(base)


def blake_seed(text: str, order: str = "little") -> int:
    """64-bit BLAKE2b of a text as an integer."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), order)


def source_seed(seed: int, source: str) -> int:
    return blake_seed(f"{seed}:{source}")


def keyed_seed(secret: bytes, label: str) -> int:
    """Seed that only a holder of the secret can make."""
    return int.from_bytes(hmac.new(secret, label.encode(), hashlib.sha256).digest()[:8], "little")


def iteration_seed(i: Column, salt: int = 0x9E3779B9) -> Column:
    """(i * salt) xor salt, kept to 32 bits."""
    return (i.cast("long") * F.lit(salt).cast("long")).bitwiseXOR(F.lit(salt).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
