"""Content addresses: SHA2-256 multihashes in lower-case base 32."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import cbor

#: Code and length of a SHA2-256 multihash, and the letter that names its text form.
MULTIHASH, MULTIBASE = b"\x12\x20", "b"


def text_of(digest: bytes) -> str:
    return MULTIBASE + base64.b32encode(MULTIHASH + digest).decode().rstrip("=").lower()


def digest_of(text: str) -> bytes:
    """The digest in an id; a ValueError for anything else."""
    raw = base64.b32decode(text[1:].upper() + "=" * (-(len(text) - 1) % 8)) if text[:1] == MULTIBASE else b""
    if raw[:2] != MULTIHASH or len(raw) != 34:
        raise ValueError(f"not a content address: {text!r}")
    return raw[2:]


def address(content: bytes) -> str:
    return text_of(hashlib.sha256(content).digest())


def sequence_id(index: int, seed: bytes) -> str:
    """The slot of a bookmark: the address of the pair (index, seed)."""
    return address(cbor.encode([index, seed]))


#: Base 32 as Spark's conv() writes it, and as addresses do.
CONV, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "abcdefghijklmnopqrstuvwxyz234567"


def address_column(content: Column) -> Column:
    """The address of a binary column, by built-in functions: seven groups of 40 bits, each as eight digits; the last digit of the padded number is no part of it."""
    digits = F.concat(F.lit(MULTIHASH.hex()), F.sha2(content, 256), F.lit("00"))
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(7)]
    return F.concat(F.lit(MULTIBASE), F.translate(F.substring(F.concat(*groups), 1, 55), CONV, BASE32))


def addressed(rows: DataFrame, column: str) -> DataFrame:
    """rows with `address` of a binary column."""
    return rows.withColumn("address", address_column(F.col(column)))
