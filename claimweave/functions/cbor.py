"""Deterministic CBOR (RFC 8949): integers, byte and text strings, arrays, maps, tags, simple values and floats."""

from __future__ import annotations

import struct
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Tag:
    number: int
    value: Any


def _head(major: int, n: int) -> bytes:
    for extra, size, top in ((24, 1, 1 << 8), (25, 2, 1 << 16), (26, 4, 1 << 32), (27, 8, 1 << 64)):
        if n < 24:
            return bytes([major << 5 | n])
        if n < top:
            return bytes([major << 5 | extra]) + n.to_bytes(size, "big")
    raise ValueError("integer beyond 64 bits")


def encode(value: Any) -> bytes:
    """Shortest heads; map keys in the byte order of their encodings; floats in the shortest form that keeps the value."""
    if value is None or isinstance(value, bool):
        return {False: b"\xf4", True: b"\xf5", None: b"\xf6"}[value]
    if isinstance(value, int):
        return _head(0, value) if value >= 0 else _head(1, -1 - value)
    if isinstance(value, (bytes, bytearray)):
        return _head(2, len(value)) + bytes(value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(3, len(raw)) + raw
    if isinstance(value, (list, tuple)):
        return _head(4, len(value)) + b"".join(map(encode, value))
    if isinstance(value, dict):
        return _head(5, len(value)) + b"".join(k + v for k, v in sorted((encode(k), encode(v)) for k, v in value.items()))
    if isinstance(value, Tag):
        return _head(6, value.number) + encode(value.value)
    if isinstance(value, float):
        if value != value:
            return b"\xf9\x7e\x00"
        for mark, form in ((b"\xf9", ">e"), (b"\xfa", ">f"), (b"\xfb", ">d")):
            try:
                raw = struct.pack(form, value)
            except OverflowError:
                continue
            if struct.unpack(form, raw)[0] == value:
                return mark + raw
    raise TypeError(type(value))


def decode(data: bytes) -> Any:
    """One item that fills data; a ValueError otherwise."""
    value, at = read(data, 0)
    if at != len(data):
        raise ValueError("bytes after the item")
    return value


def read(data: bytes, at: int) -> tuple[Any, int]:
    """The item at a place, and the place behind it: sequences of items are read by repeating this."""
    if at >= len(data):
        raise ValueError("item cut short")
    major, n = data[at] >> 5, data[at] & 31
    at += 1
    if major == 7 and n in (25, 26, 27):
        size = {25: 2, 26: 4, 27: 8}[n]
        if at + size > len(data):
            raise ValueError("item cut short")
        return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[n], data[at : at + size])[0], at + size
    if n > 27:
        raise ValueError("indefinite length or reserved head")
    if n > 23:
        size = 1 << (n - 24)
        if at + size > len(data):
            raise ValueError("item cut short")
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
    if major < 2:
        return (n if major == 0 else -1 - n), at
    if major in (2, 3):
        if at + n > len(data):
            raise ValueError("item cut short")
        raw = data[at : at + n]
        return (raw if major == 2 else raw.decode()), at + n
    if major == 4:
        items = []
        for _ in range(n):
            item, at = read(data, at)
            items.append(item)
        return items, at
    if major == 5:
        out: dict = {}
        for _ in range(n):
            key, at = read(data, at)
            value, at = read(data, at)
            if key in out:
                raise ValueError("repeated key")
            out[key] = value
        return out, at
    if major == 6:
        value, at = read(data, at)
        return Tag(n, value), at
    if n in (20, 21, 22):
        return {20: False, 21: True, 22: None}[n], at
    raise ValueError(f"simple value {n}")


def sequence(data: bytes) -> list[Any]:
    """The items of a CBOR sequence (RFC 8742)."""
    out, at = [], 0
    while at < len(data):
        item, at = read(data, at)
        out.append(item)
    return out
