"""Blobs by id behind HTTP: GET, PUT, HEAD and DELETE of {url}/{id}. Such a service lists nothing, so reads start from ids.

Every request may be repeated, as ids name their bytes: a lost task asks or writes again. Each task holds a few connections and as many blobs at a time; an answer of 5xx or a broken
connection is tried again after a pause that doubles, any other unexpected answer is an error.
"""

from __future__ import annotations

import http.client
import itertools
import time
import urllib.parse
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Connections of a task, tries of a request, seconds before the second try, and seconds for one answer.
CONNECTIONS, TRIES, PAUSE, PATIENCE = 8, 5, 0.1, 60


class Unexpected(Exception):
    """An answer that the service's contract does not have."""


def _asker(url: str, headers: dict[str, str]) -> Callable:
    """A function (method, id, body) that returns status and bytes, over one connection that is kept."""
    parts = urllib.parse.urlsplit(url)
    kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
    connection = None

    def ask(method: str, id_: str, body: bytes | None = None) -> tuple[int, bytes]:
        nonlocal connection
        place = f"{parts.path.rstrip('/')}/{urllib.parse.quote(id_, safe='')}"
        for tried in range(1, TRIES + 1):
            try:
                connection = connection or kind(parts.netloc, timeout=PATIENCE)
                connection.request(method, place, body, headers)
                answer = connection.getresponse()
                status, data = answer.status, answer.read()
                if status < 500:
                    return status, data
                fault = f"{method} {id_}: {status}"
            except (OSError, http.client.HTTPException) as wrong:
                connection, fault = None, f"{method} {id_}: {wrong!r}"
            if tried < TRIES:
                time.sleep(PAUSE * 2 ** (tried - 1))
        raise Unexpected(fault)

    return ask


def _each(rows: DataFrame, url: str, headers: dict[str, str] | None, answer: Callable, schema: str, types: list[pa.DataType]) -> DataFrame:
    """answer(ask, *row) for each row, some at a time: a row or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        askers = [_asker(url, headers or {}) for _ in range(CONNECTIONS)]
        names = [c.split()[0] for c in schema.split(", ")]
        with ThreadPoolExecutor(CONNECTIONS) as pool:
            for batch in batches:
                for some in itertools.batched(zip(*(c.to_pylist() for c in batch.columns), strict=True), CONNECTIONS):
                    # zip pairs each row with a connection of its own
                    got = [r for r in pool.map(lambda pair: answer(pair[0], *pair[1]), zip(askers, some)) if r is not None]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), types, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def fetched(ids: DataFrame, url: str, headers: dict[str, str] | None = None) -> DataFrame:
    """(id, data) of the ids that the service has."""

    def get(ask, id_):
        status, data = ask("GET", id_)
        if status not in (200, 404):
            raise Unexpected(f"GET {id_}: {status}")
        return (id_, data) if status == 200 else None

    return _each(ids.select("id").where("id is not null").distinct(), url, headers, get, "id string, data binary", [pa.string(), pa.binary()])


def present(ids: DataFrame, url: str, headers: dict[str, str] | None = None) -> DataFrame:
    """(id, held): whether the service has each of the ids."""

    def head(ask, id_):
        status, _ = ask("HEAD", id_)
        if status not in (200, 404):
            raise Unexpected(f"HEAD {id_}: {status}")
        return id_, status == 200

    return _each(ids.select("id").where("id is not null").distinct(), url, headers, head, "id string, held boolean", [pa.string(), pa.bool_()])


def put(rows: DataFrame, url: str, headers: dict[str, str] | None = None) -> int:
    """Send (id, data), each id once; how many were sent. Rows without an id or without bytes are refused."""

    def send(ask, id_, data):
        if id_ is None or data is None:
            raise ValueError("a blob needs an id and its bytes")
        status, _ = ask("PUT", id_, data)
        if status not in (200, 201):
            raise Unexpected(f"PUT {id_}: {status}")
        return (1,)

    sent = _each(rows.select("id", "data").dropDuplicates(["id"]), url, headers, send, "sent long", [pa.int64()])
    return sent.agg(F.sum("sent")).first()[0] or 0


def removed(ids: DataFrame, url: str, headers: dict[str, str] | None = None) -> int:
    """Delete the ids, of which the service may have none; how many were asked for."""

    def delete(ask, id_):
        status, _ = ask("DELETE", id_)
        if status not in (200, 202, 204, 404):
            raise Unexpected(f"DELETE {id_}: {status}")
        return (1,)

    gone = _each(ids.select("id").where("id is not null").distinct(), url, headers, delete, "gone long", [pa.int64()])
    return gone.agg(F.sum("gone")).first()[0] or 0
