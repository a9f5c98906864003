"""Paged service clients over a transport that the caller supplies, so that no module here opens a connection.

A transport is a function from request parameters to decoded JSON. Pages are gathered on the driver by nature of the
protocols; `as_table` lands their records as JSON rows for sources.records to parse.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

Transport = Callable[[Mapping], Mapping]


class ServiceError(RuntimeError):
    pass


def cursor_scan(transport: Transport, query: str, size: int = 1000, field: str = "id") -> list[str]:
    """Distinct ids of all pages, in order; ends at an empty page or a cursor that is missing or stays. What was read so
    far is kept when a page fails."""
    ids: dict[str, None] = {}
    cursor = "*"
    while True:
        try:
            page = transport({"query": query, "cursorMark": cursor, "pageSize": size})
        except Exception:  # noqa: BLE001 - a partial result is the contract
            break
        rows = page.get("resultList", {}).get("result", [])
        ids.update((str(r[field]), None) for r in rows if r.get(field))
        following = page.get("nextCursorMark")
        if not rows or not following or following == cursor:
            break
        cursor = following
    return list(ids)


def batched_lookup(transport: Transport, ids: Sequence[str], size: int = 50, key: str = "EXT_ID") -> list[Mapping]:
    """Records of all ids, asked for `size` at a time; a batch that fails is skipped."""
    out: list[Mapping] = []
    for i in range(0, len(ids), size):
        try:
            page = transport({"query": " OR ".join(f"{key}:{x}" for x in ids[i : i + size]), "pageSize": size})
        except Exception:  # noqa: BLE001
            continue
        out += page.get("resultList", {}).get("result", [])
    return out


def expanded_symbols(transport: Transport, symbols: Iterable[str]) -> set[str]:
    """Lower-cased symbols, names, descriptions and aliases of the genes a service knows."""
    out: set[str] = set()
    for s in symbols:
        out.add(s.strip().lower())
        for r in transport({"symbol": s}).get("genes", []):
            words = [r.get("symbol"), r.get("name"), r.get("description"), *(r.get("aliases") or [])]
            out |= {w.strip().lower() for w in words if w and w.strip()}
    return out - {""}


def validated_symbols(transport: Transport, symbols: Sequence[str], size: int = 1000) -> set[str]:
    """The symbols that a service finds, asked for `size` at a time."""
    names = list(dict.fromkeys(symbols))
    return {x for i in range(0, len(names), size) for x in transport({"symbols": names[i : i + size]}).get("found", [])}


class GraphQL:
    """Executes queries with up to `tries` tries and linear back-off; errors and odd shapes raise."""

    def __init__(self, transport: Transport, tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
        self.transport, self.tries, self.wait, self.sleep = transport, tries, wait, sleep

    def execute(self, query: str, variables: Mapping) -> Mapping:
        last: Exception | None = None
        for n in range(1, self.tries + 1):
            try:
                got = self.transport({"query": query, "variables": dict(variables)})
                if got.get("errors"):
                    raise ServiceError(str(got["errors"]))
                if not isinstance(got.get("data"), Mapping):
                    raise ServiceError("no data object")
                return got["data"]
            except Exception as e:  # noqa: BLE001
                last = e
                if n < self.tries:
                    self.sleep(self.wait * n)
        raise ServiceError(f"failed {self.tries} times: {last}")

    def pages(self, query: str, variables: Mapping, path: Sequence[str], size: int) -> Iterator[Mapping]:
        """Rows of a paged object at `path` that holds `count` and `rows`; ends at the count, else at a short or empty page."""
        index = seen = 0
        while True:
            at: object = self.execute(query, {**variables, "page": {"index": index, "size": size}})
            for name in path:
                at = at.get(name) if isinstance(at, Mapping) else None
            if not isinstance(at, Mapping):
                if index == 0:
                    raise ServiceError(f"nothing at {'.'.join(path)}")
                return
            rows = [r for r in at.get("rows") or [] if isinstance(r, Mapping)]
            yield from rows
            seen, index, count = seen + len(rows), index + 1, at.get("count")
            if not rows or (len(rows) < size if count is None else seen >= int(count)):
                return


def as_table(spark: SparkSession, records: Iterable[Mapping], **constants: str) -> DataFrame:
    """One JSON row per record, with constant columns (such as the locus that was asked for)."""
    rows = [(*constants.values(), json.dumps(r)) for r in records]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*constants, "json"]))
