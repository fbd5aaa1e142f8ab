"""A node's REST interface, and the same over local files."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import islice
from pathlib import Path
from typing import Any, Protocol

from tidemark.streaming.retry import BlockNotFound, RateLimited, retry

from .revision import Revision

#: Seconds between polls at the tip, after an error there, and when the node limits calls.
POLL, ERROR, LIMITED = 3.0, 10.0, 10.0
#: Fixed value: logs of a page.
PAGE = 1000
#: Block files of a range that are asked for one by one, and nanoseconds after which a folder's change time tells any later change.
PROBES, SETTLED = 10_000, 2_000_000_000

#: Of each folder of blocks: when it was changed last, and its best block then.
_best: dict[str, tuple[int, int | None]] = {}


class Client(Protocol):
    def block(self, revision: str | int, expanded: bool = True) -> dict: ...

    def logs(self, kind: str, first: int, last: int, offset: int, limit: int, criteria: Sequence[Mapping] = ()) -> list[dict]: ...

    def inspect(self, clauses: Sequence[Mapping], revision: str | int = "best") -> list[dict]: ...

    def account(self, address: str, revision: str | int = "best") -> dict: ...

    def code(self, address: str, revision: str | int = "best") -> str: ...


class HttpClient:
    """Calls of a node: blocks, logs of events and transfers, simulated calls, accounts."""

    def __init__(self, url: str, headers: Mapping[str, str] | None = None, timeout: float = 30.0):
        self.url, self.headers, self.timeout = url.rstrip("/"), dict(headers or {}), timeout

    def _call(self, path: str, body: Any = None) -> Any:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url + path, data, self.headers | {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                text = r.read().decode()
        except urllib.error.HTTPError as e:
            if e.code == 429:
                raise RateLimited(path) from e
            raise
        return json.loads(text) if text.strip() else None

    def block(self, revision: str | int, expanded: bool = True) -> dict:
        r = Revision.parse(revision)
        got = self._call(f"/blocks/{r}?expanded={str(expanded).lower()}")
        if got is None:
            raise BlockNotFound(str(r))
        return got

    def logs(self, kind: str, first: int, last: int, offset: int = 0, limit: int = PAGE, criteria: Sequence[Mapping] = ()) -> list[dict]:
        body = {"range": {"unit": "block", "from": first, "to": last}, "options": {"offset": offset, "limit": limit}, "order": "asc"}
        if criteria:
            body["criteriaSet"] = [dict(c) for c in criteria]
        return self._call(f"/logs/{kind}", body) or []

    def inspect(self, clauses: Sequence[Mapping], revision: str | int = "best") -> list[dict]:
        return self._call(f"/accounts/*?revision={Revision.parse(revision)}", {"clauses": [dict(c) for c in clauses]}) or []

    def account(self, address: str, revision: str | int = "best") -> dict:
        return self._call(f"/accounts/{address}?revision={Revision.parse(revision)}")

    def code(self, address: str, revision: str | int = "best") -> str:
        return self._call(f"/accounts/{address}/code?revision={Revision.parse(revision)}")["code"]


class FileClient:
    """A folder of ``blocks/<number>.json``, for tests and replays. The best and the finalized block are options.

    A block is one file to open, a short range as many, whatever else the folder holds. It is listed for the best
    block, once for as long as nothing is added or removed, and for long ranges. The next page of a scan goes on
    where the last one ended.
    """

    def __init__(self, folder: str, finalized: int | None = None):
        self.folder, self.last = Path(folder), finalized
        self._scan: tuple = ()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_scan": ()}

    def _numbers(self) -> list[int]:
        try:
            with os.scandir(self.folder / "blocks") as found:
                return sorted(int(p.name[:-5]) for p in found if p.name.endswith(".json"))
        except FileNotFoundError:
            return []

    def _block(self, number: int) -> dict:
        try:
            return json.loads((self.folder / "blocks" / f"{number}.json").read_text("utf-8"))
        except FileNotFoundError:
            raise BlockNotFound(str(number)) from None

    def _best(self) -> int | None:
        at = self.folder / "blocks"
        if not at.is_dir():
            return None
        stamp, known = at.stat().st_mtime_ns, _best.get(str(at))
        if known and known[0] == stamp:
            return known[1]
        settled = time.time_ns() - stamp > SETTLED
        best = max(self._numbers(), default=None)
        if settled:
            _best[str(at)] = stamp, best
        return best

    def block(self, revision: str | int, expanded: bool = True) -> dict:
        r = Revision.parse(revision)
        if r.kind == "id":
            got = next((b for b in map(self._block, self._numbers()) if b["id"].lower() == r.value), None)
            if got is None:
                raise BlockNotFound(r.value)
        else:
            number = int(r.value) if r.kind == "number" else self._best() if r.value == "best" or self.last is None else self.last
            if number is None:
                raise BlockNotFound(r.value)
            got = self._block(number)
        return got if expanded else got | {"transactions": [t["id"] for t in got["transactions"]]}

    def _logs(self, kind: str, first: int, last: int, criteria: Sequence[Mapping]) -> Iterator[dict]:
        for n in range(first, last + 1) if last - first < PROBES else [n for n in self._numbers() if first <= n <= last]:
            try:
                b = self._block(n)
            except BlockNotFound:
                continue
            for t in b["transactions"]:
                for i, o in enumerate(t["outputs"]):
                    meta = {"blockID": b["id"], "blockNumber": n, "blockTimestamp": b["timestamp"], "txID": t["id"], "txOrigin": t["origin"], "clauseIndex": i}
                    for x in o["events" if kind == "event" else "transfers"]:
                        row = dict(x, meta=meta)
                        if not criteria or any(_meets(row, c) for c in criteria):
                            yield row

    def logs(self, kind: str, first: int, last: int, offset: int = 0, limit: int = PAGE, criteria: Sequence[Mapping] = ()) -> list[dict]:
        scan = (kind, first, last, [dict(c) for c in criteria])
        if offset and self._scan[:2] == (scan, offset):
            rows = self._scan[2]
        else:
            rows = islice(self._logs(kind, first, last, criteria), offset, None)
        self._scan = ()
        out = list(islice(rows, limit))
        self._scan = (scan, offset + len(out), rows)
        return out

    def inspect(self, clauses: Sequence[Mapping], revision: str | int = "best") -> list[dict]:
        return [{"data": c.get("data") or "0x", "events": [], "transfers": [], "gasUsed": 0, "reverted": False, "vmError": None} for c in clauses]

    def account(self, address: str, revision: str | int = "best") -> dict:
        return {"balance": "0x0", "energy": "0x0", "hasCode": False}

    def code(self, address: str, revision: str | int = "best") -> str:
        return "0x"


def _meets(row: Mapping, criteria: Mapping) -> bool:
    for k, v in criteria.items():
        if v is None:
            continue
        got = row["meta"]["txOrigin"] if k == "txOrigin" else (row["topics"][int(k[5:])] if int(k[5:]) < len(row["topics"]) else None) if k.startswith("topic") else row.get(k)
        if got is None or got.lower() != v.lower():
            return False
    return True


def client(options: Mapping[str, str]) -> HttpClient | FileClient:
    """From options: ``url`` of a node, or ``path`` of a folder."""
    if options.get("url"):
        return HttpClient(options["url"])
    if options.get("path"):
        return FileClient(options["path"], int(options["finalized"]) if options.get("finalized") else None)
    raise ValueError("the source needs a url or a path")


def pages(own: Client, kind: str, first: int, last: int, limit: int = PAGE, criteria: Sequence[Mapping] = (), attempts: int | None = 1) -> Iterator[list[dict]]:
    """The pages of a log scan, ascending, until one is short; one is held at a time."""
    offset = 0
    while True:
        page = retry(lambda: own.logs(kind, first, last, offset, limit, criteria), passes=(), attempts=attempts)  # noqa: B023
        yield page
        if len(page) < limit:
            return
        offset += len(page)


def drain(own: Client, kind: str, first: int, last: int, limit: int = PAGE, criteria: Sequence[Mapping] = ()) -> Iterator[dict]:
    """All logs of a scan."""
    for page in pages(own, kind, first, last, limit, criteria):
        yield from page


def best(own: Client, expanded: bool = True) -> dict:
    return own.block("best", expanded)


def finalized(own: Client, expanded: bool = True) -> dict:
    return own.block("finalized", expanded)


def justified(own: Client, expanded: bool = True) -> dict:
    return own.block("justified", expanded)


def wait_for(own: Client, revision: str | int, expanded: bool = True, stopped: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A block as soon as the node has it."""
    while True:
        if stopped():
            raise InterruptedError(str(revision))
        try:
            return own.block(revision, expanded)
        except BlockNotFound:
            sleep(POLL)
        except RateLimited:
            sleep(LIMITED)
        except OSError:
            sleep(ERROR)
