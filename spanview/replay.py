"""Replay of mutation traces through systems, with measures taken against the workspace itself.

A trace's workspace (its texts, its reads and what they say now) is the same for all systems, so it is kept once for all of them.
Traces of one file mostly begin alike: what all of them begin with is replayed once, and each goes on from there for itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Mapping, Sequence

from . import engine
from .engine import copied, sha256, utf8_length

SYSTEMS = ("append-only", "observation-mask", "whole-file", "unit-file", "unit-region")
_DOLLAR = re.compile(r"\$([$&`'])")
_WHOLE = re.compile(r'\[whole-file path="([^"]+)"\]\n?')


class TraceError(ValueError):
    """A trace that its workspace contradicts."""


def key(read: Mapping) -> str:
    return "\0".join(str("" if x is None else x) for x in (read["path"], read["scope"] or "region", read["selector"], read["start_line"], read["end_line"]))


def replace_first(text: str, expected: str, replacement: str) -> str:
    """text with the first place of expected replaced; `$&` and its like in the replacement stand for parts of text."""
    expected, replacement = (x.replace("\r\n", "\n") for x in (expected, replacement))
    at = text.find(expected)
    if at < 0:
        raise TraceError("replace-exact miss")
    before, after = text[:at], text[at + len(expected) :]
    if "$" in replacement:
        parts = {"$": "$", "&": expected, "`": before, "'": after}
        replacement = _DOLLAR.sub(lambda m: parts[m[1]], replacement)
    return f"{before}{replacement}{after}"


def lines_of(text: str, first: int | None, last: int | None) -> str:
    # Lines past the last one that is asked for need no objects of their own.
    own = text.split("\n", last) if last is not None and last >= 0 <= (first or 1) - 1 else text.split("\n")
    return "\n".join(own[(first or 1) - 1 : last])


def current_text(files: Mapping[str, str], read: Mapping) -> str:
    """What a read would show now: by its lines if the first one is still in place, else by the one line equal to it."""
    text = files.get(read["path"])
    if text is None:
        return ""
    if read["scope"] == "file":
        return text
    by_line = lines_of(text, read["start_line"], read["end_line"])
    anchor = read["initial"].split("\n")[0]
    if by_line.split("\n")[0] == anchor:
        return by_line
    own = text.split("\n")
    places = [i for i, x in enumerate(own) if x == anchor]
    if len(places) == 1:
        return "\n".join(own[places[0] : places[0] + read["end_line"] - read["start_line"] + 1])
    return by_line


def occurrences(text: str, needle: str) -> int:
    return text.count(needle) if needle else 0


class _System:
    """Messages of one strategy; capture() returns the payload and the projection in it."""

    def __init__(self, name: str, parser=None):
        if name not in SYSTEMS:
            raise ValueError(f"unknown system: {name}")
        self.name, self.history, self.paths = name, [], set()
        self.session = engine.Session(parser) if name.startswith("unit-") else None
        #: Its last payload, and the measures of each capture.
        self.shown, self.out = b"", []

    def fork(self) -> _System:
        out = copied(self)
        out.history, out.paths, out.out = list(self.history), set(self.paths), list(self.out)
        if self.session is not None:
            out.session = self.session.fork()
        return out

    def read(self, read: Mapping, content: str, file_text: str) -> None:
        path = read["path"]
        self.paths.add(path)
        if self.name == "append-only":
            self.history.append(content)
        elif self.name == "observation-mask":
            self.history.append(f"[observation-mask:{path}] An earlier read stood here; this system shows no text instead.")
        elif self.name == "whole-file":
            self.history.append(f"sync: {path}")
        else:
            if self.name == "unit-file":
                unit = self.session.read(path, file_text, scope="file")
            else:
                unit = self.session.read(path, content, read["scope"], read["start_line"] or 1, read["end_line"], read["selector"])
            self.history.append(engine.read_marker(unit.id, unit.path))

    def capture(self, event: Mapping, files: Mapping[str, str]) -> tuple[str, str]:
        task = f"TASK: {event['task']}"
        if self.session is None:
            own = sorted(p for p in self.paths if p in files) if self.name == "whole-file" else []
            projection = "\n\n".join(f'[whole-file path="{p}"]\n{files[p]}' for p in own)
            if self.name == "whole-file":
                return "\n\n".join([*self.history, task, *([projection] if projection else [])]), projection
            self_history = self.history
            if self.name == "append-only":
                self_history.append(task)
                return "\n\n".join(self_history), ""
            return "\n\n".join([*self_history, task]), ""
        if self.name == "unit-region":
            self.session.turn += 1
        self.session.refresh({p: files.get(p) for p in self.paths})
        projection = self.session.project(event["task"] or "", event["budget"])["text"]
        return "\n\n".join([*self.history, projection]), projection

    def units(self, payload: str, data: bytes) -> list[tuple[str | None, str]]:
        """(path, content) of the code that a payload shows; data is the payload in UTF-8."""
        if self.session is not None:
            return [(u.get("path"), u["content"]) for u in engine.decode(data)]
        if self.name == "whole-file":
            found = _WHOLE.split(payload)
            return [(p, c.rstrip()) for p, c in zip(found[1::2], found[2::2])]
        if self.name == "append-only":
            return [(None, b) for b in payload.split("\n\n") if b.strip() and not b.startswith("TASK:")]
        return []


def common_start(a: bytes, b: bytes) -> int:
    """Bytes in which both agree from the start, by bisection."""
    low, high = 0, min(len(a), len(b))
    if a.startswith(b) or b.startswith(a):
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def measure(system: _System, payload: str, projection: str, reads: list[dict], required: list[dict], gold: Mapping[str, str], hashed: bool = True) -> dict:
    """Measures of a payload; with hashed, its hash too. The payload is then what the system showed last."""
    a, b = system.shown, payload.encode()
    shown = system.units(payload, b)
    hits = stale_units = stale_bytes = twice = twice_bytes = exact = 0
    first: dict[str, str] = {}
    for r in required:
        text = gold[r["key"]]
        n = occurrences(payload, text)
        hits += n > 0 or (r["path"], text) in shown
        if n > 1:
            twice, twice_bytes = twice + n - 1, twice_bytes + (n - 1) * utf8_length(text)
        first.setdefault(r["path"], text)
    for r in reads:
        if r["initial"] != gold[r["key"]] and (n := occurrences(payload, r["initial"])):
            stale_units, stale_bytes = stale_units + 1, stale_bytes + n * utf8_length(r["initial"])
    for p, c in shown:
        exact += p in first and c == first[p]
    out = {
        "exact_rate": exact / max(1, len(shown)), "recall": hits / len(required) if required else 1.0, "stale_rate": stale_units / max(1, len(reads)),
        "stale_units": stale_units, "stale_bytes": stale_bytes, "duplicate_units": twice, "duplicate_bytes": twice_bytes,
        "projection_bytes": utf8_length(projection) if projection else len(b), "payload_bytes": len(b), "prefix_reuse": common_start(a, b) / max(1, len(a)) if a else 1.0,
        "required": len(required), "projected": len(shown),
    }
    if hashed:
        out["payload_sha256"] = hashlib.sha256(b).hexdigest()
    system.shown = b
    return out


def _matching(reads: list[dict], unit: Mapping) -> dict | None:
    return next((r for r in reads if r["path"] == unit["path"] and (not unit["selector"] or r["selector"] == unit["selector"])), None)


class _Replay:
    """A trace up to some event: its workspace, which is the same for all systems, and the systems."""

    def __init__(self, files: Mapping[str, str], names: Sequence[str], parser=None, hashed: bool = True):
        self.now, self.hashed = dict(files), hashed
        self.reads: list[dict] = []
        self.systems = [_System(name, parser) for name in names]

    def fork(self) -> _Replay:
        out = copied(self)
        out.now, out.reads, out.systems = dict(self.now), list(self.reads), [s.fork() for s in self.systems]
        return out

    def step(self, event: Mapping) -> None:
        """One event; raises TraceError where the trace contradicts its workspace."""
        kind, path, now = event["type"], event["path"], self.now
        if kind == "read":
            if path not in now:
                raise TraceError(f"no such file: {path}")
            content = now[path] if event["scope"] == "file" else lines_of(now[path], event["start_line"], event["end_line"])
            read = {**event, "key": key(event), "initial": content}
            self.reads.append(read)
            for system in self.systems:
                system.read(read, content, now[path])
        elif kind == "replace-exact":
            now[path] = replace_first(now.get(path, ""), event["expected"], event["replacement"])
        elif kind == "delete-file":
            now.pop(path, None)
        elif kind == "capture-request":
            self._capture(event)
        else:
            raise TraceError(f"unknown event: {kind}")

    def _capture(self, event: Mapping) -> None:
        now, reads = self.now, self.reads
        gold = {r["key"]: current_text(now, r) for r in reads}
        required = []
        for unit in event["required"] or []:
            match = _matching(reads, unit)
            k = match["key"] if match else key({"path": unit["path"], "scope": "file", "selector": unit["selector"], "start_line": None, "end_line": None})
            text = gold.setdefault(k, now.get(unit["path"], ""))
            if not text:
                raise TraceError(f"no current text for {unit['path']}")
            if sha256(text) != unit["sha256"]:
                raise TraceError(f"independent oracle mismatch for {unit['path']}")
            required.append({"path": unit["path"], "key": k})
        for system in self.systems:
            payload, projection = system.capture(event, now)
            method = None
            if system.session is not None:
                method = ",".join(u.method if u.state == "resolved" else "unresolved" for u in system.session.units.values())
            system.out.append({"capture": len(system.out), "task": event["task"], "method": method, **measure(system, payload, projection, reads, required, gold, self.hashed)})


def _common(traces: Sequence[Mapping]) -> int:
    """How many events all traces begin with; none where their files differ."""
    first, n = traces[0], len(traces[0]["events"])
    for t in traces[1:]:
        if t["files"] != first["files"]:
            return 0
        n = next((i for i, (x, y) in enumerate(zip(first["events"][:n], t["events"])) if x != y), min(n, len(t["events"])))
    return n


def run_all(traces: Sequence[Mapping], names: Sequence[str], parser=None, hashed: bool = True) -> Iterator[list[list[dict]] | TraceError]:
    """Of each trace, the measures of each capture, by system as named; or the error where the trace contradicts its workspace, which is the same for all systems."""
    if not traces:
        return
    n = _common(traces)
    begun, wrong = _Replay(dict(traces[0]["files"]), names, parser, hashed), None
    try:
        for event in traces[0]["events"][:n]:
            begun.step(event)
    except TraceError as e:
        wrong = e
    for i, trace in enumerate(traces):
        if wrong is not None:
            yield wrong
            continue
        if n == 0 and i:
            begun = _Replay(dict(trace["files"]), names, parser, hashed)
        own = begun if n == 0 or i == len(traces) - 1 else begun.fork()
        try:
            for event in trace["events"][n:]:
                own.step(event)
        except TraceError as e:
            yield e
        else:
            yield [s.out for s in own.systems]


def run(files: Mapping[str, str], events: list[Mapping], name: str, parser=None) -> list[dict]:
    """Measures of each capture of a trace; raises TraceError where the trace contradicts its workspace."""
    (out,) = run_all([{"files": files, "events": events}], (name,), parser)
    if isinstance(out, TraceError):
        raise out
    return out[0]


def family(name: str) -> str:
    parts = name.split("/")
    return parts[1] if len(parts) > 1 else "unknown"


def repository(url: str | None, name: str) -> str:
    """Short name of a trace's repository: the last part of its URL, else the first part of the trace's name."""
    found = re.search(r"([^/:]+?)(?:\.git)?/*$", url or "")
    return found[1] if found and found[1] else name.split("/")[0] or "unknown"
