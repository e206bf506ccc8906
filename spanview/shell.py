"""Shell commands that read files, recognised by their words; nothing is executed."""

from __future__ import annotations

import re

_UNSAFE = re.compile(r"[|;&><`$()\n]")
_WRAPPED = re.compile(r"bash\s+-l?c\s+(?:'([^']*)'|\"([^\"]*)\")\s*")
_RANGE = re.compile(r"(['\"]?)(\d+)(?:,(\d+))?p\1")
_WORD = re.compile(r"[ \t]+|'([^']*)'?|\"([^\"]*)\"?|([^ \t'\"][^ \t]*)")
_OPENS = re.compile(r"open\(|read_text\(|\.read\(")
DEFAULT_LINES = 10


def words(command: str) -> list[str]:
    """Words of a command; a quote takes all up to its end."""
    return [next(g for g in m.groups() if g is not None) for m in _WORD.finditer(command) if m.lastindex]


def unwrapped(command: str) -> str:
    m = _WRAPPED.fullmatch(command.strip())
    return (m[1] if m[1] is not None else m[2]).strip() if m else command.strip()


def _operands(tokens: list[str]) -> list[str]:
    out, skip = [], False
    for token in tokens[1:]:
        if skip:
            skip = False
        elif token == "-n":
            skip = True
        elif not token.startswith("-"):
            out.append(token)
    return out


def _positive(text: str) -> int | None:
    return int(text) if text.isdigit() and int(text) >= 1 else None


def _lines_asked(tokens: list[str]) -> int | None:
    n, i = DEFAULT_LINES, 1
    while i < len(tokens) - 1:
        token = tokens[i]
        attached = re.fullmatch(r"(?:-n|--lines=|-)(\d+)", token)
        if token in ("-n", "--lines"):
            value, i = _positive(tokens[i + 1]), i + 1
        elif attached:
            value = _positive(attached[1])
        else:
            i += 1
            continue
        if value is None:
            return None
        n, i = value, i + 1
    return n


def file_read(command: str | None) -> dict | None:
    """{path, scope, start_line, end_line, tail_lines} of a command that prints one file or a part of it; else None."""
    if not command or not command.strip():
        return None
    inner = unwrapped(command)
    tokens = words(inner)
    if not inner or _UNSAFE.search(inner) or len(tokens) < 2:
        return None
    out = {"path": None, "scope": "region", "start_line": None, "end_line": None, "tail_lines": None}
    if tokens[0] == "sed":
        m = _RANGE.fullmatch(tokens[2]) if len(tokens) == 4 and tokens[1] == "-n" and not tokens[3].startswith("-") else None
        first = _positive(m[2]) if m else None
        last = (_positive(m[3]) if m[3] else first) if m else None
        return {**out, "path": tokens[3], "start_line": first, "end_line": last} if first and last and last >= first else None
    paths = _operands(tokens)
    if len(paths) != 1 or tokens[0] not in ("cat", "nl", "head", "tail"):
        return None
    if tokens[0] in ("cat", "nl"):
        return {**out, "path": paths[0], "scope": "file"}
    n = _lines_asked(tokens)
    if n is None:
        return None
    return {**out, "path": paths[0], **({"start_line": 1, "end_line": n} if tokens[0] == "head" else {"tail_lines": n})}


def _piped(command: str) -> list[str]:
    """Parts of a command between pipes outside quotes."""
    parts = re.findall(r"(?:'[^']*'?|\"[^\"]*\"?|[^|'\"])+", command)
    return [p.strip() for p in parts if p.strip()]


def dumped_paths(command: str | None) -> list[str]:
    """Paths of a command that prints two files or more; else none."""
    if not command or not command.strip():
        return []
    inner = unwrapped(command)
    parts = _piped(inner)
    if not parts:
        return []
    first = words(parts[0])
    found = _operands(first) if first[:1] in (["cat"], ["nl"]) and len(first) >= 3 else []
    if len(found) >= 2:
        return found
    script = words(inner)
    if script[:1] in (["python"], ["python3"]) and "-c" in script[1:-1] and _OPENS.search(script[script.index("-c") + 1]):
        found = [x for x in script[script.index("-c") + 2 :] if not x.startswith("-")]
        if len(found) >= 2:
            return found
    if len(parts) >= 2 and first[:1] == ["printf"] and len(first) >= 4:
        fed = words(parts[1])
        found = [x for x in first[2:] if not x.startswith("-")]
        if fed[:1] == ["xargs"] and {"cat", "nl"} & set(fed) and len(found) >= 2:
            return found
    return []


def mentioned(command: str | None, tracked: list[str]) -> list[str]:
    """Tracked paths that occur in a command, the longest first; what one has taken counts for no other."""
    rest, out = command or "", []
    for path in sorted({p for p in tracked if p}, key=lambda p: -len(p)):
        if path in rest:
            out.append(path)
            rest = rest.replace(path, "\0")
    return out


def observed_span(read: dict | None, file_text: str, seen: str) -> tuple[int, int] | None:
    """Lines that a head or tail read showed, where its output is just what the file has there."""
    if not read or read["scope"] != "region":
        return None
    lines, shown = (x.replace("\r\n", "\n").split("\n") for x in (file_text, seen))
    body = lines[:-1] if lines[-1] == "" else lines
    shown = shown[:-1] if shown[-1] == "" else shown
    tail = read["tail_lines"]
    asked = tail if tail else read["end_line"] if read["start_line"] == 1 else None
    if not shown or not asked or len(shown) != min(asked, len(body)):
        return None
    first = len(body) - len(shown) + 1 if tail else 1
    last = len(lines) if tail or len(shown) == len(body) else len(shown)
    return (first, last) if body[first - 1 : first - 1 + len(shown)] == shown else None
