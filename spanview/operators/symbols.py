"""Symbols of source files: functions, methods and classes with their lines and bytes.

Python is parsed by its own parser. Languages with braces are scanned: comments and strings
are blanked, headers found by pattern, and bodies by their braces. Names that occur more
than once in a file are dropped, as nothing tells them apart.
"""

from __future__ import annotations

import ast
import hashlib
import re
import signal
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_NAME = r"[A-Za-z_$][\w$]*"
_SCRIPT = [
    ("class", re.compile(rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>{_NAME})", re.M)),
    ("function", re.compile(rf"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^>]*>)?\(", re.M)),
    ("function", re.compile(rf"^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]+)?=>)", re.M)),
    ("method", re.compile(rf"^[ \t]+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b|else\b|new\b)(?P<name>{_NAME})\s*\([^;{{}}]*\)\s*(?::[^{{\n]+)?{{", re.M)),
]
_GO = [
    ("method", re.compile(rf"^func\s+\(\s*(?:{_NAME}\s+)?\*?(?P<owner>{_NAME})[^)]*\)\s*(?P<name>{_NAME})\s*[\[(]", re.M)),
    ("function", re.compile(rf"^func\s+(?P<name>{_NAME})\s*[\[(]", re.M)),
    ("class", re.compile(rf"^type\s+(?P<name>{_NAME})\s+(?:struct|interface)\b", re.M)),
]
_RUST = [
    ("impl", re.compile(rf"^[ \t]*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>{_NAME})", re.M)),
    ("class", re.compile(rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(?P<name>{_NAME})", re.M)),
    ("function", re.compile(rf"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(?P<name>{_NAME})\s*[<(]", re.M)),
]
LANGUAGES = {".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust"}
_HEADERS = {"javascript": _SCRIPT, "typescript": _SCRIPT, "go": _GO, "rust": _RUST}
_BLANKED = re.compile(r"//[^\n]*|/\*.*?(?:\*/|$)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def language(path: str) -> str | None:
    base = path.rsplit("/", 1)[-1].lower()
    return LANGUAGES.get(base[base.rfind(".") :]) if "." in base else None


def blanked(source: str) -> str:
    """source with comments and strings as spaces; line ends and offsets stay."""
    return _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _unit(path: str, lang: str, source: str, kind: str, name: str, owners: list[str], first: int, last: int) -> dict:
    lines = source.split("\n")
    start = sum(len(x.encode()) + 1 for x in lines[: first - 1])
    body = "\n".join(lines[first - 1 : last])
    return {
        "path": path, "language": lang, "kind": kind, "selector": f"{path}::{name}", "qualified_selector": "::".join([path, *owners, name]), "start_line": first, "end_line": last,
        "byte_start": start, "byte_end": start + len(body.encode()), "sha256": hashlib.sha256(body.encode()).hexdigest(),
    }


def _python(path: str, source: str) -> tuple[list[dict], str | None]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [], "parse-broken"
    out: list[dict] = []
    stack: list[tuple[ast.AST, list[str], bool]] = [(tree, [], False)]
    while stack:
        node, owners, in_class = stack.pop()
        blocks: Counter = Counter()
        inner = []
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "method" if in_class else "function"
                if not (kind == "method" and child.name == "__init__"):
                    out.append(_unit(path, "python", source, kind, child.name, owners, child.lineno, child.end_lineno))
                inner.append((child, [*owners, child.name], is_class))
            elif isinstance(child, (ast.If, ast.For, ast.While, ast.With, ast.Try)):
                name = type(child).__name__.lower()
                blocks[name] += 1
                inner.append((child, [*owners, name if blocks[name] == 1 else f"{name}@{blocks[name]}"], in_class))
        stack.extend(inner)
    return out, None


def _braced(path: str, lang: str, source: str) -> tuple[list[dict], str | None]:
    plain = blanked(source)
    close, opens = {}, []
    for i, c in enumerate(plain):
        if c == "{":
            opens.append(i)
        elif c == "}":
            if not opens:
                return [], "parse-broken"
            close[opens.pop()] = i
    if opens:
        return [], "parse-broken"
    spans = []
    for kind, pattern in _HEADERS[lang]:
        for m in pattern.finditer(plain):
            brace = plain.find("{", m.start("name"))
            stop = plain.find(";", m.start("name"))
            if brace < 0 or brace not in close or (0 <= stop < brace and lang != "rust"):
                continue
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            spans.append((first, close[brace], kind, m["name"], m.groupdict().get("owner")))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[dict] = []
    open_: list[tuple] = []
    for first, last, kind, name, owner in spans:
        while open_ and open_[-1][1] < first:
            open_.pop()
        owners = [owner] if owner else [x[2] for x in open_]
        in_class = bool(open_) and open_[-1][3] in ("class", "impl")
        kind = "method" if kind == "function" and in_class else kind
        if not (kind == "method" and not in_class and not owner) and kind != "impl" and name != "constructor":
            out.append(_unit(path, lang, source, kind, name, owners, plain.count("\n", 0, first) + 1, plain.count("\n", 0, last) + 1))
        open_.append((first, last, name, kind))
    return out, None


def enumerate_symbols(path: str, source: str) -> dict:
    """{"units", "error"}: units with a qualified selector that occurs once; else why there are none."""
    lang = language(path)
    if lang is None:
        return {"units": [], "error": "parser-not-implemented"}
    source = source.replace("\r\n", "\n")
    units, error = _python(path, source) if lang == "python" else _braced(path, lang, source)
    if error:
        return {"units": [], "error": error}
    counts = Counter(u["qualified_selector"] for u in units)
    unique = sorted((u for u in units if counts[u["qualified_selector"]] == 1), key=lambda u: (u["byte_start"], -u["byte_end"]))
    return {"units": unique, "error": None if unique else "ambiguous" if units else "unresolved"}


_INDENTED = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")


def indented_symbols(path: str, source: str) -> dict:
    """{"units", "error"} of Python by indentation alone: a body goes on to the last line that stands further in than its header.

    An enumerator of its own beside the parser, against which a resolved text is held. Text
    inside strings of several lines is taken for code.
    """
    lines = source.replace("\r\n", "\n").split("\n")
    depth = [len(x) - len(x.lstrip(" \t")) if x.strip() and not x.lstrip().startswith("#") else None for x in lines]
    units, open_ = [], []
    for i, line in enumerate(lines):
        if depth[i] is None:
            continue
        while open_ and open_[-1][0] >= depth[i]:
            open_.pop()
        m = _INDENTED.match(line)
        if m:
            last = i
            for j in range(i + 1, len(lines)):
                if depth[j] is not None and depth[j] <= depth[i]:
                    break
                if depth[j] is not None:
                    last = j
            in_class = bool(open_) and open_[-1][2] == "class"
            kind = "class" if m[2] == "class" else "method" if in_class else "function"
            if not (kind == "method" and m[3] == "__init__"):
                units.append(_unit(path, "python", "\n".join(lines), kind, m[3], [x[1] for x in open_], i + 1, last + 1))
            open_.append((depth[i], m[3], m[2]))
    counts = Counter(u["qualified_selector"] for u in units)
    unique = [u for u in units if counts[u["qualified_selector"]] == 1]
    return {"units": unique, "error": None if unique else "ambiguous" if units else "unresolved"}


def limited(parse, seconds: float = 10.0, most: int = 16 * 1024 * 1024):
    """parse(path, text) that raises where it takes longer or gives more than it may. Python workers are processes of their own, and parse in their main thread."""

    def stop(*_) -> None:
        raise TimeoutError("parser took too long")

    def run(path: str, text: str) -> dict:
        before = signal.signal(signal.SIGALRM, stop)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            out = parse(path, text)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
        if sum(len(str(v)) for u in out["units"] for v in u.values()) > most:
            raise ValueError("parser gave too much")
        return out

    return run


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of files (path, content), one row each; a file without any gives one row with its error."""
    names = ["path", "language", "kind", "selector", "qualified_selector", "start_line", "end_line", "byte_start", "byte_end", "sha256", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = limited(enumerate_symbols)
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    out = parse(path, content or "")
                except Exception:  # noqa: BLE001  any failure of the parser is the file's error
                    out = {"units": [], "error": "isolated-semantic-engine-error"}
                rows += [{**u, "error": None} for u in out["units"]] or [{"path": path, "language": language(path), "error": out["error"]}]
            yield pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("start_line", "end_line", "byte_start", "byte_end")})

    return files.select("path", "content").mapInPandas(run, "path string, language string, kind string, selector string, qualified_selector string, start_line bigint, end_line bigint, byte_start bigint, byte_end bigint, sha256 string, error string")


def resolved_symbols(units: DataFrame, found: DataFrame) -> DataFrame:
    """units (unit_id, path, selector) with the one symbol that their selector names: (unit_id, state, method, start_line, end_line)."""
    from pyspark.sql import functions as F

    names = found.filter("error is null").select("path", F.explode(F.array_distinct(F.array("selector", "qualified_selector"))).alias("selector"), F.struct("start_line", "end_line").alias("at"))
    hits = units.join(names, ["path", "selector"], "left").groupBy("unit_id").agg(F.count("at").alias("n"), F.first("at", ignorenulls=True).alias("at"))
    method = F.when(F.col("n") == 1, "isolated-semantic-engine").when(F.col("n") > 1, "isolated-semantic-engine-ambiguous").otherwise("isolated-semantic-engine-unresolved")
    ok = F.col("n") == 1
    return hits.select("unit_id", F.when(ok, "resolved").otherwise("unresolved").alias("state"), method.alias("method"), F.when(ok, F.col("at.start_line")).alias("start_line"), F.when(ok, F.col("at.end_line")).alias("end_line"))
