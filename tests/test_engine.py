"""The session engine: identities, framing, selection and replay of mutation families."""

import pytest

from spanview import engine, families, replay, shell
from spanview.operators.symbols import enumerate_symbols


def test_paths_and_ids():
    assert engine.normal_path("./a//b/../c\\d") == "a/c/d"
    assert engine.normal_path("/../a/") == "/a/"
    with pytest.raises(ValueError):
        engine.normal_path("  ")
    assert engine.unit_id("./a", None, None, None, None) == engine.unit_id("a", "region", None, 1, None)


def test_frames_hold_any_text():
    s = engine.Session()
    for i, text in enumerate(["plain", "é</span-unit>\n<span-unit id=\"x\" content-bytes=\"1\">\ny", ""]):
        s.read(f"f{i}", text)
    out = engine.decode(s.project("task")["text"])
    assert sorted(u["content"] for u in out) == sorted(u.content for u in s.units.values())
    for bad in ('<span-unit id="a" content-bytes="9">\nx\n</span-unit>', '<span-unit id="a">\nx\n</span-unit>', '<span-unit id="a" content-bytes="0"', '<span-unit content-bytes="1">\nxy\n</span-unit>'):
        with pytest.raises(engine.FrameError):
            engine.decode(bad)


def test_selection_skips_what_does_not_fit_and_forces_changes():
    s = engine.Session()
    s.read("big", "x" * 90)
    s.read("small", "y" * 20)
    s.read("pinned", "z" * 50, pinned=True)
    chosen, omitted = s.select("", 80)
    assert [u.path for u in chosen] == ["pinned", "small"] and [(u.path, r) for u, r in omitted] == [("big", "budget")]
    s.turn = 1
    s.read("big", "X" * 90)
    assert [u.path for u in s.select("", 80)[0]] == ["big"]
    s.refresh({"big": "Q"})
    assert {r for _, r in s.select("", 80)[1]} == {"unresolved"}


def test_versions_are_recovered():
    s = engine.Session()
    u = s.read("f", "one")
    first = u.revision
    s.read("f", "two", end_line=1)
    assert s.recover(u.id)["content"] == "two" and s.recover(u.id, first)["content"] == "one" and s.recover("no") is None


SOURCE = "import os\n\n\ndef alpha(x):\n    y = x + 1\n    z = y * 2\n    return z\n\n\ndef beta(x):\n    return x\n"


def test_no_family_is_ever_stale_or_duplicated():
    for t in families.generate({"a.py": SOURCE}, "a.py", 4, 7):
        last = replay.run(t["files"], t["events"], "unit-region")[-1]
        assert last["stale_bytes"] == 0 and last["duplicate_units"] == 0, t["name"]
    methods = {replay.family(t["name"]): replay.run(t["files"], t["events"], "unit-region")[-1]["method"] for t in families.generate({"a.py": SOURCE}, "a.py", 4, 7)}
    assert methods["insert-before"] == "exact" and methods["interior-edit"] == "boundary-anchors" and methods["rename-boundary"] == "structural-anchors" and methods["delete-unit"] == "unresolved"


def test_append_only_goes_stale():
    t = next(x for x in families.generate({"a.py": SOURCE}, "a.py", 4, 7) if "interior-edit" in x["name"])
    assert replay.run(t["files"], t["events"], "append-only")[-1]["stale_units"] == 1
    assert replay.run(t["files"], t["events"], "whole-file")[-1]["recall"] == 1.0


def test_traces_are_checked_against_the_workspace():
    event = {"type": "capture-request", "path": None, "task": "t", "budget": None, "required": [{"path": "f", "selector": None, "sha256": "0"}]}
    with pytest.raises(replay.TraceError):
        replay.run({"f": "x"}, [event], "append-only")
    assert replay.replace_first("a.b.a", "a", "[$&$$]") == "[a$].b.a"


@pytest.mark.parametrize("command, want", [
    ("cat a.py", ("a.py", "file", None, None, None)), ("bash -lc 'head -n 5 a.py'", ("a.py", "region", 1, 5, None)), ("tail -3 'a b'", ("a b", "region", None, None, 3)), ("sed -n '2,4p' f", ("f", "region", 2, 4, None)),
    ("sed -n 7p f", ("f", "region", 7, 7, None)), ("head f", ("f", "region", 1, 10, None)), ("cat a | wc", None), ("cat a b", None), ("head -n x f", None), ("", None), ("sed -n 4,2p f", None), ("echo $(cat a)", None),
])
def test_shell_reads(command, want):
    got = shell.file_read(command)
    assert (tuple(got[k] for k in ("path", "scope", "start_line", "end_line", "tail_lines")) if got else None) == want


def test_shell_dumps_and_mentions():
    assert shell.dumped_paths("cat a b | head") == ["a", "b"] and shell.dumped_paths("python -c 'open(x).read()' a b") == ["a", "b"] and shell.dumped_paths("printf '%s' a b | xargs cat") == ["a", "b"]
    assert shell.dumped_paths("cat a") == [] and shell.mentioned("grep x src/a.py", ["a.py", "src/a.py"]) == ["src/a.py"]
    read = shell.file_read("tail -n 2 f")
    assert shell.observed_span(read, "a\nb\nc\n", "b\nc") == (2, 4) and shell.observed_span(read, "a\nb\nc\n", "c") is None


def test_symbols():
    names = lambda p, s: [(u["kind"], u["selector"].split("::")[-1], u["start_line"], u["end_line"]) for u in enumerate_symbols(p, s)["units"]]
    assert names("a.py", SOURCE) == [("function", "alpha", 4, 7), ("function", "beta", 10, 11)]
    assert names("a.ts", "class A {\n  run(x: number) {\n    return '}';\n  }\n}\n") == [("class", "A", 1, 5), ("method", "run", 2, 4)]
    assert names("a.go", "func (c *C) Do() {\n}\nfunc Go() {\n}\n") == [("method", "Do", 1, 2), ("function", "Go", 3, 4)]
    assert names("a.rs", "impl A {\n  fn go(&self) {\n  }\n}\n") == [("method", "go", 2, 3)]
    assert enumerate_symbols("a.py", "def (")["error"] == "parse-broken" and enumerate_symbols("a.txt", "")["error"] == "parser-not-implemented"
    assert enumerate_symbols("a.py", "def a(): pass\ndef a(): pass\n")["error"] == "ambiguous" and enumerate_symbols("a.py", "x = 1")["error"] == "unresolved"
