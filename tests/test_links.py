"""Paths through links against a walk of one path at a time, and against the file system itself."""

import os
import random

import pytest

from spanview.operators import links as ln


def walk(path, links, limit=100_000):
    """(real, failure) by following one part after another."""
    if path is None:
        return None, "missing"
    if path.startswith("/"):
        return None, "escape"
    stack, rest, steps = [], path.split("/"), 0
    while rest:
        part, *rest = rest
        if part in ("", "."):
            continue
        if part == "..":
            if not stack:
                return None, "escape"
            stack.pop()
            continue
        at = "/".join([*stack, part])
        if at not in links:
            stack.append(part)
            continue
        steps += 1
        target = links[at]
        if steps > limit or len(rest) > 10_000:
            return None, "loop"
        if target is None:
            return None, "missing"
        if target.startswith("/"):
            return None, "escape"
        rest = target.split("/") + rest
    return "/".join(stack), None


def resolve(spark, paths, links, root=None):
    p = spark.createDataFrame([(x,) for x in paths], "path string")
    return {x.path: (x.real, x.failure) for x in ln.resolved(p, spark.createDataFrame(list(links.items()), "path string, target string"), root).collect()}


def test_random_trees(spark):
    r, everything, wants, want = random.Random(9), {}, [], {}
    for tree in range(25):
        dirs = [f"t{tree}"] + [f"t{tree}/{a}" for a in "ab"] + [f"t{tree}/a/c"]
        links = {}
        for _ in range(r.randrange(3, 9)):
            where = f"{r.choice(dirs)}/{r.choice('lmnop')}"
            up = "../" * r.randrange(4 if r.random() < 0.1 else where.count("/") + 1)
            links[where] = r.choice([up + r.choice(["a", "b", "a/c", "x.txt", "l", "m", "a/n", "b/o", ".", "a/../b", "l/../m"]), "/etc/x"] if r.random() < 0.2 else [up + r.choice(["a", "b/l", "a/c/m", "n/o", "p/../n", "x"])])
        everything |= links
        asked = [f"{r.choice(dirs)}/{r.choice(['l', 'm/n', 'n/../o', 'x', './/l/', 'p/l/m', '../../' * r.randrange(3) + 'q'])}" for _ in range(20)] + list(links)
        wants += asked
    want = {p: walk(p, everything) for p in wants}
    got = resolve(spark, wants, everything)
    kinds = {}
    for p in wants:
        kinds[want[p][1]] = kinds.get(want[p][1], 0) + 1
        if want[p][1] == "loop":
            assert got[p][1] in ("loop", "too-long"), p
        else:
            assert got[p] == want[p], p
    assert set(kinds) >= {None, "escape", "loop"} and kinds[None] > 100


def test_long_chains_circles_and_hot_links(spark):
    links = {f"c/{i}": f"{i + 1}" for i in range(3000)} | {f"r/{i}": f"{(i + 1) % 50}" for i in range(50)} | {"grow": "grow/x", "dir": "real/place", "two": "dir/../two-real"}
    paths = ["c/0", "c/2999", "r/7", "r/7/x", "grow", "two", *[f"dir/f{i}" for i in range(500)]]
    got = resolve(spark, paths, links)
    assert got["c/0"] == got["c/2999"] == ("c/3000", None) and got["r/7"] == got["r/7/x"] == (None, "loop") and got["two"] == ("real/two-real", None)
    assert got["grow"][1] in ("loop", "too-long") and all(got[f"dir/f{i}"] == (f"real/place/f{i}", None) for i in range(500))


def test_odd_rows(spark):
    got = resolve(spark, [None, "", ".", "a/" * 3000, "/root/w/a", "/other", "n", "twice"], {"n": None, "twice": "z", "/": "x"}, root="/root/w")
    assert got == {None: (None, "missing"), "": ("", None), ".": ("", None), "a/" * 3000: (None, "too-long"), "/root/w/a": ("a", None), "/other": (None, "escape"), "n": (None, "missing"), "twice": ("z", None)}
    twice = spark.createDataFrame([("t", "b"), ("t", "a"), ("./t/", "c")], "path string, target string")
    assert ln.resolved(spark.createDataFrame([("t",)], "path string"), twice).first().real == "a"
    assert ln.resolved(spark.createDataFrame([], "path string"), twice).count() == 0
    assert ln.resolved(spark.createDataFrame([("p",)], "path string"), twice.limit(0)).first().real == "p"


def test_as_the_file_system_says(spark, tmp_path):
    root = tmp_path / "root"
    for d in ("a/b", "c"):
        (root / d).mkdir(parents=True)
    (root / "a/b/f.txt").write_text("f")
    (tmp_path / "secret.txt").write_text("s")
    links = {"l": "a/b", "c/up": "../l/..", "c/f": "up/b/f.txt", "out": "../secret.txt", "c/deep": "../../secret.txt"}
    for path, target in links.items():
        os.symlink(target, root / path)
    paths = ["l/f.txt", "c/up/b/f.txt", "c/f", "out", "c/deep", "l/../b/f.txt"]
    got = resolve(spark, paths, links)
    for p in paths:
        real = os.path.realpath(root / p)
        inside = os.path.commonpath([real, root]) == str(root)
        assert got[p] == ((os.path.relpath(real, root), None) if inside else (None, "escape"))


@pytest.mark.parametrize("path,safe", [("a/../b", True), ("../a", False), ("a/../../b", False), ("/a", False), ("a/./b", True)])
def test_lexically(spark, path, safe):
    from pyspark.sql import functions as F

    assert spark.range(1).select(ln.lexically_safe(F.lit(path))).first()[0] is safe


def test_readers_refuse_or_contain_links(spark, tmp_path):
    from spanview.sources import readers

    root = tmp_path / "work space"
    (root / "a/b").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    (root / "a/b/f é.txt").write_text("f")
    (root / "g.txt").write_text("g")
    (tmp_path / "out/secret.txt").write_text("s")
    os.symlink("a/b/f é.txt", root / "inside")
    os.symlink("a", root / "folder")
    os.symlink("../out", root / "away")
    os.symlink("../out/secret.txt", root / "leak")
    os.symlink(root, tmp_path / "alias")
    plain = {"a/b/f é.txt", "g.txt"}

    def paths(df):
        return {x.path for x in df.collect()}

    assert paths(readers.workspace(spark, str(root))) == plain
    assert paths(readers.workspace(spark, str(tmp_path / "alias"))) == plain
    assert paths(readers.live_files(spark, str(root))) == plain | {"inside", "folder/b/f é.txt"}
    assert paths(readers.workspace(spark, str(root), links="follow")) == plain | {"inside", "folder/b/f é.txt", "away/secret.txt", "leak"}
    with pytest.raises(ValueError):
        readers.workspace(spark, str(root), links="maybe")
