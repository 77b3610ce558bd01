"""Batches of conditional writes, checked against a sequential model."""

import hashlib
import random
from datetime import datetime

import pytest

from conftest import values
from leafmill.operators import mutate as M
from leafmill.operators import tree as T


def digest(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def requests(spark, *rows):
    full = [
        (seq, r["op"], r["path"], r.get("content"), r.get("old"), r.get("new"), r.get("every"), r.get("expected"), datetime(2025, 1, 1))
        for seq, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, M.REQUEST_SCHEMA)


def put(path, content="", expected=None):
    return {"op": "put", "path": path, "content": content, "expected": expected}


def edit(path, old, new, every=False, expected=None):
    return {"op": "edit", "path": path, "old": old, "new": new, "every": every, "expected": expected}


def delete(path, expected=None):
    return {"op": "delete", "path": path, "expected": expected}


def model(contents, rows):
    """One request after the other on a dictionary."""
    state, revision, out = dict(contents), {p: 1 for p in contents}, []
    for r in rows:
        p, expected = r["path"], r.get("expected") or ""
        present = p in state
        below = [q for q in state if q.startswith(p + "/")]
        conflict = bool(expected) and (present if expected == "*" else not present or digest(state[p]) != expected)
        code = "OK"
        if r["op"] == "put":
            if below:
                code = "IS_DIR"
            elif any(p.startswith(q + "/") for q in state):
                code = "NOT_DIR"
            elif conflict:
                code = "CONFLICT"
            else:
                state[p], revision[p] = r["content"], revision.get(p, 0) + 1
        elif r["op"] == "edit":
            if not r["old"]:
                code = "EMPTY_OLD"
            elif not present:
                code = "NOT_FOUND"
            elif conflict:
                code = "CONFLICT"
            elif r["old"] not in state[p]:
                code = "OLD_NOT_FOUND"
            else:
                state[p] = state[p].replace(r["old"], r["new"], -1 if r["every"] else 1)
                revision[p] += 1
        else:
            if expected and not present:
                code = "NOT_FOUND"
            elif expected and digest(state[p]) != expected:
                code = "CONFLICT"
            elif not present and not below:
                code = "NOT_FOUND"
            else:
                for q in below + ([p] if present else []):
                    del state[q], revision[q]
        out.append(code)
    return state, revision, out


def check(spark, make_files, contents, rows):
    files, outcomes = M.apply(make_files(contents), requests(spark, *rows))
    state, revision, codes = model(contents, rows)
    assert [c for _, c in sorted(values(outcomes, "seq", "outcome"))] == codes
    got = {r.path: r for r in files.collect()}
    assert {p: r.content for p, r in got.items()} == state
    assert {p: r.revision for p, r in got.items()} == revision
    assert all(r.content_hash == digest(r.content) and r.size == len(r.content.encode()) for r in got.values())
    return files


def test_one_request_per_path(spark, make_files):
    contents = {"/s/cas.md": "before", "/s/edit.md": "a b a", "/s/all.md": "a b a", "/p/pay%/g.md": "x", "/p/payment/g.md": "y", "/old.md": "same"}
    rows = [put("/s/cas.md", "bad", "*"), put("/missing.md", "x", digest("q")), put("/new/deep/file.md", "new", "*"),
            edit("/s/edit.md", "a", "é"), edit("/s/all.md", "a", "c", True, digest("a b a")), edit("/no.md", "a", "b"),
            edit("/x.md", "", "b"), delete("/p/pay%"), delete("/nothing"), put("/s", "bad"), put("/p/payment/g.md/child", "bad"), put("/old.md", "same")]
    files = check(spark, make_files, contents, rows)
    tree = values(T.nodes(files).filter("kind = 'dir'"), "path")
    assert "/p/pay%" not in tree and "/new/deep" in tree


def test_static_rejects(spark, make_files):
    rows = [put("http://x", ""), put("/", ""), delete("/"), put("/a/.abstract.md", "x"), edit("/", "a", "b"), {"op": "move", "path": "/a"}]
    _, outcomes = M.apply(make_files({"/a.md": "1"}), requests(spark, *rows))
    assert [c for _, c in sorted(values(outcomes, "seq", "outcome"))] == [
        "INVALID_PARAM", "IS_DIR", "CANNOT_DELETE_ROOT", "INVALID_PARAM", "IS_DIR", "INVALID_PARAM"]


def test_headers_are_checked(spark, make_files):
    bad = "---\ntitle: 1\n---\n"
    rows = [put("/new.md", bad), put("/new.txt", bad), edit("/a.md", "x", "1"), put("/c.md", bad), put("/c.md", "fine", "*")]
    files, outcomes = M.apply(make_files({"/a.md": "---\ntitle: x\n---\n"}), requests(spark, *rows))
    assert [c for _, c in sorted(values(outcomes, "seq", "outcome"))] == ["INVALID_PARAM", "OK", "INVALID_PARAM", "INVALID_PARAM", "OK"]
    assert dict(values(files, "path", "content")) == {"/a.md": "---\ntitle: x\n---\n", "/new.txt": bad, "/c.md": "fine"}


def test_one_of_two_equal_conditions_wins(spark, make_files):
    check(spark, make_files, {"/r.md": "original"}, [put("/r.md", "one", digest("original")), put("/r.md", "two", digest("original"))])


def test_chains_on_one_path(spark, make_files):
    check(spark, make_files, {"/a": "1", "/d/x": "x"}, [
        put("/a", "2"), put("/a", "3"), edit("/a", "3", "4"), delete("/a", digest("4")), edit("/a", "4", "5"),
        put("/a", "6", "*"), put("/n", "1"), put("/n", "2"), put("/n", "2"), delete("/d"), put("/d", "file"), delete("/d/x")])


def test_barriers_between_related_paths(spark, make_files):
    check(spark, make_files, {"/d/a": "1", "/d/b": "2", "/e": "3"}, [
        put("/d/c", "3"), delete("/d"), put("/d", "now a file"), put("/d/c", "blocked"), delete("/d"), put("/d/c", "again"),
        put("/e/x", "blocked"), delete("/e"), put("/e/x", "ok"), put("/e", "is dir"), put("/ee", "unrelated")])


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, make_files, seed):
    chance = random.Random(seed)
    paths = ["/a", "/b/c", "/b/d", "/b", "/e/f/g", "/h"]
    contents = {"/b/c": "one two", "/e/f/g": "two", "/h": "three"}
    texts = ["one", "two", "one two one", "three"]
    rows = []
    for _ in range(12):
        path = chance.choice(paths)
        expected = chance.choice([None, None, "*", digest(chance.choice(texts))])
        rows.append(chance.choice([put(path, chance.choice(texts), expected), edit(path, "o", "0", chance.random() < 0.5), delete(path)]))
    check(spark, make_files, contents, rows)


def test_changed_paths(spark, make_files):
    files = make_files({"/same": "1", "/new": "1", "/gone/x": "1"})
    changes = M.plan_changes(files, requests(spark, put("/same", "1"), put("/new", "2"), delete("/gone")))
    assert sorted(values(M.changed_paths(files, changes))) == [("/gone", True), ("/new", False)]
