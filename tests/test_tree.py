"""Node sets, listings, trees, find, glob, grep and line views."""

import pytest
from pyspark.sql import functions as F

from conftest import values
from leafmill.operators import grep as G
from leafmill.operators import tree as T
from leafmill.operators import view as V
from leafmill.operators.errors import InvalidParameter, NotDirectory, NotFound


@pytest.fixture(scope="module")
def basic(make_files):
    return make_files({
        "/docs/readme.md": "# Readme\nhello there\n", "/docs/go/main.go": "package main\n\ntype Adapter interface{}\n",
        "/api.md": "api docs\n"})


@pytest.fixture(scope="module")
def listing(spark):
    rows = [("/wheat.csv", 70, "2031-03-09"), ("/barley.csv", 20, "2031-03-11"), ("/oats.csv", 50, "2031-03-07"),
            ("/rye.csv", 90, "2031-03-10"), ("/mill/stone.txt", 5, "2031-02-01"), ("/mill/.dust", 1, ""), ("/.cellar", 8, "")]
    return T.nodes(spark.createDataFrame(rows, "path string, size long, mtime string")).cache()


def names(df):
    return values(df, "name")


def test_parents_are_derived(basic):
    tree = T.nodes(basic)
    assert names(T.ls(tree)) == ["api.md", "docs"] and names(T.ls(tree, "/docs")) == ["go", "readme.md"]
    assert sorted(values(tree.filter("kind = 'dir'"), "path", "parent")) == [("/", ""), ("/docs", "/"), ("/docs/go", "/docs")]
    assert sorted(values(T.adjacency(tree), "parent", "child"))[0] == ("/", "/api.md")


def test_listing_sorts(listing):
    by_name = ["barley.csv", "mill", "oats.csv", "rye.csv", "wheat.csv"]
    assert names(T.ls(listing)) == by_name
    assert names(T.ls(listing, reverse=True)) == by_name[::-1]
    assert names(T.ls(listing, sort="size")) == ["mill", "barley.csv", "oats.csv", "wheat.csv", "rye.csv"]
    assert names(T.ls(listing, sort="mtime", reverse=True)) == ["barley.csv", "rye.csv", "wheat.csv", "oats.csv", "mill"]
    assert names(T.ls(listing, show_all=True)) == [".cellar", *by_name]
    assert names(T.ls(listing, recursive=True)) == [*by_name[:4], "stone.txt", "wheat.csv"]
    assert ".dust" in names(T.ls(listing, recursive=True, show_all=True))
    assert names(T.ls(listing, limit=2, offset=1)) == by_name[1:3]
    assert T.total(T.ls_rows(listing)).first().total == 5
    for path, error in (("/nope", NotFound), ("/rye.csv", NotDirectory)):
        with pytest.raises(error):
            T.ls(listing, path)


def test_hidden_directories_are_pruned(make_files):
    tree = T.nodes(make_files({"/.git/config": "x", "/.git/.a/b": "y", "/a": "z"}))
    assert names(T.ls(tree, recursive=True)) == ["a"]
    assert names(T.ls(tree, "/.git")) == ["config"]


def test_ties_keep_their_order(spark):
    rows = [("/c", 5, ""), ("/a", 5, ""), ("/b", 5, ""), ("/d", 1, "")]
    tree = T.nodes(spark.createDataFrame(rows, "path string, size long, mtime string"))
    assert names(T.ls(tree, sort="size")) == ["d", "a", "b", "c"]
    assert names(T.ls(tree, sort="size", reverse=True)) == ["a", "b", "c", "d"]


def test_times_compare_as_instants(spark):
    rows = [("/a", 1, "2026-01-01T10:00:00+08:00"), ("/b", 1, "2026-01-01T03:00:00Z"), ("/c", 1, "2026-01-01T01:30:00Z")]
    tree = T.nodes(spark.createDataFrame(rows, "path string, size long, mtime string"))
    assert names(T.ls(tree, sort="mtime")) == ["c", "a", "b"]


def test_explicit_nodes(spark):
    rows = [(0, "/a/b.md", "file", 1, ""), (1, "/a/b.md", "file", 2, ""), (2, "x", "dir", 0, ""), (3, "/bad", "link", 0, "")]
    tree, rejected = T.nodes_from_rows(spark.createDataFrame(rows, "pos int, path string, kind string, size long, mtime string"))
    assert sorted(values(tree, "path", "kind", "size")) == [("/", "dir", 0), ("/a", "dir", 0), ("/a/b.md", "file", 2), ("/x", "dir", 0)]
    assert values(rejected, "path", "reject_reason") == [("/bad", "UNKNOWN_KIND")]


def test_duplicates(spark):
    df = spark.createDataFrame([("/a",), ("/a",), ("/b",), ("/b/c",)], "path string")
    assert sorted(values(T.duplicate_paths(df))) == [("/a", "DUPLICATE"), ("/b", "FILE_AND_DIR")]


def test_stat_and_directory_status(spark, basic):
    requests = spark.createDataFrame([("docs//go",), ("/api.md",), ("/no",)], "path string")
    tree = T.nodes(basic)
    got = {r.path: r for r in T.stat(tree, requests).collect()}
    assert (got["/docs/go"].kind, got["/docs/go"].size, got["/docs/go"].mtime, got["/docs/go"].content_hash) == ("dir", 0, None, None)
    assert got["/api.md"].content_hash.startswith("sha256:") and got["/no"].status == "NOT_FOUND"
    assert dict(values(T.directory_status(tree, requests.withColumn("path", T.P.clean("path"))))) == {
        "/docs/go": "OK", "/api.md": "NOT_DIR", "/no": "NOT_FOUND"}


@pytest.fixture(scope="module")
def shaped(spark):
    rows = [("/a.txt", 3, "2026-01-03"), ("/b.txt", 2, "2026-01-02"), ("/sub/c.txt", 1, "2026-01-01"),
            ("/sub/d.txt", 4, "2026-01-04"), ("/.hidden/x", 1, "")]
    return T.nodes(spark.createDataFrame(rows, "path string, size long, mtime string")).cache()


def text(df):
    return "".join(line + "\n" for line in values(df, "line"))


def test_tree_lines(shaped, basic):
    assert text(T.tree_lines(T.nodes(basic), depth=1)) == "/\n  api.md\n  docs/\n"
    assert text(T.tree_lines(shaped)) == "/\n"
    assert text(T.tree_lines(shaped, depth=2)) == "/\n  a.txt\n  b.txt\n  sub/\n    c.txt\n    d.txt\n"
    by_size = "/\n  sub/\n    c.txt\n    d.txt\n  b.txt\n  a.txt\n"
    assert text(T.tree_lines(shaped, depth=2, sort="size")) == by_size
    assert text(T.tree_lines(shaped, depth=2, sort="mtime")) == by_size
    assert text(T.tree_lines(shaped, depth=-1, dirs_only=True, show_all=True)) == "/\n  .hidden/\n  sub/\n"
    assert text(T.tree_lines(shaped, depth=1, dirs_first=True, show_size=True)) == "/\n  sub/\n  a.txt [3]\n  b.txt [2]\n"
    assert text(T.tree_lines(shaped, "/sub", depth=-1)) == "sub\n  c.txt\n  d.txt\n"
    assert text(T.tree_lines(shaped, "/sub", depth=-1, full_path=True)) == "/sub\n  /sub/c.txt\n  /sub/d.txt\n"


def test_tree_order_is_not_string_order(make_files):
    tree = T.nodes(make_files({"/a/b": "1", "/a-b": "2"}))
    assert text(T.tree_lines(tree, depth=-1)) == "/\n  a/\n    b\n  a-b\n"


def test_find(listing, basic):
    found = lambda **o: values(T.find(listing, **o), "path")
    assert values(T.find(T.nodes(basic), name="*.go"), "path") == ["/docs/go/main.go"]
    assert found(name="*.txt") == ["/a.txt", "/b.txt", "/c.txt", "/sub/d.txt", "/sub/e.txt"]
    assert found(name="*", kind="dir") == ["/sub"] and "/sub" in found(name="*", kind="any")
    assert found(name="*.txt", max_depth=1) == ["/a.txt", "/b.txt", "/c.txt"]
    assert found(name="*.txt", min_depth=2) == ["/sub/d.txt", "/sub/e.txt"]
    assert found(name="nothing", iname="A.TXT") == ["/a.txt"]
    assert found(name="*", show_all=True, path="/sub") == ["/sub/.secret", "/sub/d.txt", "/sub/e.txt"]
    assert found(name="") == [] and found(name="*.txt", limit=1, offset=1) == ["/b.txt"]
    with pytest.raises(InvalidParameter):
        T.find(listing, name="[")


def test_glob(basic):
    assert values(T.glob(basic, "**/*.md"), "path") == ["api.md", "docs/readme.md"]
    assert values(T.glob(basic, "/docs/**", limit=1, offset=1), "path") == ["docs/readme.md"]
    with pytest.raises(InvalidParameter):
        T.glob(basic, "")


@pytest.fixture(scope="module")
def lines(make_files):
    return make_files({
        "/hello.txt": "Hello World\nhello world\nHELLO\nworld hello-x", "/src/a.go": "func main() {\n}\n", "/src/b.go": "func helper() {}\n// main",
        "/docs/readme.md": "one\ntwo main\nthree\nfour main\nfive", "/.hidden/secret.txt": "hello hidden", "/w.txt": "remain main\nmain_x\nxmain"}).cache()


def found(df):
    return sorted(values(df, "path", "line"))


def test_grep(lines):
    assert found(G.grep(lines, "hello")) == [("/hello.txt", 2), ("/hello.txt", 4)]
    assert found(G.grep(lines, "hello", ignore_case=True)) == [("/hello.txt", i) for i in (1, 2, 3, 4)]
    assert ("/.hidden/secret.txt", 1) in found(G.grep(lines, "hello", show_all=True))
    assert found(G.grep(lines, "hello", path="/.hidden")) == [("/.hidden/secret.txt", 1)]
    assert found(G.grep(lines, "main", path="/src", invert=True)) == [("/src/a.go", 2), ("/src/a.go", 3), ("/src/b.go", 1)]
    assert found(G.grep(lines, "main", whole_word_only=True, include="w.txt")) == [("/w.txt", 1)]
    assert found(G.grep(lines, "HELLO", whole_line=True)) == [("/hello.txt", 3)]
    assert found(G.grep(lines, "hello", whole_line=True, ignore_case=True)) == [("/hello.txt", 3)]
    assert found(G.grep(lines, r"^func \w+\(", regex=True)) == [("/src/a.go", 1), ("/src/b.go", 1)]
    assert found(G.grep(lines, "hello|three", regex=True, whole_line=True)) == [("/docs/readme.md", 3), ("/hello.txt", 2)]
    assert found(G.grep(lines, "main", include="*.go", exclude="b*")) == [("/src/a.go", 1)]
    assert found(G.grep(lines, "main", include="[")) == []
    assert found(G.grep(lines, "main", include="*.go", exclude="[")) == [("/src/a.go", 1), ("/src/b.go", 2)]
    for path, error in (("/nope", NotFound), ("/w.txt", NotDirectory)):
        with pytest.raises(error):
            G.grep(lines, "x", path=path)
    with pytest.raises(InvalidParameter):
        G.grep(lines, r"(a)\1", regex=True)


def test_context(lines):
    rows = G.grep(lines, "main", path="/docs", before=2, after=1).orderBy("line").collect()
    assert [(r.line, r.before, r.after) for r in rows] == [(2, ["one"], ["three"]), (4, ["two main", "three"], ["five"])]


def test_grep_modes(lines):
    assert sorted(values(G.grep_files(lines, "main", path="/src"), "path")) == ["/src/a.go", "/src/b.go"]
    assert dict(values(G.grep_count(lines, "main"))) == {"/docs/readme.md": 2, "/src/a.go": 1, "/src/b.go": 1, "/w.txt": 3}
    assert values(G.grep_only(lines, "main", include="w.txt").orderBy("line"), "line", "text") == [(1, "main"), (1, "main"), (2, "main"), (3, "main")]
    assert values(G.grep_only(lines, "hello", ignore_case=True, include="hello.txt").orderBy("line"), "line") == [2, 4]
    assert values(G.grep_only(lines, "mai.", regex=True, include="b.go"), "text") == ["// main"]
    with pytest.raises(InvalidParameter):
        G.grep_only(lines, "")
    many = G.grep_many(lines, ["main", "func"], path="/src")
    assert sorted(values(many, "pattern", "path", "line")) == [("func", "/src/a.go", 1), ("func", "/src/b.go", 1), ("main", "/src/a.go", 1), ("main", "/src/b.go", 2)]
    checks = G.pattern_checks(lines, [("has", "^FUNC MAIN"), ("not", "absent")])
    assert sorted(values(checks, "label", "status")) == [("has", "PASS"), ("not", "FAIL")]


def test_cat_and_changes(spark, make_files):
    files = make_files({"/a.md": "---\ntitle: A\n---\nbody\n", "/bad.md": "---\ntitle: [\n---\nx", "/c.txt": "c"})
    rows = {r.path: r for r in V.cat(files, spark.createDataFrame([("a.md",), ("/bad.md",), ("/no",)], "path string")).collect()}
    assert (rows["/a.md"].body, rows["/a.md"].metadata) == ("body\n", '{"title":"A"}')
    assert rows["/bad.md"].body == rows["/bad.md"].content and rows["/bad.md"].metadata_error
    assert rows["/no"].status == "NOT_FOUND"
    hashes = dict(values(files, "path", "content_hash"))
    manifest = spark.createDataFrame([("/a.md", f'"x", "{hashes["/a.md"]}"'), ("/c.txt", "sha256:old"), ("/gone", "y"), ("/bad.md", "*")], "path string, if_none_match string")
    assert dict(values(V.changed(files, manifest), "path", "status")) == {"/c.txt": "CHANGED", "/gone": "NOT_FOUND"}


def test_line_views(make_files):
    files = make_files({"/a": "one\n\n \n\ntwo\n"})
    rows = values(V.line_table(files).orderBy("line"), "line", "nonblank", "text")
    assert rows == [(1, 1, "one"), (2, None, ""), (3, None, " "), (4, None, ""), (5, 2, "two")]
    assert values(V.line_table(files, squeeze=True).orderBy("line"), "line", "nonblank", "text") == [(1, 1, "one"), (2, None, ""), (3, 2, "two")]
    assert values(V.squeeze_blank_lines(files), "content") == ["one\n\ntwo"]
