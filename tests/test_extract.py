import pytest
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import extract, filters, graph, pyast, stats


def imports_of(files, raw):
    return [r["module"] for r in pyast.python_imports(pyast.parse_python(files({"m.py": raw}))).collect()]


@pytest.mark.parametrize("raw, modules", [
    ("import os\n", ["os"]), ("import numpy as np\n", ["numpy"]), ("import os.path\n", ["os.path"]), ("from a.b import c\n", ["a.b"]),
    ("from . import x\nfrom .y import z\n", []), ("import a, b\nfrom c import d\n", ["a", "b", "c"]), ("x = 1\n", []), ("def (:\n", []), ("", []),
    ("def f():\n    import deep\n", ["deep"]),
])
def test_imports(files, raw, modules):
    assert sorted(imports_of(files, raw)) == sorted(modules)


def test_python_class_and_method(files):
    nodes = pyast.python_nodes(pyast.parse_python(files({"mod.py": "class MyClass:\n    def my_method(self): pass\n"}))).collect()
    assert {n["kind"] for n in nodes} == {"module", "class", "function"}
    assert all(n["depth"] is not None and n["language"] == "python" and n["label"] for n in nodes)
    assert {n["line"] for n in nodes if n["kind"] == "function"} == {2}


def test_python_sub_symbols(files):
    raw = "from c import D\nclass Foo(D):\n    def bar(self): pass\nprint(x)\nq.w(1)\nfor i in z:\n    y = f'{i}'\n"
    parsed = pyast.parse_python(files({"a.py": raw}))
    nodes = pyast.python_nodes(parsed, 3)
    kinds = {r["legacy_id"]: r["kind"] for r in nodes.collect()}
    assert kinds["a.c.D"] == "import" and kinds["c.D"] == "symbol" and kinds["a.q.w"] == "call" and kinds["a."] == "call"
    assert kinds["a.ForLoop"] == "loop" and kinds["a.JoinedStr"] == "string" and kinds["a.Const: 1"] == "constant" and kinds["a.self"] == "argument"
    assert all(r["id"] == "a.py::" + r["legacy_id"] for r in nodes.collect())
    edges = {(r["src"].removeprefix("a.py::"), r["dst"].removeprefix("a.py::"), r["kind"]) for r in pyast.python_edges(parsed, nodes).collect()}
    assert {("a.a", "a.c.D", "imports"), ("a.Foo", "c.D", "contains"), ("a.Foo", "a.bar", "contains"), ("a.ForLoop", "a.i", "contains"),
            ("a.q.w", "a.Const: 1", "contains"), ("a.a", "a.D", "imports")} <= edges


def test_edges_of_large_parses_are_not_broadcast(spark, files):
    raw = "from c import D\nclass Foo(D):\n    def bar(self): pass\nprint(x)\nfor i in z:\n    y = f'{i}'\n"
    parsed = pyast.parse_python(files({"a.py": raw, "d/b.py": raw + "q.w(1)\n", "e.py": ""}))
    for depth in (1, 2, 3):
        nodes = pyast.python_nodes(parsed, depth)
        by_join, by_row = pyast.python_edges(parsed, nodes), pyast.python_edges_to(parsed, depth)
        assert sorted(by_join.collect()) == sorted(by_row.collect()) and (depth == 1 or by_row.count())
        roots = graph.attach_roots(nodes, by_row)
        below = {(r["file_id"], r["dst"]) for r in by_row.collect()}
        assert {(r["src"], r["dst"]) for r in roots.collect()} == {(r["file_id"], r["id"]) for r in nodes.collect()} - below
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (by_join, by_row, roots)]
        assert "BroadcastHashJoin" not in "".join(plans) and "SortMergeJoin" in plans[0] and "MergeJoin" not in plans[1] + plans[2]


def test_parse_depth_limits_rows_and_pieces_lose_none(files, monkeypatch):
    tree = {f"f{i}.py": "import os\ndef g(x):\n    print(x)\n" for i in range(30)}
    deep, flat = pyast.parse_python(files(tree)), pyast.parse_python(files(tree), 2)
    shown = lambda p: sorted(map(str, pyast.python_nodes(p).collect()))
    assert shown(deep) == shown(flat) and flat.count() < deep.count()
    monkeypatch.setattr(pyast, "PIECE_ROWS", 2)
    one = list(pyast._parser(3)(iter([files(tree).selectExpr("path AS file_id", "stem", "raw").toPandas()])))
    assert sum(map(len, one)) == deep.count() and max(map(len, one)) <= 2


def test_broken_python_is_rejected_not_lost(files):
    parsed = pyast.parse_python(files({"bad.py": "def (:\n", "ok.py": "x = 1\n"}))
    assert [r["file_id"] for r in pyast.python_rejects(parsed).collect()] == ["file::bad.py"]
    assert {r["file_id"] for r in pyast.python_nodes(parsed).collect()} == {"file::ok.py"}


def symbols(files, name, raw, **kw):
    return [(r["kind"], r["label"], r["line"]) for r in extract.extract_symbols(files({name: raw}), **kw).orderBy("line").collect()]


@pytest.mark.parametrize("name, raw, expected", [
    ("a.js", "export async function* gen(a) {\nconst f = async (x) => 1\n// function no() {\n", [("function", "gen", 1), ("function", "f", 2)]),
    ("a.ts", "type A<T> = T\n@Comp({})\nconst enum E {", [("type", "A", 1), ("decorator", "Comp", 2), ("enum", "E", 3)]),
    ("a.go", "func (r *R) Do(x int) {\ntype S struct {\ntype A int", [("function", "Do", 1), ("struct", "S", 2), ("type", "A", 3)]),
    ("A.S", "_start:\n.text\n", [("label", "_start", 1), ("section", "text", 2)]),
    ("q.sql", "create table if not exists t1 (a int)\n-- create view no", [("table", "t1", 1)]),
    ("x.html", '<p>\r\n  <div class="c" id="main">\r\n<my-tag-x a>', [("anchor", "main", 2), ("component", "my-tag-x", 3)]),
    ("c.rs", "impl Foo for Bar {\nmacro_rules! m {", [("impl", "Bar", 1), ("macro", "m", 2)]),
    ("é.rb", "def größe\n", [("function", "größe", 1)]),
])
def test_symbols(files, name, raw, expected):
    assert symbols(files, name, raw) == expected


def test_markdown_headings_need_own_comment_openers(files):
    assert symbols(files, "r.md", "# Title\n") == []
    assert symbols(files, "r.md", "# Title\n", legacy_comments=False) == [("heading", "Title", 1)]


def test_lines_as_python_splits_them(spark):
    samples = ["a\nb", "a\n", "\n", "a\r\nb\rc\n", "x\u2028y\x0bz", "  \t a \u00a0\n\n b", "a\n\n", "a\r\n\r\n"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, raw string")
    got = {}
    for r in extract.explode_lines(df).orderBy("i", "line").collect():
        got.setdefault(r["i"], []).append(r["text"])
    assert got == {i: [line.strip() for line in s.splitlines()] for i, s in enumerate(samples)}


def test_every_registered_extension_has_a_language(spark):
    known = filters.extension_map()
    assert known[".py"] == "python" and known[".h"] == "c" and known[".scss"] == "css"
    df = spark.createDataFrame([(".PY",), (".xyz",)], "ext string").select(filters.ext_to_language(F.col("ext")).alias("l"))
    assert [r["l"] for r in df.collect()] == ["python", "unknown"]


def test_register_language_last_wins(files):
    before = extract.REGISTRY.by_extension()
    try:
        extract.register_language("basic", [".bas"], [("sub", r"^SUB\s+(\w+)")])
        assert symbols(files, "a.bas", "SUB Go\n") == [("sub", "Go", 1)]
        extract.register_language("basic2", [".bas"], [("routine", r"^SUB\s+(\w+)")])
        assert symbols(files, "a.bas", "SUB Go\n") == [("routine", "Go", 1)]
    finally:
        extract.REGISTRY._languages = {k: v for k, v in extract.REGISTRY._languages.items() if not k.startswith("basic")}
        extract.REGISTRY._by_extension = before


def test_table_function_agrees_with_columns(spark, files):
    tree = {"a.go": "func F(a int) {\n\n// x\ntype S struct {", "b.rb": "class C\n  def d\n", "c.txt": "class No", "d.rs": "\u00a0fn ünï(\u2028enum E\x0bstruct S\r\n",
            "e.html": "<a id=\"it's\">\r<x-y-z>\n\n", "f.sql": "create table t_1 (\n--create view v\n\u0001create view w\ncreate view x", "g.SH": "f() {\nfunction g {", "h.go": None}
    extract.register_sql_function(spark)
    files({k: v or "" for k, v in tree.items()}).createOrReplaceTempView("udtf_files")
    tree = {k: v or "" for k, v in tree.items()}
    by_sql = spark.sql("SELECT f.path, s.kind, s.label, s.line FROM udtf_files f, LATERAL extract_symbols(f.ext, f.raw) s")
    plan = by_sql._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDTF" not in plan and by_sql.count() >= 10
    by_columns = extract.extract_symbols(files(tree)).select(F.substring("file_id", 7, 99).alias("path"), "kind", "label", "line")
    assert sorted(by_sql.collect()) == sorted(by_columns.collect())


def test_table_function_is_a_generator_not_a_join(spark, files):
    extract.register_sql_function(spark)
    files({"a.go": "func F(a int) {\n"}).createOrReplaceTempView("udtf_one_file")
    found = spark.sql("SELECT f.path, s.kind FROM udtf_one_file f, LATERAL extract_symbols(f.ext, f.raw) s")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashJoin" not in plan and "MergeJoin" not in plan and "NestedLoop" not in plan and "Exchange" not in plan
    assert [tuple(r) for r in found.collect()] == [("a.go", "function")]


def test_human_size(spark):
    sizes = [0, 1023, 1024, 1536, 1280, 3 * 1024 ** 2, 5 * 1024 ** 4]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "n long").select(text.human_size(F.col("n"))).collect()]

    def human(n):
        for unit in ("B", "KB", "MB", "GB"):
            if n < 1024:
                return f"{n:.1f} {unit}"
            n /= 1024
        return f"{n:.1f} TB"

    assert got == [human(s) for s in sizes]


def test_diagnostic_classes(spark):
    messages = ["'x.h' file not found", "unknown type name 'u8'", "expected ';'"]
    df = spark.createDataFrame([(m, "f") for m in messages], "message string, file string")
    assert stats.diagnostics_summary(df).first().asDict() == {"missing_header": 1, "unknown_type": 1, "other": 1, "files_with_warnings": 1}


def test_lines_are_matched_where_they_lie(files):
    """Rows come out for symbols only, not for every line."""
    plan = extract.extract_symbols(files({"a.js": "// no\nclass A {\n\n}\r\nclass B"}))
    assert [(r["label"], r["line"]) for r in plan.orderBy("line").collect()] == [("A", 2), ("B", 5)]
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Generate ") == 1 and "posexplode" not in text


def test_kinds_are_counted_once(spark):
    made = spark.sparkContext.accumulator(0)

    def kinds(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf.assign(kind="k" + (pdf["id"] % 12).astype("str"))[["kind"]]

    rows = stats.type_breakdown(spark.range(24).mapInPandas(kinds, "kind string")).collect()
    assert len(rows) == 10 and {(r["n"], r["more_kinds"]) for r in rows} == {(2, 2)} and made.value == 24
