import pytest
from pyspark.sql import functions as F

from graphloom.operators import filters, graph, stats
from graphloom.plans.code_graph import build_graph
from graphloom.schemas import C_DECLS
from graphloom.streaming.graph import CTables


def build(files, tree, depth=2):
    nodes, edges = build_graph(files(tree), "root", depth)
    return {r["id"]: r for r in nodes.collect()}, {(r["src"], r["dst"], r["kind"]) for r in edges.collect()}


def depends(edges):
    return {(s, d) for s, d, k in edges if k == "depends_on"}


def test_depth_cuts(files):
    tree = {"main.py": "x = 1\n", "pkg/utils.py": "def f(): pass\n"}
    nodes, edges = build(files, tree, 0)
    assert set(nodes) == {"dir::", "dir::pkg"} and edges == {("dir::", "dir::pkg", "contains")}
    nodes, _ = build(files, tree, 1)
    assert {n["depth"] for n in nodes.values()} == {0, 1} and nodes["file::pkg/utils.py"]["language"] == "python"


@pytest.mark.parametrize("raw, edges", [
    ("import b\n", {("file::a.py", "file::b.py")}), ("from b import x\n", {("file::a.py", "file::b.py")}),
    ("import os\n", {("file::a.py", "external::os")}), ("import os.path\nimport os\n", {("file::a.py", "external::os")}),
    ("import pkg.b\nimport b\n", {("file::a.py", "file::b.py")}), ("import a\n", {("file::a.py", "external::a")})])
def test_dependencies(files, raw, edges):
    nodes, found = build(files, {"a.py": raw, "b.py": "x = 1\n"})
    assert depends(found) == edges
    assert all(s in nodes and d in nodes for s, d, _ in found)


def test_no_dependencies_at_depth_one(files):
    assert not depends(build(files, {"a.py": "import b\n", "b.py": "x = 1\n"}, 1)[1])


def test_last_file_of_a_stem_wins(files):
    _, edges = build(files, {"a.py": "import u\n", "p/u.py": "x=1\n", "q/u.py": "x=1\n"})
    assert depends(edges) == {("file::a.py", "file::q/u.py")}


def test_files_of_one_name_keep_their_symbols(files):
    nodes, edges = build(files, {"a/index.js": "function f() {\n", "b/index.js": "function f() {\n", "a/m.py": "class C: pass\n", "b/m.py": "class C: pass\n"})
    found = [n for n in nodes if "index.js::function" in n or n.endswith("m.C")]
    assert len(found) == 4 and {n["file"] for k, n in nodes.items() if "index.js::function" in k} != {""}
    assert all(s in nodes and d in nodes for s, d, _ in edges)


def test_depth_three_is_reached(spark, files):
    from graphloom.plans.code_graph import build_graph

    tree = files({"a.py": "def g(x):\n    print(x)\n"})
    deep, shallow = ({r["depth"] for r in build_graph(tree, "r", d)[0].collect()} for d in (3, 2))
    assert deep == {0, 1, 2, 3} and shallow == {0, 1, 2}


def test_merge_does_not_depend_on_row_order(spark):
    rows = [("x", "f1", 1, "a"), ("x", "f0", 2, "b")]
    make = lambda r: spark.createDataFrame(r, "id string, file string, line int, label string").coalesce(1)
    got = [graph.merge_nodes(make(r)).first() for r in (rows, rows[::-1])]
    assert got[0] == got[1] and got[0]["file"] == "f0"
    edges = [("a", "b", "k", 1.0), ("a", "b", "k", 2.0)]
    kept = [graph.dedupe_edges(spark.createDataFrame(e, "src string, dst string, kind string, weight double")).collect() for e in (edges, edges[::-1])]
    assert kept[0] == kept[1] and kept[0][0]["weight"] == 2.0


def test_graph_is_whole(files):
    nodes, edges = build(files, {"a.py": "import b\nclass Foo:\n    def bar(self): pass\n", "b.py": "x = 1\n", "s/c.go": "func F(a int) {\n", "bad.py": "def (:\n"})
    assert all(s in nodes and d in nodes for s, d, _ in edges)
    assert ("file::a.py", "a.py::a.a", "contains") in edges and ("a.py::a.a", "a.py::a.Foo", "contains") in edges
    assert ("file::s/c.go", "go::s/c.go::function::F::1", "contains") in edges
    assert "file::bad.py" in nodes
    structure = [d for s, d, k in edges if k == "contains" and (s.startswith("dir::"))]
    assert len(structure) == len(set(structure))


@pytest.fixture(scope="module")
def decls(spark):
    rows = [
        ("f::func", "function", "func", "f", 10, ["static"], "int (int)", None, None, None, 1, True),
        ("f::S", "struct", "S", "f", 3, [], "struct S", None, 2, None, None, None),
        ("f::BigS", "struct", "BigS", "f", 4, [], "struct BigS", None, 20, None, None, None),
        ("f::x", "field", "x", "f", 4, [], "int", "f::S", None, None, None, None),
        ("f::p", "field", "p", "f", 5, [], "const struct BigS *", "f::S", None, None, None, None),
        ("f::T", "typedef", "T", "g", 6, [], "struct BigS", None, None, None, None, None),
        ("f::E", "enum", "E", "g", 7, [], "enum E", None, None, 1, None, None),
        ("f::c", "enum_constant", "c", "g", 8, [], "int", "f::E", None, None, None, None),
        ("f::u", "struct", "(unnamed at x)", "g", 9, [], "", None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, C_DECLS)


def pairs(df):
    return {(r["src"], r["dst"]) for r in df.collect()}


def test_c_nodes(decls):
    got = {r["id"]: r for r in graph.normalise_c_decls(decls).collect()}
    assert got["f::func"]["depth"] == 2 and got["f::x"]["depth"] == 3
    assert got["f::S"]["meta"]["sides"] == "3" and got["f::BigS"]["meta"]["sides"] == "10" and "sides" not in got["f::func"]["meta"]
    assert (got["f::S"]["shape"], got["f::S"]["color"], got["f::func"]["meta"]["is_definition"]) == ("ngon", "#4a9eff", "true")
    assert graph.normalise_c_decls(decls, 2).where("depth = 3").count() == 0


def test_c_edges(decls):
    assert pairs(graph.field_of(decls)) == {("f::S", "f::x"), ("f::S", "f::p"), ("f::E", "f::c")}
    assert pairs(graph.points_to(decls)) == {("f::p", "f::BigS")}
    assert pairs(graph.points_to(decls, substring=True)) == {("f::p", "f::BigS"), ("f::p", "f::S")}
    assert pairs(graph.aliases(decls)) == {("f::T", "f::BigS")}
    kinds = {r["kind"] for r in graph.map_edge_kinds(graph.union_edges(graph.field_of(decls), graph.points_to(decls))).collect()}
    assert kinds == {"field_of", "type_of"}
    assert {r["id"] for r in filters.drop_anonymous(decls).collect()} == {r["id"] for r in decls.collect()} - {"f::u"}
    assert {r["id"]: r["members"] for r in stats.member_counts(decls).collect()} == {"f::S": 2, "f::BigS": 0, "f::u": 0, "f::E": 1, "f::func": 0}


def test_c_symbols_reach_the_built_graph(spark, files, decls):
    tree = files({"a/f.c": "", "b/f.h": "", "b/g.c": "", "win32/g.c": "", "m.py": "import os\n"})
    sites = spark.createDataFrame([("f::func", "f::S"), ("f::func", "f::S"), ("f::func", "gone")], "src string, dst string")
    errors = spark.createDataFrame([("g",), ("g",)], "file string")
    nodes, edges = build_graph(tree, "r", 2, c=CTables(decls, sites, errors))
    got = {r["id"]: r for r in nodes.collect()}
    assert {"f::S", "f::func", "external::os", "file::win32/g.c"} <= set(got) and "f::x" not in got
    assert got["f::T"]["has_parse_warning"] and not got["f::S"]["has_parse_warning"] and not got["file::b/g.c"]["has_parse_warning"]
    found = {(r["src"], r["dst"], r["kind"]): r["weight"] for r in edges.collect()}
    # The header is the last file of its stem; the file for one platform owns nothing.
    assert found[("file::b/f.h", "f::S", "contains")] == 1.0 and ("file::a/f.c", "f::S", "contains") not in found
    assert ("file::b/g.c", "f::T", "contains") in found and ("file::win32/g.c", "f::T", "contains") not in found
    assert found[("f::func", "f::S", "calls")] == pytest.approx(1.3) and found[("f::T", "f::BigS", "aliases")] == 0.8
    assert not any("f::x" in k or "gone" in k for k in found)
    _, deep = build_graph(tree, "r", 3, c=CTables(decls, sites, errors))
    deep = {(r["src"], r["dst"], r["kind"]) for r in deep.collect()}
    assert ("f::S", "f::x", "field_of") in deep and ("f::p", "f::BigS", "type_of") in deep and ("file::b/f.h", "f::x", "contains") not in deep


def test_calls_need_known_ends(spark):
    sites = spark.createDataFrame([("a", "b")] * 3 + [("a", "a"), ("a", "gone")] + [("b", "a")] * 50, "src string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.calls(sites, nodes).collect()}
    assert got == {("a", "b"): pytest.approx(1.7), ("b", "a"): 3.0}


def test_parse_warnings(spark, decls):
    errors = spark.createDataFrame([("g", "boom"), ("g", "again")], "file string, message string")
    flagged = graph.flag_parse_warnings(decls, errors)
    assert flagged.count() == decls.count() and {r["file"] for r in flagged.where("has_parse_warning").collect()} == {"g"}
    assert stats.worst_files(errors).first()["errors"] == 2


def test_merge_overwrites_per_attribute(spark):
    a = spark.createDataFrame([("n", "old", "k"), ("m", "x", None)], "id string, label string, kind string")
    b = spark.createDataFrame([("n", "new", "extra")], "id string, label string, more string")
    got = {r["id"]: r for r in graph.merge_nodes(a, b).collect()}
    assert (got["n"]["label"], got["n"]["kind"], got["n"]["more"]) == ("new", "k", "extra") and got["m"]["more"] is None


def test_filters(spark):
    nodes = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 2)], "id string, depth int")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c"), ("x", "a")], "src string, dst string")
    assert pairs(filters.known_endpoints(edges, nodes)) == {("a", "b"), ("b", "c"), ("c", "c")}
    assert {r["id"] for r in filters.connected_only(nodes, edges).collect()} == {"a", "b", "c"}
    kept, left = filters.drop_nodes(nodes, edges, spark.createDataFrame([("b",)], "id string"))
    assert kept.count() == 3 and pairs(left) == {("c", "c"), ("x", "a")}
    assert pairs(filters.no_self_loops(edges)) == {("a", "b"), ("b", "c"), ("x", "a")}
    degree = {r["id"]: (r["in_degree"], r["out_degree"]) for r in stats.degrees(nodes, edges).collect()}
    assert degree == {"a": (1, 1), "b": (1, 1), "c": (2, 1), "d": (0, 0)}
    scaled = {r["id"]: r["scale"] for r in stats.degree_scale(stats.degrees(nodes, edges)).collect()}
    assert scaled["d"] == 0 and scaled["c"] == 1
    assert {r["scale"] for r in stats.degree_scale(stats.degrees(nodes, edges.where("false"))).collect()} == {0.0}


def test_flatten_metadata_wins(spark):
    df = spark.sql("SELECT map('x', '1.0', 'depth', '0') AS attrs, map('depth', '1', 'label', 'a') AS metadata UNION ALL SELECT map('x', '2'), NULL")
    got = sorted((dict(r["attrs"]) for r in filters.flatten_metadata(df).collect()), key=len)
    assert got == [{"x": "2"}, {"x": "1.0", "depth": "1", "label": "a"}]


def test_styles(spark):
    df = spark.createDataFrame([("n1", "ClassDef"), ("n2", "Nope")], "id string, type string")
    got = {r["id"]: (r["p_base"], r["p_size"], r["p_color"]) for r in graph.style_by_type(df).collect()}
    assert got == {"n1": ("def.class", 1000, "purple"), "n2": ("unknown", 400, "gray")}
    nodes = spark.createDataFrame([("a", 0, "directory", None, None), ("f", 2, "function", None, "steelblue"), ("o", 2, "other", "star", None)],
                                  "id string, depth int, kind string, shape string, color string")
    degrees = spark.createDataFrame([("o", 13)], "id string, degree int")
    got = {r["id"]: (r["shape"], r["color"]) for r in graph.default_style(nodes, degrees, {"secondary": "#123"}).collect()}
    assert got == {"a": ("diamond", "#7f8c8d"), "f": ("hexagon", "#123"), "o": ("star", "hsl(30, 70%, 60%)")}


def test_palette_covers_every_type(spark):
    rows = graph.palette(spark)
    assert rows.count() == rows.select("type").distinct().count() and rows.where(F.col("color").isNull()).count() == 0


def test_lasso_and_box(spark):
    df = spark.createDataFrame([("in", 1.0, 1.0), ("out", 5.0, 1.0), ("notch", 2.0, 3.5)], "id string, x double, y double")
    shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (0.0, 4.0)]
    assert {r["id"] for r in filters.lasso_select(df, shape).collect()} == {"in"}
    assert filters.lasso_select(df, shape[:2]).count() == 0
    assert {r["id"] for r in filters.box_select(df, 5.0, 1.0, 1.0, 1.0).collect()} == {"in", "out"}


def test_call_sites_are_dealt_out_before_they_are_counted(spark):
    sites = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b")], "src string, dst string")
    found = graph.calls(sites, spark.createDataFrame([("a",), ("b",)], "id string"))
    assert [(r["src"], r["dst"], round(r["weight"], 6)) for r in found.collect()] == [("a", "b", 1.3)]
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()


def test_nodes_are_sorted_once_and_weighed_edges_not_at_all(spark):
    nodes = spark.createDataFrame([("a", 2, "f", 1, "x"), ("a", 1, "f", 2, "y"), ("b", 1, "g", 1, "z")], "id string, depth int, file string, line int, label string")
    merged = graph.merge_nodes(nodes.where("depth = 1"), nodes.where("depth = 2"))
    assert {(r["id"], r["depth"], r["label"]) for r in merged.collect()} == {("a", 2, "x"), ("b", 1, "z")} and merged.columns == nodes.columns
    assert merged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Sort [") == 1
    edges = spark.createDataFrame([("a", "b", "k", 1.0), ("a", "b", "k", 3.0), ("a", "c", "k", None)], "src string, dst string, kind string, weight double")
    kept = graph.dedupe_edges(edges)
    assert {tuple(r) for r in kept.collect()} == {("a", "b", "k", 3.0), ("a", "c", "k", None)}
    assert "SortAggregate" not in kept._jdf.queryExecution().executedPlan().toString()


def test_whole_build_sends_no_rows_through_the_driver(spark, files):
    raw = "import os\nfrom c import D\nclass Foo(D):\n    def bar(self): pass\n"
    nodes, edges = build_graph(files({"a.py": raw, "d/b.py": raw, "d/e.go": "func F(a int) {\n"}), "root")
    rows = nodes.select("id", "kind").unionByName(edges.select(F.col("src").alias("id"), "kind"))
    ids = {r["id"] for r in rows.collect()}
    assert {"dir::d", "file::d/b.py", "d/b.py::b.Foo", "external::os"} <= ids
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_a_build_keeps_its_parts_packed(spark, files, tmp_path, monkeypatch):
    from graphloom import session
    from graphloom.plans.code_graph import build_graph

    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    nodes, _ = build_graph(files({"a.py": "import b\nclass A: pass\n", "p/c.go": "func F(a int) {\n"}), "root")
    assert {r.kind for r in nodes.collect()} == {"directory", "file", "module", "class", "function", "external_module"}
    written = {f.parent.name.partition("-")[0] for f in tmp_path.rglob("*.zstd.parquet")}
    assert written >= {"parsed", "symbols"} and spark.conf.get(session._CLEANUP) == "false"


def test_rows_that_come_again_are_merged_and_the_others_left(spark, monkeypatch):
    row = "id string, kind string, file string, line int, label string"
    a = spark.createDataFrame([("x", "k", "f", 2, "l"), ("x", None, "e", 1, "m"), ("y", "k", None, 1, "l"), (None, "k", "f", 1, "l"), (None, None, "f", 1, "m")], row)
    b = spark.createDataFrame([("x", "z", None, None, None), ("w", None, None, 3, None)], row)
    edges = spark.createDataFrame([("a", "b", "c", 1.0), ("a", "b", "c", 2.0), ("a", "b", "d", None), (None, "b", "c", 1.0), (None, "b", "c", 3.0), ("b", None, "c", 0.5)],
                                  "src string, dst string, kind string, weight double")
    def told(df):
        return sorted(map(str, df.collect()))

    want = told(graph.merge_nodes(a, b)), told(graph.dedupe_edges(edges))
    dealt = []
    real = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, purpose: dealt.append(out := real(df, purpose)) or out)
    assert (told(graph.merge_nodes(a, b, apart=True)), told(graph.dedupe_edges(edges, apart=True))) == want
    assert [d.count() for d in dealt] == [2, 2]  # x and null; a-b-c and null-b-c
    monkeypatch.setattr(graph, "MOST_REPEATED", 1)
    assert (told(graph.merge_nodes(a, b, apart=True)), told(graph.dedupe_edges(edges, apart=True))) == want
