import random

from graphloom.operators import graph, pyast
from graphloom.schemas import FILES
from graphloom.streaming import dependencies, sinks


def batch_edges(files):
    imports = pyast.python_imports(pyast.parse_python(files))
    stems = graph.file_by_stem(files.where("ext = '.py'"), seq="path")
    edges = graph.resolve_imports(imports, stems).unionByName(graph.external_modules(imports, stems)[1])
    return {(r["src"], r["dst"]) for r in edges.collect()}


def test_edges_after_each_batch_equal_a_batch_build(spark, files, tmp_path):
    rng = random.Random(3)
    names = [f"p{i % 3}/m{i}" for i in range(14)] + ["q/m1", "a/m1", "q/m5"]
    tree = {}
    for name in names:
        imports = rng.sample(["os", "os.path", "m1", "pkg.m1", "m5", "x.y.m2", "m9", "self.m3", "m13"], 4)
        tree[name + ".py"] = "".join(f"import {m}\n" for m in imports) + f"from {imports[0]} import *\nimport {name.rsplit('/')[-1]}\n"
    tree["p0/notes.go"] = "import m1\n"
    order = list(tree)
    rng.shuffle(order)
    seen = {}

    def changes():
        arriving = spark.readStream.schema(FILES).parquet(str(tmp_path / "in" / "*"))
        events = dependencies.arrivals(arriving, pyast.python_imports(pyast.parse_python(arriving)), salts=2)
        return dependencies.edge_changes(events)

    for at in range(0, len(order), 6):
        part = {p: tree[p] for p in order[at : at + 6]}
        seen |= part
        files(part).coalesce(2).write.parquet(str(tmp_path / "in" / f"part{at}"))
        stream = changes()
        sinks.drain(sinks.write_stateful(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
        edges = dependencies.current_edges(sinks.read_batches(spark, str(tmp_path / "out"), stream.schema))
        want = batch_edges(files(seen))
        assert {(r["src"], r["dst"]) for r in edges.collect()} == want
        outside = {d for _, d in want if d.startswith("external::")}
        assert {r["id"] for r in dependencies.external_nodes(edges).collect()} == outside
    assert any(d.startswith("file::") for _, d in want)


def test_an_import_points_to_its_file_or_outside():
    assert dependencies.edge_of("file::a.py", "x.b", "file::b.py") == ("file::a.py", "file::b.py")
    assert dependencies.edge_of("file::a.py", "x.a", "file::a.py") == ("file::a.py", "external::x")
    assert dependencies.edge_of("file::a.py", "os", None) == ("file::a.py", "external::os")


def test_imports_are_held_and_moved_by_the_piece():
    import pandas as pd

    class State:
        def __init__(self):
            self.rows, self.asked = [], 0

        def get(self):
            self.asked += 1
            return iter(self.rows)

        def exists(self):
            self.asked += 1
            return bool(self.rows)

        def appendValue(self, row):
            self.rows.append(row)

        def appendList(self, rows):
            self.rows += rows

    class Value(State):
        def get(self):
            self.asked += 1
            return self.rows[0] if self.rows else None

        def update(self, row):
            self.rows = [row]

    class Handle:
        def getValueState(self, name, schema):
            return Value()

        def getListState(self, name, schema):
            return State()

    work = dependencies.Resolver()
    work.init(Handle())
    rows = [(f"file::f{i}.py", None, "a.b") for i in range(25)] * 2
    frame = lambda r: iter([pd.DataFrame(r, columns=["file_id", "path", "module"])])
    first = list(work.handleInputRows(("b", 0), frame(rows), None))
    assert len(work.imports.rows) == 1 and sum(map(len, first)) == 1 and len(first[0]["files"][0]) == 25
    moved = list(work.handleInputRows(("b", 0), frame([("file::z/b.py", "z/b.py", None), ("file::a/b.py", "a/b.py", None)]), None))
    assert [(m["old"][0], m["new"][0], len(m["files"][0]), bool(m["held"][0])) for m in moved] == [(None, "file::z/b.py", 25, True)]
    assert list(work.handleInputRows(("b", 0), frame([("file::b.py", "b.py", None)]), None)) == []
