"""Python symbols and imports: `ast` inside mapInPandas, one pass per file, joins elsewhere."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.fixed.styles import PYTHON_COLOR, PYTHON_SHAPE

# Node type -> (kind, depth); anything else is a depth-3 symbol.
KIND_OF = {
    "Module": ("module", 1), "Class": ("class", 2), "Function": ("function", 2), "Import": ("import", 2),
    "Call": ("call", 3), "Argument": ("argument", 3), "Name": ("name", 3), "Constant": ("constant", 3),
    "For": ("loop", 3), "JoinedStr": ("string", 3), "FormattedValue": ("string", 3),
}

_OUT = ("file_id string, tag string, id string, dst string, type string, label string, line int, module string")


class _Walk:
    """Records of one file: what each construct adds, found by its type name."""

    def __init__(self, module: str, tree: ast.Module) -> None:
        self.module, self.nodes, self.edges, self.imported = module, {}, {}, {}
        self.root = self.add("Module", module, None, 0)
        self.children(tree, self.root)
        for name, full in self.imported.items():
            if full in self.nodes:
                self.link(self.root, self.add("Import", name, None, 0))
                self.link(f"{module}.{name}", full)

    def add(self, kind: str, label: str, parent: str | None, line: int) -> str:
        node = f"{self.module}.{label}"
        self.nodes.setdefault(node, (kind, label, line))
        if parent:
            self.link(parent, node)
        return node

    def link(self, src: str, dst: str) -> None:
        for end in (src, dst):
            self.nodes.setdefault(end, ("", end, 0))
        self.edges[(src, dst)] = None

    def children(self, item: ast.AST, parent: str) -> None:
        for child in ast.iter_child_nodes(item):
            self.visit(child, parent)

    def visit(self, item: ast.AST, parent: str) -> None:
        line = getattr(item, "lineno", 0)
        match item:
            case ast.ImportFrom():
                for alias in item.names:
                    full = f"{item.module}.{alias.name}"
                    self.imported[alias.name] = full
                    node = self.add("Import", full, parent, line)
                    self.link(self.root, node)
                    self.link(node, f"{item.module}.{item.module}")
            case ast.ClassDef():
                node = self.add("Class", item.name, parent, line)
                self.link(self.root, node)
                for base in item.bases:
                    if isinstance(base, ast.Name) and base.id in self.imported:
                        self.link(node, self.imported[base.id])
                for child in item.body:
                    self.visit(child, node)
            case ast.FunctionDef():
                node = self.add("Function", item.name, parent, line)
                for child in [*item.args.args, *item.body]:
                    self.visit(child, node)
            case ast.Expr():
                if isinstance(item.value, ast.Call):
                    node = self.add("Call", _callee(item.value.func), parent, line)
                    for arg in item.value.args:
                        self.visit(arg, node)
            case ast.Name():
                if item.id in self.imported:
                    self.link(parent, self.imported[item.id])
                else:
                    self.add("Name", item.id, parent, line)
            case ast.arg():
                self.add("Argument", item.arg, parent, line)
            case ast.Constant():
                self.add("Constant", f"Const: {item.value!r}", parent, line)
            case ast.For():
                node = self.add("For", "ForLoop", parent, line)
                for child in [item.target, item.iter, *item.body, *item.orelse]:
                    self.visit(child, node)
            case ast.JoinedStr() | ast.FormattedValue():
                name = type(item).__name__
                node = self.add(name, name, parent, line)
                for child in item.values if isinstance(item, ast.JoinedStr) else [item.value]:
                    self.visit(child, node)
            case _:
                self.children(item, parent)


def _callee(func: ast.expr) -> str:
    """'obj.method' or 'method' for attribute calls; plain calls carry no name."""
    if not isinstance(func, ast.Attribute):
        return ""
    return f"{func.value.id}.{func.attr}" if isinstance(func.value, ast.Name) else func.attr


def _modules(tree: ast.Module) -> list[str]:
    """Absolute module names of all import statements, in walk order, repeats kept."""
    found = []
    for item in ast.walk(tree):
        if isinstance(item, ast.Import):
            found += [alias.name for alias in item.names]
        elif isinstance(item, ast.ImportFrom) and item.level == 0 and item.module:
            found.append(item.module)
    return found


PIECE_ROWS = 20_000  # rows a task holds before it hands them on


def _parse_file(file_id: str, stem: str, raw: str, max_depth: int) -> Iterator[tuple]:
    try:
        tree = ast.parse(raw)
        walk = _Walk(stem, tree)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:
        yield (file_id, "reject", None, None, None, str(error), 0, stem)
        return
    kept = {n for n, (t, _, _) in walk.nodes.items() if KIND_OF.get(t, ("symbol", 3))[1] <= max_depth}
    yield from ((file_id, "node", n, None, *walk.nodes[n], stem) for n in walk.nodes if n in kept)
    # An edge tells the types of its ends in place of a type and a label.
    yield from ((file_id, "edge", s, d, walk.nodes[s][0], walk.nodes[d][0], 0, stem) for s, d in walk.edges if s in kept and d in kept)
    yield from ((file_id, "import", None, None, None, m, 0, stem) for m in _modules(tree))


def _parser(max_depth: int):
    columns = ["file_id", "tag", "id", "dst", "type", "label", "line", "module"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, stem, raw in zip(batch["file_id"], batch["stem"], batch["raw"]):
                for row in _parse_file(file_id, stem, raw, max_depth):
                    rows.append(row)
                    if len(rows) >= PIECE_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    return run


def parse_python(files: DataFrame, max_depth: int = 3) -> DataFrame:
    """Tagged rows (node, edge, import, reject) of all Python files down to a depth; cut lineage to reuse them."""
    source = files.where((F.lower("ext") == ".py") & (F.coalesce(F.col("raw"), F.lit("")) != ""))
    slim = source.select(F.concat(F.lit("file::"), F.col("path")).alias("file_id"), "stem", "raw")
    return slim.mapInPandas(_parser(max_depth), _OUT)


def _kind_and_depth(type_: Column) -> tuple[Column, Column]:
    def lookup(place: int, default):
        pairs = [x for k, v in KIND_OF.items() for x in (F.lit(k), F.lit(v[place]))]
        return F.coalesce(F.try_element_at(F.create_map(*pairs), type_), F.lit(default))

    return lookup(0, "symbol"), lookup(1, 3)


def python_nodes(parsed: DataFrame, max_depth: int = 2) -> DataFrame:
    """Nodes of the unified schema plus `file_id` and `legacy_id`, the id without its file, under which equal modules merge."""
    kind, depth = _kind_and_depth(F.col("type"))
    known = F.col("type") != ""
    return (
        parsed.where(F.col("tag") == "node").withColumn("kind", kind).withColumn("depth", depth)
        .where(F.col("depth") <= max_depth)
        .select(
            F.concat_ws("::", F.substring("file_id", 7, 1 << 30), "id").alias("id"), "depth", F.lit("python").alias("language"), "kind", "label",
            F.when(known, F.concat("module", F.lit(".py"))).otherwise("").alias("file"), "line",
            F.create_map(F.lit("module"), F.when(known, F.col("module")).otherwise(""), F.lit("ast_type"), F.col("type")).alias("meta"),
            F.try_element_at(F.create_map(*[F.lit(x) for kv in PYTHON_SHAPE.items() for x in kv]), F.col("kind")).alias("shape"),
            F.try_element_at(F.create_map(*[F.lit(x) for kv in PYTHON_COLOR.items() for x in kv]), F.col("kind")).alias("color"),
            "file_id", F.col("id").alias("legacy_id"),
        )
    )


def python_edges_to(parsed: DataFrame, max_depth: int = 2) -> DataFrame:
    """Edges inside each file between nodes down to a depth, as `python_edges` gives them for `python_nodes(parsed, max_depth)`.

    An edge row knows what its ends are, so nothing is joined.
    """
    _, src_depth = _kind_and_depth(F.col("type"))
    dst_kind, dst_depth = _kind_and_depth(F.col("label"))
    kept = parsed.where((F.col("tag") == "edge") & (src_depth <= max_depth) & (dst_depth <= max_depth))
    return kept.select(*_edge(F.col("id"), F.col("dst"), dst_kind))


def _edge(src: Column, dst: Column, dst_kind: Column) -> list[Column]:
    path = F.substring("file_id", 7, 1 << 30)
    return [F.col("file_id"), F.concat_ws("::", path, src).alias("src"), F.concat_ws("::", path, dst).alias("dst"),
            F.when(dst_kind == "import", "imports").otherwise("contains").alias("kind"), F.lit(1.0).alias("weight")]


def python_edges(parsed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges inside each file between kept nodes: `imports` into import nodes, else `contains`.

    The joins are by shuffle: sizes are guessed from the files' and say little of the rows parsed from them.
    """
    raw = parsed.where(F.col("tag") == "edge").select("file_id", F.col("id").alias("src"), "dst")
    # A node's id is its file and its legacy id, so one look-up of the target is enough for both.
    kept = nodes.select("file_id", F.col("legacy_id"), "kind")
    return (
        raw.join(kept.select("file_id", F.col("legacy_id").alias("src")).hint("merge"), ["file_id", "src"], "left_semi")
        .join(kept.select("file_id", F.col("legacy_id").alias("dst"), F.col("kind").alias("dst_kind")).hint("merge"), ["file_id", "dst"])
        .select(*_edge(F.col("src"), F.col("dst"), F.col("dst_kind")))
    )


def python_imports(parsed: DataFrame) -> DataFrame:
    """One row per imported module of each statement, not deduplicated."""
    return parsed.where(F.col("tag") == "import").select("file_id", F.col("label").alias("module"))


def python_rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("tag") == "reject").select("file_id", F.col("label").alias("reason"))
