"""Dependencies between files while they arrive: an edge leaves when its second end is there.

State is kept per stem: the file the stem names, and the imports that wait for it or use it. A new
file turns outside packages into files, a later file of the same stem takes the edges over; both
leave as changes, -1 for an edge that no longer holds and 1 for one that does. Summed up, the
changes are the edges of a batch build over the files so far. Imports of one stem are dealt to SALTS
states by their file, and files go to all of them, so a module that everyone imports is no single state.
State holds the files of a module by the piece, and a change of the target leaves by the piece too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from graphloom.operators import graph

SALTS = 8


def arrivals(files: DataFrame, imports: DataFrame, salts: int = SALTS) -> DataFrame:
    """(stem, salt, file_id, path, module): files of Python modules (module null) and imports of arriving files."""
    python = files.where(F.lower("ext") == ".py") if "ext" in files.columns else files
    known = python.select("stem", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), graph.file_id(F.col("path")).alias("file_id"), "path",
                          F.lit(None).cast("string").alias("module"))
    asked = imports.select(F.substring_index("module", ".", -1).alias("stem"), F.pmod(F.xxhash64("file_id"), F.lit(salts)).cast("int").alias("salt"),
                           "file_id", F.lit(None).cast("string").alias("path"), "module")
    return known.unionByName(asked)


def edge_of(file_id: str, module: str, target: str | None) -> tuple[str, str]:
    """What an import points to: the file its last part names, else the package outside."""
    if target is not None and target != file_id:
        return file_id, target
    return file_id, "external::" + module.split(".", 1)[0]


PIECE = 10_000  # files in one row of state or of changes
_MOVES = "module string, files array<string>, old string, new string, held boolean"


def _pieces(asked: dict[str, set[str]]) -> Iterator[tuple[str, list[str]]]:
    for module, files in sorted(asked.items()):
        ordered = sorted(files)
        yield from ((module, ordered[i:i + PIECE]) for i in range(0, len(ordered), PIECE))


class Resolver(StatefulProcessor):
    """Says of many files at once that a module they import now means `new`, and, if they were `held`, meant `old` before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.target = handle.getValueState("target", "file_id string")
        self.imports = handle.getListState("imports", "module string, files array<string>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked, best = {}, None
        for part in rows:
            for file_id, module in zip(part["file_id"].tolist(), part["module"].tolist()):
                if module is None or module != module:
                    best = file_id if best is None else max(best, file_id)
                else:
                    asked.setdefault(module, set()).add(file_id)
        found = self.target.get()
        before = None if found is None else found[0]
        now = before if best is None or (before is not None and before >= best) else best
        if now != before:
            self.target.update((now,))
            for module, files in self.imports.get():
                yield _move(module, files, before, now, True)
        for module, files in _pieces(asked):
            self.imports.appendValue((module, files))
            yield _move(module, files, None, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def _move(module: str, files: list[str], old: str | None, new: str | None, held: bool) -> pd.DataFrame:
    return pd.DataFrame({"module": [module], "files": [list(files)], "old": [old], "new": [new], "held": [held]})


def _end(target: str) -> Column:
    """`edge_of` as a column."""
    known = F.col(target).isNotNull() & (F.col(target) != F.col("src"))
    return F.when(known, F.col(target)).otherwise(F.concat(F.lit("external::"), F.substring_index("module", ".", 1)))


def edge_changes(arriving: DataFrame) -> DataFrame:
    """Changes of `depends_on` edges, for append mode; write it with `sinks.write_stateful`.

    A path arrives once, and with it all its imports.
    """
    # Paths begin alike in ids, so the last file of a stem by its path is the last by its id.
    slim = arriving.select("stem", "salt", "file_id", "module")
    moves = slim.groupBy("stem", "salt").transformWithStateInPandas(Resolver(), _MOVES, "Append", "None")
    each = moves.select(F.explode("files").alias("src"), "module", "old", "new", "held")
    ends = each.select("src", "held", _end("old").alias("was"), _end("new").alias("now")).where(~F.col("held") | (F.col("was") != F.col("now")))
    gone = F.when(F.col("held"), F.struct(F.col("was").alias("dst"), F.lit(-1).alias("change")))
    come = F.struct(F.col("now").alias("dst"), F.lit(1).alias("change"))
    return ends.select("src", F.inline(F.array_compact(F.array(gone, come)))).select("src", "dst", F.lit("depends_on").alias("kind"), "change")


def current_edges(changes: DataFrame) -> DataFrame:
    """The edges that hold after the changes written so far."""
    held = changes.groupBy("src", "dst", "kind").agg(F.sum("change").alias("_n")).where("_n > 0")
    return held.select("src", "dst", "kind", F.lit(1.0).alias("weight"))


def external_nodes(edges: DataFrame) -> DataFrame:
    """(id, label) of the packages outside that edges point to."""
    outside = edges.where(F.col("dst").startswith("external::")).select(F.col("dst").alias("id")).distinct()
    return outside.select("id", F.expr("substring(id, 11)").alias("label"))
