"""Graph documents larger than a row: nodes and edges cut out of ordered pieces of text, in parallel.

A piece alone does not tell whether it starts inside a string or how deep it lies. So each piece is
summed up for every way it may start: where it ends, and how many brackets open and commas stand at
each depth. Such sums can be joined, so a scan over them, in groups of GROUP and then over groups,
gives every piece its true start: string state, depth, and how many containers and commas came before.
With it each piece is cut by itself. Elements that end in the piece they start in are done; parts of
the others are joined by their number. Only the few members of the outer objects reach the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import feed
from graphloom.session import cut_lineage

GROUP = 1024  # pieces summed up together, at most
MERGED = 1 << 18  # characters up to which neighbouring rows become one piece
AT_ONCE = 16  # merged pieces that a worker holds at a time
OUT, IN, ESCAPED = range(3)  # outside strings, inside, inside behind a backslash
DEEPEST = 3  # containers of nodes and edges lie at most this deep
LISTS = {"nodes": "nodes", "edges": "edges", "links": "edges"}

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[^\s"]', re.S)


_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _few_at_once(spark: SparkSession) -> Iterator[None]:
    """What runs in here hands its workers AT_ONCE rows at a time: thousands of merged pieces, the default, would be gigabytes."""
    before = spark.conf.get(_RECORDS, None)
    spark.conf.set(_RECORDS, str(AT_ONCE))
    try:
        yield
    finally:
        spark.conf.unset(_RECORDS) if before is None else spark.conf.set(_RECORDS, before)


def structure(raw: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets and commas outside strings, what each does to the depth (1, -1, 0), and the state at the end."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), start
    slash = raw == 92
    # Backslashes in front of every place; one before the piece counts if they reach back to it.
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(slash, -1, np.arange(n)))])
    before = np.arange(n + 1) - 1 - last + ((last == -1) & (start == ESCAPED))
    quote = (raw == 34) & (before[:n] % 2 == 0)
    told = np.cumsum(quote) + (start != OUT)
    outside = (told - quote) % 2 == 0
    step = np.zeros(256, np.int64)
    step[[91, 123]], step[[93, 125]] = 1, -1
    at = np.flatnonzero(outside & ((step[raw] != 0) | (raw == 44)))
    end = OUT if told[-1] % 2 == 0 else ESCAPED if before[n] % 2 else IN
    return at, step[raw[at]], end


def summed(raw: np.ndarray) -> list[list]:
    """For each start: the end, the change of depth, and {depth: [brackets opened to it, commas at it]}, depths from the start's."""
    out = []
    for start in (OUT, IN, ESCAPED):
        _, step, end = structure(raw, start)
        depth = np.cumsum(step)
        counts: dict[int, list[int]] = {}
        for which, chosen in enumerate((step == 1, step == 0)):
            for d, n in zip(*np.unique(depth[chosen], return_counts=True), strict=True):
                if d <= DEEPEST:
                    counts.setdefault(int(d), [0, 0])[which] = int(n)
        out.append([end, int(depth[-1]) if len(depth) else 0, counts])
    return out


def joined(a: list[list], b: list[list]) -> list[list]:
    """The sum of a text and the one after it."""
    out = []
    for end, change, counts in a:
        more_end, more_change, more = b[end]
        together = {d: list(n) for d, n in counts.items()}
        for d, n in more.items():
            if d + change <= DEEPEST:
                have = together.setdefault(d + change, [0, 0])
                together[d + change] = [have[0] + n[0], have[1] + n[1]]
        out.append([more_end, change + more_change, together])
    return out


def _packed(sums: list[list]) -> str:
    return json.dumps([[e, c, [[d, *n] for d, n in counts.items()]] for e, c, counts in sums])


def _unpacked(text: str) -> list[list]:
    return [[e, c, {d: [o, k] for d, o, k in counts}] for e, c, counts in json.loads(text)]


#: String state, depth, containers opened and commas passed at depths 2 and 3.
_AT = ["state", "depth", "opened2", "commas2", "opened3", "commas3"]
_AT_DDL = ", ".join(f"{c} long" for c in _AT)


def _after(at: tuple, sums: list[list]) -> tuple:
    state, depth, *counts = at
    end, change, found = sums[state]
    for i, level in enumerate((2, 3)):
        opened, commas = found.get(level - depth, (0, 0))
        counts[2 * i] += opened
        counts[2 * i + 1] += commas
    return end, depth + change, *counts


def _sum_pieces(batches):
    for pdf in batches:
        yield pd.DataFrame({"seq": pdf["seq"], "sums": [_packed(summed(np.frombuffer((t or "").encode(), np.uint8))) for t in pdf["text"]]})


def _sum_group(pdf: pd.DataFrame) -> pd.DataFrame:
    ordered = [_unpacked(s) for s in pdf.sort_values("seq")["sums"]]
    total = ordered[0]
    for sums in ordered[1:]:
        total = joined(total, sums)
    return pd.DataFrame({"group": [pdf["group"].iloc[0]], "sums": [_packed(total)]})


def _starts(name: str):
    """Starts of rows in order, from the start in their columns or, for the whole document, from nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name)
        at = tuple(int(pdf[c].iloc[0]) for c in _AT) if "state" in pdf.columns else (OUT, 0, 0, 0, 0, 0)
        rows = []
        for key, sums in zip(pdf[name], pdf["sums"], strict=True):
            rows.append((key, *at))
            at = _after(at, _unpacked(sums))
        return pd.DataFrame(rows, columns=[name, *_AT])

    return run


def _merge(most: int):
    """Rows that follow each other in number and in a batch as one, up to about `most` characters."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            seq, size = pdf["seq"].to_numpy(np.int64), pdf["text"].fillna("").str.len().to_numpy(np.int64)
            filled = np.cumsum(size) // most
            new = np.ones(len(pdf), bool)
            new[1:] = (seq[1:] != seq[:-1] + 1) | (filled[1:] != filled[:-1])
            at = np.flatnonzero(new)
            texts = pdf["text"].fillna("").to_list()
            ends = [*at[1:].tolist(), len(texts)]
            yield pd.DataFrame({"seq": seq[at], "text": ["".join(texts[a:b]) for a, b in zip(at.tolist(), ends, strict=True)]})

    return run


def with_starts(pieces: DataFrame, merge: int = MERGED) -> DataFrame:
    """The pieces (seq, text), small neighbours merged, with the state, depth and counts they start with."""
    pieces = cut_lineage(pieces.select("seq", "text").mapInPandas(_merge(merge), "seq long, text string"))
    with _few_at_once(pieces.sparkSession):
        sums = cut_lineage(pieces.select("seq", "text").mapInPandas(_sum_pieces, "seq long, sums string").withColumn("group", F.expr(f"seq div {GROUP}")))
    groups = sums.groupBy("group").applyInPandas(_sum_group, "group long, sums string")
    # One row for GROUP pieces.
    group_starts = groups.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_starts("group"), f"group long, {_AT_DDL}")
    starts = sums.join(group_starts, "group").groupBy("group").applyInPandas(_starts("seq"), f"seq long, {_AT_DDL}")
    return pieces.select("seq", "text").join(starts, "seq")


def _skeleton(level: int, within: int | None):
    """Text that lies exactly at a depth, with the brackets it opens and their numbers: what an object has, without the contents."""

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                raw = np.frombuffer((row.text or "").encode(), np.uint8)
                if not len(raw):
                    continue
                at, step, _ = structure(raw, row.state)
                change = np.zeros(len(raw), np.int64)
                change[at] = step
                depth = row.depth + np.cumsum(change)
                opens = (change == 1) & (depth == level + 1)
                keep = opens | ((depth == level) & (change == 0))
                if within is not None:
                    keep &= row.opened2 + np.cumsum((change == 1) & (depth == level)) == within + 1
                if keep.any():
                    numbers = getattr(row, f"opened{level + 1}") + np.cumsum(opens) - 1
                    out.append((row.seq, raw[keep].tobytes().decode("utf-8", "ignore"), numbers[opens & keep].tolist()))
            yield pd.DataFrame(out, columns=["seq", "text", "numbers"])

    return run


def members(skeleton: str) -> list[tuple[str, str]]:
    """(key, bracket) of every container that a skeleton opens, in order."""
    out, key, last = [], "", ""
    for token in _TOKEN.findall(skeleton):
        if token == ":":
            key = last
        elif token in "[{":
            out.append((key, token))
            key = ""
        elif token == ",":
            key = ""
        last = token[1:-1] if token.startswith('"') else ""
    return out


def _containers(placed: DataFrame) -> tuple[int, dict[int, tuple[str, str]]]:
    """The depth of the lists and {number of the container: (nodes or edges, its bracket)}."""

    def listed(level: int, within: int | None = None) -> list[tuple[int, str, str]]:
        rows = placed.mapInPandas(_skeleton(level, within), "seq long, text string, numbers array<long>").orderBy("seq").collect()
        found = members("".join(r["text"] for r in rows))
        return [(n, *f) for n, f in zip([n for r in rows for n in r["numbers"]], found, strict=True)]

    root = listed(1)
    lists = {i: (LISTS[k], b) for i, k, b in root if k in LISTS}
    for number, key, bracket in root:
        if not lists and key == "graph" and bracket == "{":
            return 3, {i: (LISTS[k], b) for i, k, b in listed(2, number) if k in LISTS}
    return 2, lists


def _cut(level: int, wanted: dict[int, tuple[str, str]]):
    """(container, element, seq, whole, text) of every element or part of one in the wanted containers."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                out = []
                data = (row.text or "").encode()
                at, step, _ = structure(np.frombuffer(data, np.uint8), row.state)
                depth = row.depth + np.cumsum(step)
                opened, commas = getattr(row, f"opened{level}"), getattr(row, f"commas{level}")
                opens, closes, cuts = (step == 1) & (depth == level), (step == -1) & (depth == level - 1), (step == 0) & (depth == level)
                here = np.flatnonzero(opens | closes | cuts)
                # A place before which an element of the container may have begun, in this piece or an earlier one.
                begin, inside, started = 0, row.depth >= level, False
                for x in here.tolist():
                    p = int(at[x])
                    if inside and opened - 1 in wanted:
                        out.append((opened - 1, commas, row.seq, started, data[begin:p].decode("utf-8", "ignore")))
                    if opens[x]:
                        opened, inside, started = opened + 1, True, True
                    elif closes[x]:
                        inside = False
                    else:
                        commas, started = commas + 1, True
                    begin = p + 1
                if inside and opened - 1 in wanted and begin < len(data):
                    out.append((opened - 1, commas, row.seq, False, data[begin:].decode("utf-8", "ignore")))
                yield pd.DataFrame(out, columns=["container", "element", "seq", "whole", "text"])

    return run


def elements(pieces: DataFrame, merge: int = MERGED) -> DataFrame:
    """(list, bracket, position, text) of every node and edge of a document given as pieces.

    The lists are `nodes`, `edges` or `links` of the document or, if it has none, of its `graph`. Pieces are
    ordered by `seq`, which has to differ, and may be cut anywhere between characters; an element has to fit a row, the document and its lists have not.
    """
    spark = pieces.sparkSession
    placed = cut_lineage(with_starts(pieces, merge))
    with _few_at_once(spark):
        level, wanted = _containers(placed)
    if not wanted:
        return spark.createDataFrame([], "list string, bracket string, position long, text string")
    with _few_at_once(spark):
        cut = cut_lineage(placed.mapInPandas(_cut(level, wanted), "container long, element long, seq long, whole boolean, text string"))
    parts = cut.where("NOT whole").groupBy("container", "element").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("p"))
    rest = parts.select("container", "element", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))
    every = cut.where("whole").select("container", "element", "text").unionByName(rest)
    # A handful of containers.
    first = {r["container"]: r["n"] for r in cut.groupBy("container").agg(F.min("element").alias("n")).collect()}
    known = [(c, *wanted[c], first[c]) for c in wanted if c in first]
    names = spark.createDataFrame(known, "container long, list string, bracket string, first long")
    found = every.join(F.broadcast(names), "container").where(F.trim(F.translate("text", "\t\r\n", "   ")) != "")
    return found.select("list", "bracket", (F.col("element") - F.col("first")).alias("position"), "text")


def read_pieces(pieces: DataFrame, merge: int = MERGED) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a document in pieces, as `feed.read_graph_nodes` and `feed.read_graph_edges` give them for one row."""
    found = elements(pieces, merge)
    closing = F.when(F.col("bracket") == "[", "]").otherwise("}")
    document = F.concat(F.lit('{"'), F.col("list"), F.lit('":'), F.col("bracket"), F.col("text"), closing, F.lit("}"))
    rows = found.select("list", "position", document.alias("document"))
    nodes = feed.read_graph_nodes(rows.where("list = 'nodes'").drop("list"), position="position")
    return nodes.drop("position"), feed.read_graph_edges(rows.where("list = 'edges'").select("document"))
