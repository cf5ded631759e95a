import json

import pytest
from pyspark.sql import functions as F

from graphloom.functions import keys, paths, urls
from graphloom.operators import filters, graph, stats
from graphloom.sources import documents, files as tree, logs


@pytest.fixture
def root(tmp_path):
    def write(entries):
        for path, content in entries.items():
            p = tmp_path / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(tmp_path)

    return write


def names(df):
    return {r["name"] for r in df.select("name").collect()}


def test_default_extensions(spark, root):
    assert names(tree.scan_tree(spark, root({"main.py": "x", "lib.c": "y", "notes.txt": "z"}))) == {"main.py", "lib.c"}


def test_extensions_are_normalised(spark, root):
    assert names(tree.scan_tree(spark, root({"main.PY": "x", "app.js": "y", "skip.rb": "z"}), ["PY", "js"])) == {"main.PY", "app.js"}


def test_excluded_directories(spark, root):
    entries = {f"{d}/file.py": "x" for d in (".vs", ".idea", ".vscode", "bin", "obj", "node_modules", "a/build/b", "x.egg-info")}
    assert names(tree.scan_tree(spark, root({**entries, "keep.py": "x", "binary/also.py": "y"}))) == {"keep.py", "also.py"}


def test_size_cap_and_bad_utf8(spark, root):
    top = root({"big.py": "a" * 1_000_001, "edge.py": "b" * 1_000_000, "bad.py": b"\xff\xfe\x00\x01", "ok.py": "é"})
    whole = tree.scan_tree(spark, top)
    assert {r["name"]: len(r["raw"]) for r in whole.collect()} == {"big.py": 1_000_001, "edge.py": 1_000_000, "bad.py": 0, "ok.py": 1}
    assert [r["path"] for r in tree.textless_files(whole).collect()] == ["bad.py"]
    capped = tree.scan_tree(spark, top, max_bytes=1_000_000)
    assert sorted(r["path"] for r in tree.textless_files(capped).collect()) == ["bad.py", "big.py"]
    rows = {r["name"]: r for r in capped.collect()}
    assert rows["big.py"]["raw"] == "" and rows["big.py"]["size"] == 1_000_001
    assert len(rows["edge.py"]["raw"]) == 1_000_000 and rows["bad.py"]["raw"] == "" and rows["ok.py"]["raw"] == "é"


def test_names_with_odd_characters(spark, root):
    rows = tree.scan_tree(spark, root({"a b/c+d %41.py": "x"})).collect()
    assert [(r["path"], r["folder"], r["stem"]) for r in rows] == [("a b/c+d %41.py", "a b", "c+d %41")]


def test_missing_root(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tree.scan_tree(spark, str(tmp_path / "none"))
    (tmp_path / "f").write_text("x")
    with pytest.raises(NotADirectoryError):
        tree.scan_tree(spark, str(tmp_path / "f"))


def test_stats_and_rollup(files):
    df = files({"pkg/mod.py": "abc", "main.py": "de", "lib.c": "f"})
    folders = tree.folders_of(df, "root")
    assert stats.file_stats(df, folders).first().asDict() == {"total_files": 3, "total_size": 6, "python_files": 2, "folders": 1}
    assert {r["path"]: r["size"] for r in stats.folder_size_rollup(df).collect()} == {"": 6, "pkg": 3}


def test_walk_to_folder(files):
    df = files({"src/main.py": "x", "src/utils/helpers.py": "y"})
    folders = tree.folders_of(df, "root")
    for path, found in (("", 1), ("src", 1), ("src/utils", 1), ("/src/utils/", 1), ("nonexistent", 0), ("src/ghost/deep", 0)):
        assert tree.find_folder(folders, path).count() == found
    assert {(r["name"], r["is_file"]) for r in tree.list_level(folders, df, "/src/").collect()} == {("utils", False), ("main.py", True)}
    shown, kept = tree.list_to_depth(folders, df, 1)
    assert {(r["path"], r["is_stub"]) for r in shown.collect()} == {("", False), ("src", True)} and kept.count() == 0


def test_tree_from_listing_creates_ancestors(spark):
    listing = spark.createDataFrame([("a/b/c/f.py", "blob", "u"), ("empty", "tree", ""), ("top.py", "blob", "v")], "path string, type string, url string")
    folders, found = tree.tree_from_listing(listing, "owner/repo")
    assert {r["path"]: (r["name"], r["parent_path"], r["tree_depth"]) for r in folders.collect()} == {
        "": ("owner/repo", None, 0), "a": ("a", "", 1), "a/b": ("b", "a", 2), "a/b/c": ("c", "a/b", 3), "empty": ("empty", "", 1)}
    assert {(r["name"], r["parent_path"]) for r in found.collect()} == {("f.py", "a/b/c"), ("top.py", "")}


def test_size_tiers(spark):
    sizes = spark.createDataFrame([("s", 4_999_000), ("m", 5_000_000), ("l", 50_000_000), ("cut", 1)], "repo string, size long")
    cut = spark.createDataFrame([("cut",)], "repo string")
    got = {r["repo"]: (r["tier"], r["is_partial"]) for r in tree.size_tiers(sizes, cut).collect()}
    assert got == {"s": ("content", False), "m": ("structure", False), "l": ("shallow", True), "cut": ("shallow", True)}


@pytest.mark.parametrize("path, flagged", [
    ("compat/apple-only.c", True), ("src\\Win32\\x.c", True), ("port/darwin.h", True), ("a/vms_io.c", True), ("lib/os400/x.c", True),
    ("src/main.c", False), ("lib/linux.c", False), ("core/io.c", False)])
def test_platform_paths(spark, path, flagged):
    df = spark.createDataFrame([(path,)], "path string")
    assert filters.platform_filter(df).count() == (0 if flagged else 1)
    assert filters.platform_skipped(df).count() == (1 if flagged else 0)


def test_path_parts(spark):
    df = spark.createDataFrame([("a.b.py",), (".bashrc",), ("README",), ("x.",)], "n string")
    got = [(r["n"], r["s"], r["t"]) for r in df.select("n", paths.suffix(F.col("n")).alias("s"), paths.stem(F.col("n")).alias("t")).collect()]
    assert got == [("a.b.py", ".py", "a.b"), (".bashrc", "", ".bashrc"), ("README", "", "README"), ("x.", "", "x.")]


def test_repo_keys_and_owners(spark):
    df = spark.createDataFrame([("https://github.com/octocat/Hello-World",), ("https://example.org/x",)], "u string")
    a, b = [r[0] for r in df.select(keys.repo_key(F.col("u"))).collect()]
    assert a == "octocat-Hello-World" and len(b) == 16
    cfg = spark.createDataFrame([("url = https://github.com/me/r.git\n",), ("url = git@github.com:you/r.git\n",), ("x",)], "c string")
    assert [r[0] for r in cfg.select(urls.owner_of_remote(F.col("c"))).collect()] == ["me", "you", "local"]
    u = spark.createDataFrame([("https://github.com/o/r.git",), ("https://github.com/o/r/tree/main",), ("ftp://x",)], "u string")
    assert [tuple(r[0]) if r[0] else None for r in u.select(urls.owner_repo(F.col("u"))).collect()] == [("o", "r"), ("o", "r"), None]


def test_compile_commands(spark, tmp_path):
    db = [{"directory": "/d", "file": "mm/a.c", "command": "gcc -c -O2 -oa.o '-DX=1 2' mm/a.c"},
          {"directory": "/d", "file": "b.c", "arguments": ["cc", "gcc", "-c", "-Ifoo", "b.c"]}]
    (tmp_path / "cc.json").write_text(json.dumps(db))
    got = {r["file"]: r["args"] for r in documents.read_compile_commands(spark, str(tmp_path / "cc.json")).collect()}
    assert got == {"mm/a.c": ["-O2", "-DX=1 2", "mm/a.c"], "b.c": ["-Ifoo", "b.c"]}
    assert filters.subsystem_filter(documents.read_compile_commands(spark, str(tmp_path / "cc.json")), "mm/").count() == 1


def test_lexicon(spark):
    assert [r[0] for r in documents.available_lexicons(spark).collect()] == ["c"]
    tokens = graph.lexicon_tokens(documents.load_lexicon(spark, "C"))
    kw = tokens.where("kind = 'keywords'")
    assert kw.where("since = ''").count() == 32
    ordinals = [r[0] for r in kw.select("layer_ordinal").distinct().orderBy("layer_ordinal").collect()]
    assert ordinals == list(range(len(ordinals)))
    star = graph.enrich_tokens(spark.createDataFrame([("*",)], "token string"), tokens).collect()
    assert len(star) >= 2 and "Memory & address" in {r["layer_name"] for r in star}
    nodes, edges = graph.lexicon_graph(tokens)
    from graphloom.operators import traverse

    assert [r["id"] for r in traverse.roots(nodes, edges).collect()] == ["lang:c"]
    assert traverse.components(nodes, edges).select("component").distinct().count() == 1


def test_log_history_tail(spark, tmp_path):
    good = "Feb 27 14:32:01 h sshd[1]: Accepted password for a from b port 22 ssh2"
    (tmp_path / "auth.log").write_text("\n".join([good] * 20 + ["Feb 27 14:32:01 h crond[1]: (CRON)", good.replace("Accepted", "Failed")]) + "\n")
    got = logs.read_log_history(spark, str(tmp_path / "auth.log"), 2025, max_lines=5)
    assert sorted(r["line_no"] for r in got.collect()) == [18, 19, 20, 22]


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(1, 2001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        got = logs.read_log_lines(spark, str(tmp_path / "big.log"))
        assert got.where(F.col("value") != F.concat(F.lit("line "), F.col("line_no"))).count() == 0 and got.count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_missing_log_gives_no_events(spark, tmp_path):
    assert logs.read_log_history(spark, str(tmp_path / "none.log"), 2025).count() == 0
    assert logs.read_log_history(spark, str(tmp_path / "*.log"), 2025).count() == 0


def test_journal_export_cutoff_and_units(spark, tmp_path):
    rows = [f"2025-02-27T14:{m:02}:01+0100 h {s}[7]: Accepted x" for m, s in ((0, "sshd"), (40, "sshd"), (41, "sudo"))]
    (tmp_path / "j.log").write_text("\n".join(rows) + "\nnoise\n")
    now = F.lit("2025-02-27 13:45:00+00:00").cast("timestamp")
    assert logs.read_journal_export(spark, str(tmp_path / "j.log"), now, 30).count() == 2
    assert logs.read_journal_export(spark, str(tmp_path / "j.log"), now, 30, ["sudo"]).count() == 1
