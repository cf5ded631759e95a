"""Lines and symbols out of source text, as native column expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.fixed import languages as L
from graphloom.functions import text
from graphloom.operators import filters


@dataclass
class Language:
    """A registered language: pattern rules, or a function files -> nodes for real grammars."""

    name: str
    extensions: list[str]
    rules: list[tuple[str, str]] = field(default_factory=list)
    nodes: Callable[[DataFrame], DataFrame] | None = None


class Registry:
    """Languages by name and extension; the last registration of an extension wins."""

    def __init__(self) -> None:
        self._languages: dict[str, Language] = {}
        self._by_extension: dict[str, str] = {}

    def register(self, language: Language) -> None:
        self._languages[language.name] = language
        for ext in language.extensions:
            self._by_extension[ext.lower()] = language.name

    def get(self, ext: str) -> Language | None:
        name = self._by_extension.get(ext.lower())
        return self._languages.get(name) if name else None

    def by_extension(self) -> dict[str, str]:
        return dict(self._by_extension)

    def languages(self) -> dict[str, list[str]]:
        """Language -> its extensions, sorted."""
        out: dict[str, list[str]] = {}
        for ext, name in self._by_extension.items():
            out.setdefault(name, []).append(ext)
        return {name: sorted(exts) for name, exts in sorted(out.items())}

    def callable_languages(self) -> list[Language]:
        return [lang for lang in self._languages.values() if lang.nodes]

    def rule_languages(self) -> list[Language]:
        return [lang for lang in self._languages.values() if lang.rules]


REGISTRY = Registry()
for _name, (_extensions, _rules) in L.SYMBOL_RULES.items():
    REGISTRY.register(Language(_name, _extensions, _rules))
for _name, _extensions in L.OTHER_EXTENSIONS.items():
    REGISTRY.register(Language(_name, _extensions))


def register_language(name: str, extensions: list[str], rules_or_function) -> None:
    """Add a language by its rules (native columns) or by a DataFrame function of the files.

    The function gets all files of the language at once, so it may look across the tree, and returns
    node rows with at least id, kind, label, line and file_id.
    """
    if callable(rules_or_function):
        REGISTRY.register(Language(name, extensions, nodes=rules_or_function))
    else:
        REGISTRY.register(Language(name, extensions, rules=list(rules_or_function)))


def unregister_language(name: str) -> None:
    """Forget a language and its extensions; an extension it took over from another is unknown afterwards."""
    for extension in REGISTRY._languages.pop(name).extensions:
        REGISTRY._by_extension.pop(extension, None)


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per line with its 1-based number and stripped text; other columns but `raw` stay."""
    rest = [c for c in files.columns if c != "raw"]
    # Stripped before the explode, so that filters on the text do not strip it again.
    stripped = F.transform(text.split_lines(F.col("raw")), text.strip)
    return files.where(F.coalesce(F.col("raw"), F.lit("")) != "").select(*rest, F.posexplode(stripped).alias("line", "text")).withColumn(
        "line", F.col("line") + 1)


_MARK = "\u0001"


def _one_pass(rules: list[tuple[str, str]]) -> tuple[str, str]:
    """All rules of a language as one alternation, and a replacement that writes down what each branch found.

    The first branch that matches wins, as the first rule does. (?U) is \\w over all letters.
    """
    branches, group, kept = [], 1, []
    for _, pattern in rules:
        branches.append(pattern)
        kept.append(group)
        group += re.compile(pattern).groups
    return "(?sU)^(?:" + "|".join(f"(?:{b})" for b in branches) + ").*", "".join(f"{_MARK}${g}" for g in kept)


def _marked(line: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule that matches from the start of the line, behind one mark for each rule up to it; the line is read once."""
    pattern, marks = _one_pass(rules)
    # A line that itself starts with the mark is no symbol.
    return F.when(~line.startswith(_MARK), F.regexp_replace(line, pattern, marks))


def _hit(marked: Column, kinds: Column) -> tuple[Column, Column]:
    """(kind, label) that a marked line tells."""
    rest = F.ltrim(marked, F.lit(_MARK))
    return F.get(kinds, F.length(marked) - F.length(rest) - 1), F.rtrim(rest, F.lit(_MARK))


def _kinds(rules: list[tuple[str, str]]) -> Column:
    return F.array(*[F.lit(kind) for kind, _ in rules])


def _by_language(languages: list[Language], of) -> Column:
    chain = F.when(F.col("language") == languages[0].name, of(languages[0]))
    return functools.reduce(lambda acc, lang: acc.when(F.col("language") == lang.name, of(lang)), languages[1:], chain)


def match_symbols(lines: DataFrame) -> DataFrame:
    """Add kind and label to lines of pattern languages; lines without a symbol are dropped."""
    languages = REGISTRY.rule_languages()
    marked = _by_language(languages, lambda lang: _marked(F.col("text"), lang.rules))
    # The generator keeps the match from being computed again for each use of it.
    found = lines.select("*", F.explode(F.array(marked)).alias("__m")).where(F.col("__m").startswith(_MARK))
    kind, label = _hit(F.col("__m"), _by_language(languages, lambda lang: _kinds(lang.rules)))
    return found.select(*lines.columns, kind.alias("kind"), label.alias("label"))


def _found_in(raw: Column, lang: Language, legacy_comments: bool) -> Column:
    """(kind, label, line) of every symbol of a text, in order; the language is chosen once a file and not once a line."""
    openers = filters.comment_openers(lang.name, legacy_comments)
    kinds = _kinds(lang.rules)

    def mark(line: Column, i: Column) -> Column:
        code = (line != "") & ~filters.opened_by(line, openers)
        return F.struct(F.when(code, _marked(line, lang.rules)).alias("m"), (i + 1).alias("line"))

    def symbol(x: Column) -> Column:
        kind, label = _hit(x["m"], kinds)
        return F.struct(kind.alias("kind"), label.alias("label"), x["line"].alias("line"))

    marked = F.transform(F.transform(text.split_lines(raw), text.strip), mark)
    return F.transform(F.filter(marked, lambda x: x["m"].startswith(_MARK)), symbol)


def extract_symbols(files: DataFrame, max_depth: int = 2, legacy_comments: bool = True) -> DataFrame:
    """Depth-2 symbol nodes of all pattern languages, at most one per line.

    `legacy_id` is the id by bare file name, under which equal files merge.
    """
    with_language = files.withColumn("language", filters.ext_to_language(F.col("ext")))
    found = _by_language(REGISTRY.rule_languages(), lambda lang: _found_in(F.col("raw"), lang, legacy_comments))
    symbols = with_language.select("language", "path", "name", "url", F.inline(found))
    nodes = symbols.select(
        F.concat_ws("::", "language", "path", "kind", "label", F.col("line").cast("string")).alias("id"),
        F.lit(2).alias("depth"), "language", "kind", "label",
        text.or_else(F.col("url"), F.col("name")).alias("file"), "line",
        F.create_map().cast("map<string,string>").alias("meta"),
        F.lit(None).cast("string").alias("shape"), F.lit(None).cast("string").alias("color"),
        F.concat(F.lit("file::"), F.col("path")).alias("file_id"),
        F.concat_ws("::", "language", "name", "kind", "label", F.col("line").cast("string")).alias("legacy_id"),
    )
    parts = [nodes] + [_filled(lang.nodes(with_language.where(F.col("language") == lang.name)), lang.name, nodes) for lang in REGISTRY.callable_languages()]
    return functools.reduce(lambda a, b: a.unionByName(b), parts).where(F.col("depth") <= max_depth)


def _filled(found: DataFrame, language: str, like: DataFrame) -> DataFrame:
    """Rows of a language function with the columns and types of `like`; what it leaves out takes a default."""
    default = {"depth": F.lit(2), "language": F.lit(language), "file": F.lit(""), "meta": F.create_map(), "legacy_id": F.col("id")}
    return found.select(*[
        (F.col(f.name) if f.name in found.columns else default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def languages_table(spark) -> DataFrame:
    """language -> sorted extensions."""
    return spark.createDataFrame(list(REGISTRY.languages().items()), "language string, extensions array<string>")


def _quoted(text_: str) -> str:
    """A SQL string literal, whatever escapes it holds."""
    return "r'" + text_.replace("'", "\\x{27}") + "'"


def register_sql_function(spark, name: str = "extract_symbols") -> None:
    """A table function for SQL users: SELECT s.* FROM files f, LATERAL extract_symbols(f.ext, f.raw) s.

    Its body is SQL over the same rules, lines and comment openers as the operator. It is one generator,
    which takes its place in the plan behind the files: a query inside would be joined back to them by
    their whole text. Returns (kind, label, line).
    """
    branches, kinds = [], []
    for lang in REGISTRY.rule_languages():
        pattern, marks = _one_pass(lang.rules)
        listed = ", ".join(_quoted(e) for e in lang.extensions)
        marks = marks.replace(_MARK, "\\u0001")
        branches.append(f"WHEN lower({name}.ext) IN ({listed}) THEN regexp_replace(l.text, {_quoted(pattern)}, '{marks}')")
        kinds.append(f"WHEN lower({name}.ext) IN ({listed}) THEN array({', '.join(_quoted(kind) for kind, _ in lang.rules)})")
    spaces = "".join(f"\\u{ord(c):04x}" for c in text.SPACES)
    enders = ", ".join(f"'\\u{ord(c):04x}'" for c in text.ENDERS)
    comment = " OR ".join(f"startswith(l.text, {_quoted(o)})" for o in L.COMMENT_OPENERS)
    raw = f"{name}.raw"
    body = f"CASE WHEN endswith({raw}, '\\r\\n') THEN left({raw}, length({raw}) - 2) WHEN right({raw}, 1) IN ({enders}) THEN left({raw}, length({raw}) - 1) ELSE {raw} END"
    lines = f"transform(split({body}, {_quoted(text.LINE_END)}), (piece, i) -> named_struct('text', btrim(piece, '{spaces}'), 'line', i + 1))"
    code = f"filter({lines}, l -> l.text <> '' AND NOT startswith(l.text, '\\u0001') AND NOT ({comment}))"
    marked = f"transform({code}, l -> named_struct('m', CASE {' '.join(branches)} END, 'line', l.line))"
    hits = f"filter({marked}, h -> startswith(h.m, '\\u0001'))"
    kind = f"get(CASE {' '.join(kinds)} END, length(h.m) - length(trim(LEADING '\\u0001' FROM h.m)) - 1)"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(ext STRING, raw STRING) RETURNS TABLE (kind STRING, label STRING, line INT) RETURN
        SELECT inline(transform({hits}, h -> named_struct('kind', {kind}, 'label', btrim(h.m, '\\u0001'), 'line', h.line)))""")
