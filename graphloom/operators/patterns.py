"""Sequence patterns: statements of a group written as one text, matched by regular expressions.

A statement is a short text such as ``i = 0`` or ``if i >= n goto out``; a group's statements in order, each ended by a
semicolon, are one string. Named groups bind values, and a second use of a name must be equal to the first:
back-references do that inside Spark's own matcher, so no Python runs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VAR, NUM = r"[A-Za-z_$][\w$]*", r"-?\d+"
VALUE = f"(?:{NUM}|{VAR})"
ANY = r"(?:[^;]*;)*?"
#: The same without jumps out of the loop.
STAY = r"(?:(?!(?:if [^;]* )?goto out;)[^;]*;)*?"
END = r"goto head;$"
ABOVE, BELOW, RELATED = "(?:>=|>)", "(?:<=|<)", "(?:==|!=|<=|>=|<|>)"


def _bind(name: str, what: str = VALUE) -> str:
    return f"(?<{name}>{what})"


_START, _STEP = f"{_bind('i', VAR)} = {_bind('from')};", rf"\k<i> = \k<i> [+-] {_bind('by')};"
_ZERO, _NEXT = f"{_bind('i', VAR)} = 0;", r"\k<i> = \k<i> \+ 1;"
_LENGTH = f"{_bind('n', VAR)} = length {_bind('over')};"
_SIZE = rf"{_bind('n', VAR)} = {_bind('over')}\.(?:size|length)\(\);"
_ELEMENT = rf"{VAR} = \k<over>\[\k<i>\];"
_EACH = rf"head:;if \k<i> >= \k<n> goto out;{_ELEMENT}{ANY}{_NEXT}{END}"

#: (kind, pattern), in order of priority; a kind may have two. ``head:`` stands before the loop's first statement,
#: ``out`` is what follows the loop. Names of the statements may stand before; the loop ends the text.
LOOPS = (
    ("iterator", rf"{_bind('it', VAR)} = {_bind('over')}\.iterator\(\);head:;{_bind('t', VAR)} = \k<it>\.hasNext\(\);if \k<t> == 0 goto out;(?:{VAR} = )?\k<it>\.next\(\);{ANY}{END}"),
    ("array_for_each", _LENGTH + _ZERO + _EACH),
    ("array_for_each", _ZERO + _LENGTH + _EACH),
    ("array_for", rf"{_ZERO}head:;{_LENGTH}if \k<i> >= \k<n> goto out;{ANY}{_ELEMENT}{ANY}{_NEXT}{END}"),
    ("count_up", rf"{_START}head:;if \k<i> {ABOVE} {_bind('bound')} goto out;{STAY}{_STEP}{END}"),
    ("count_down", rf"{_START}head:;if \k<i> {BELOW} {_bind('bound')} goto out;{STAY}{_STEP}{END}"),
    ("count_up_sized", rf"{_START}head:;{_SIZE}if \k<i> {ABOVE} \k<n> goto out;{ANY}{_STEP}{END}"),
    ("count_up_sized_offset", rf"{_START}head:;{_SIZE}{_bind('m', VAR)} = \k<n> [+-] {_bind('offset')};if \k<i> {ABOVE} \k<m> goto out;{ANY}{_STEP}{END}"),
    ("character", rf"{_START}head:;if \k<i> {ABOVE} {_bind('bound')} goto out;{STAY}{_bind('t', VAR)} = \k<i> [+-] {_bind('offset')};\k<i> = \(char\) \k<t>;{END}"),
    ("simple_while", rf"{_START}{ANY}head:;if \k<i> {RELATED} {_bind('bound')} goto out;{ANY}{_STEP}{ANY}{END}"),
    ("count_up_var", rf"{_START}head:;{_bind('n', VAR)} = {_bind('bound')};if \k<i> {ABOVE} \k<n> goto out;{STAY}{_STEP}{END}"),
    ("count_down_var", rf"{_START}head:;{_bind('n', VAR)} = {_bind('bound')};if \k<i> {BELOW} \k<n> goto out;{STAY}{_STEP}{END}"),
    ("randomized_while", rf"{_bind('n', VAR)} = {_bind('from')};if {_bind('i', VAR)} {RELATED} \k<n> goto head;{_bind('r', VAR)} = (?:{VAR}\.)?(?:random|nextInt|nextDouble)\([^;]*\);{_bind('t', VAR)} = cmpg\(\k<r>, {_bind('bound')}\);if \k<t> {ABOVE} 0 goto head;$"),
    ("do_while", rf"{_START}{ANY}head:;{ANY}{_STEP}{ANY}if \k<i> {RELATED} {_bind('bound')} goto head;$"),
)
BINDINGS = ("it", "over", "i", "n", "from", "bound", "by", "offset", "r")


def written(rows: DataFrame, group: Sequence[str], order: Sequence[str], text: str | Column) -> DataFrame:
    """(group, text): the group's statements in order, each ended by a semicolon."""
    part = F.struct(*order, (F.col(text) if isinstance(text, str) else text).alias("_text"))
    listed = F.transform(F.array_sort(F.collect_list(part)), lambda x: F.concat(x["_text"], F.lit(";")))
    return rows.groupBy(*group).agg(F.array_join(listed, "").alias("text"))


def matched(texts: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Rows whose text the pattern matches somewhere."""
    return texts.where(F.col(text).rlike(pattern))


def bound(text: Column, pattern: str, names: Sequence[str]) -> Column:
    """A map of the names that the pattern binds to what they are bound to; all its capturing groups have names."""
    place = {name: i + 1 for i, name in enumerate(re.findall(r"\(\?<([A-Za-z]\w*)>", pattern))}
    pairs = [x for n in names if n in place for x in (F.lit(n), F.regexp_extract(text, pattern, place[n]))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def classify_loops(texts: DataFrame, text: str = "text", patterns: Sequence[tuple[str, str]] = LOOPS) -> DataFrame:
    """``texts`` with n_matches, the number of kinds that match, loop_kind and bindings.

    The kind is that of the first pattern that matches, whatever the later ones say; where none does it is
    unidentified, with no bindings.
    """
    t = F.col(text)
    anchored = [(k, f"(?:^|;){p}") for k, p in patterns]
    hits = F.array_compact(F.array(*[F.when(t.rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(i).alias("at"))) for i, (k, p) in enumerate(anchored)]))
    out = texts.withColumn("_hits", hits).withColumn("_first", F.get("_hits", F.lit(0)))
    bindings = F.lit(None).cast("map<string,string>")
    for i, (_, p) in enumerate(anchored):
        bindings = F.when(F.col("_first.at") == i, bound(t, p, BINDINGS)).otherwise(bindings)
    n = F.size(F.array_distinct(F.transform("_hits", lambda h: h["kind"])))
    return out.withColumn("loop_kind", F.coalesce("_first.kind", F.lit("unidentified"))).withColumn("bindings", bindings).withColumn("n_matches", n).drop("_hits", "_first")


def operands(classified: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, name, value): what the loops' patterns bound."""
    return classified.select(*group, F.explode(F.map_filter("bindings", lambda k, v: v != "")).alias("name", "value"))


def encoded(rows: DataFrame, group: Sequence[str], order: Sequence[str], symbol: Column) -> DataFrame:
    """(group, text): one character an event, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, symbol.alias("_s")))), lambda x: x["_s"])
    return rows.groupBy(*group).agg(F.array_join(listed, "").alias("text"))
