"""Scalar functions over program names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the class-file format: (bit, word). Public is bit 0 and printed last.
FLAGS = ((1, "private"), (2, "protected"), (3, "static"), (4, "final"), (5, "synchronized"), (6, "volatile"), (7, "transient"), (8, "native"), (9, "interface"), (10, "abstract"), (11, "strict"), (12, "synthetic"), (13, "annotation"), (14, "enum"), (0, "public"))
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def dotted(name: Column) -> Column:
    """A class name with dots, without ``.class``."""
    return F.replace(F.regexp_replace(name, r"\.class$", ""), F.lit("/"), F.lit("."))


def access_words(flags: Column) -> Column:
    """The words of an access bit mask, with a space between them."""
    return F.array_join(F.array_compact(F.array(*[F.when(flags.bitwiseAND(1 << bit) != 0, word) for bit, word in FLAGS])), " ")


def array_depth(descriptor: Column) -> Column:
    return F.length(F.regexp_extract(descriptor, r"^(\[*)", 1))


def type_name(descriptor: Column) -> Column:
    """``int[][]`` for ``[[I``, ``java.lang.String`` for ``Ljava/lang/String;``."""
    base = F.regexp_replace(descriptor, r"^\[+", "")
    known = F.create_map(*[F.lit(x) for pair in PRIMITIVES.items() for x in pair])
    named = F.when(F.startswith(base, F.lit("L")), F.replace(F.regexp_extract(base, r"^L([^;]*);$", 1), F.lit("/"), F.lit("."))).otherwise(known[base])
    return F.concat(named, F.repeat(F.lit("[]"), array_depth(descriptor)))


def method_key(cls: Column, ret: Column, name: Column, params: Column) -> Column:
    """``Class Ret name(A,B)`` with dots for dollars."""
    return F.translate(F.concat(cls, F.lit(" "), ret, F.lit(" "), name, F.lit("("), F.array_join(params, ","), F.lit(")")), "$", ".")


def package_of(name: Column) -> Column:
    return F.regexp_replace(name, r"(^|\.)[^.]*$", "")


def field_id(cls: Column, field: Column) -> Column:
    return F.concat_ws(":", cls, field)


def text_hash(text: Column, seed: int = 98764321261) -> Column:
    """The hash of the text's UTF-16 units by multiplication with 31, a long that wraps around at 64 bits."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(?s).{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("decimal(38,0)"))
    whole = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    # In decimals below 2 ** 64, as a product of longs would overflow.
    last = F.aggregate(units, whole(seed % 2**64), lambda h, u: ((h * 31 + u) % whole(2**64)).cast("decimal(38,0)"))
    return F.when(last >= whole(2**63), last - whole(2**64)).otherwise(last).cast("long")


def pairs(body: Column) -> Column:
    """The map of ``k=v`` records with tabs between; ``<null>`` is null."""
    return F.transform_values(F.str_to_map(body, F.lit("\t"), F.lit("=")), lambda k, v: F.nullif(v, F.lit("<null>")))


def listed(text: Column) -> Column:
    """The parts of a list with colons, empty ones left out."""
    return F.filter(F.split(text, ":"), lambda x: x != "")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, F.format_string("%1.2f", 100.0 * part / whole)).otherwise("0.00")


def duration(seconds: Column) -> Column:
    """``1h 02m 03s``."""
    s = seconds.cast("long")
    return F.format_string("%dh %02dm %02ds", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def dot_text(text: Column) -> Column:
    """A text escaped for a label of a DOT graph."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def tokens(code: Column) -> Column:
    """array of struct(token, class): words, numbers, strings, comments, brackets, semicolons in a line of code."""
    words = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split()
    found = F.regexp_extract_all(code, F.lit(r'//.*|/\*.*?\*/|"(?:[^"\\]|\\.)*"|\b\w+\b|[()]|[{}]|[\[\]]|;'), F.lit(0))
    kind = lambda t: F.when(t.rlike(r"^/[/*]"), "comment").when(t.rlike('^"'), "string").when(t.isin(*words), "keyword").when(t.isin("(", ")"), "paren").when(t.isin("{", "}"), "brace").when(t.isin("[", "]"), "bracket").when(t == ";", "semicolon").otherwise("other")
    return F.transform(found, lambda t: F.struct(t.alias("token"), kind(t).alias("kind")))


def jvm_type(name: Column) -> Column:
    """The type's name within an array's: ``Ljava.lang.String;`` for a class, a letter for a primitive."""
    letters = F.create_map(*[F.lit(x) for letter, word in PRIMITIVES.items() for x in (word, letter)])
    return F.coalesce(letters[name], F.concat(F.lit("L"), name, F.lit(";")))


def nested(name: Column) -> Column:
    """Whether a class is one within another."""
    return F.contains(name, F.lit("$"))


def core_java(name: Column) -> Column:
    """Whether a class belongs to Java's own packages."""
    return F.concat(package_of(name), F.lit(".")).rlike(r"^(java|javax|sun|com\.sun)\.")
