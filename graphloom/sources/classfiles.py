"""Class and archive files as fact tables: the scan, archives opened, class files decoded.

Decoding is a small per-file helper; all analysis of what it yields is done by joins.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE = b"PK\x03\x04"
MAGIC = b"\xca\xfe\xba\xbe"


def scan(spark: SparkSession, path: str, origin: str = "APP") -> DataFrame:
    """(path, root, origin, data) of the .class and .jar files in a folder and below; archives must be archives."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    found = files.where(F.lower("path").rlike(r"\.(class|jar)$")).select("path", F.lit(path).alias("root"), F.lit(origin).alias("origin"), F.col("content").alias("data"))
    whole = F.lower("path").endswith(".class") | (F.substring("data", 1, 4) == F.lit(bytearray(ARCHIVE)))
    return found.withColumn("data", F.when(whole, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("not an archive: "), F.col("path"))).cast("binary")))


def _opened(path: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """The entries of an archive, and of archives in it."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for entry in archive.infolist():
            if entry.is_dir():
                continue
            name, body = f"{path}!{entry.filename}", archive.read(entry)
            if entry.filename.lower().endswith((".jar", ".zip")) and body[:4] == ARCHIVE:
                yield from _opened(name, body)
            else:
                yield name, body


def entries(elements: DataFrame) -> DataFrame:
    """(path, root, origin, data): class files and manifests, those in archives (nested ones, too) and plain ones."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for row in part.itertuples(index=False):
                data = bytes(row.data)
                opened = _opened(row.path, data) if data[:4] == ARCHIVE else iter([(row.path, data)])
                for name, body in opened:
                    if name.endswith((".class", "META-INF/MANIFEST.MF")):
                        yield pd.DataFrame({"path": [name], "root": [row.root], "origin": [row.origin], "data": [body]})

    return elements.select("path", "root", "origin", "data").mapInPandas(explode, "path string, root string, origin string, data binary")


def main_classes(found: DataFrame) -> DataFrame:
    """(path, main_class): the archives' manifests' Main-Class."""
    text = F.regexp_replace(F.col("data").cast("string"), "\r?\n ", "")
    main = F.regexp_extract(text, r"(?m)^Main-Class:\s*(\S+)", 1)
    return found.where(F.col("path").endswith("META-INF/MANIFEST.MF")).select(F.regexp_replace("path", "![^!]*$", "").alias("path"), main.alias("main_class")).where("main_class <> ''")


def app(mains: DataFrame, name: str, main_class: str | None = None, main_method: str = "main", packages: tuple[str, ...] = ()) -> DataFrame:
    """One row of app: the main class given, else the only one detected, else null."""
    only = F.when(F.count_distinct("main_class") == 1, F.min("main_class"))
    chosen = F.coalesce(F.lit(main_class).cast("string"), only)
    return mains.agg(chosen.alias("main_class")).select(F.lit(name).alias("name"), "main_class", F.when(F.col("main_class").isNotNull(), main_method).alias("main_method"), F.array(*[F.lit(p) for p in packages]).cast("array<string>").alias("app_packages"))


#: Instruction lengths by ranges of opcodes; all others take one byte. Fixed values of the class-file format.
LENGTHS = ((0x10, 0x10, 2), (0x11, 0x11, 3), (0x12, 0x12, 2), (0x13, 0x14, 3), (0x15, 0x19, 2), (0x36, 0x3A, 2), (0x84, 0x84, 3), (0x99, 0xA8, 3), (0xA9, 0xA9, 2), (0xB2, 0xB8, 3), (0xB9, 0xBA, 5), (0xBB, 0xBB, 3), (0xBC, 0xBC, 2), (0xBD, 0xBD, 3), (0xC0, 0xC1, 3), (0xC5, 0xC5, 4), (0xC6, 0xC7, 3), (0xC8, 0xC9, 5))
INVOKES = {0xB6: "virtual", 0xB7: "special", 0xB8: "static", 0xB9: "interface"}
SIZE = [next((n for a, b, n in LENGTHS if a <= op <= b), 1) for op in range(256)]


class _Reader:
    """A class file's bytes with a place, and its constants."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0
        if data[:4] != MAGIC:
            raise ValueError("not a class file")
        self.at = 8
        self.constants: list = [None]
        n = self.take("H")
        while len(self.constants) < n:
            tag = self.take("B")
            if tag == 1:
                size = self.take("H")
                self.constants.append(self.data[self.at : self.at + size].decode("utf-8", "replace"))
                self.at += size
            else:
                form = {3: "i", 4: "f", 5: "q", 6: "d", 15: "BH"}.get(tag, "H" if tag in (7, 8, 16, 19, 20) else "HH")
                self.constants.append(self.take(form))
                self.constants += [None] * (tag in (5, 6))

    def take(self, form: str):
        values = struct.unpack_from(">" + form, self.data, self.at)
        self.at += struct.calcsize(">" + form)
        return values[0] if len(values) == 1 else values

    def name(self, i: int) -> str | None:
        return self.constants[self.constants[i]].replace("/", ".") if i else None

    def member(self, i: int) -> tuple[str, str, str]:
        """(class, name, descriptor) that a reference stands for."""
        cls, nat = self.constants[i]
        name, desc = self.constants[nat]
        return self.name(cls), self.constants[name], self.constants[desc]

    def attributes(self) -> dict[str, tuple[int, int]]:
        """Name to place and size, and the place moves past them."""
        out = {}
        for _ in range(self.take("H")):
            name, size = self.take("HI")
            out[self.constants[name]] = (self.at, size)
            self.at += size
        return out


def _code(r: _Reader, at: int, method: str, out: dict[str, list]) -> None:
    """Instructions, calls and traps of one body; an instruction's idx is its offset."""
    r.at = at + 4
    size = r.take("I")
    base, pc = r.at, 0
    while pc < size:
        op, here = r.data[base + pc], pc
        targets, default, kind = None, None, "other"
        if op == 0xAA or op == 0xAB:
            r.at = base + pc + 4 - pc % 4
            start = r.take("i")
            default = here + start
            if op == 0xAA:
                low, high = r.take("ii")
                targets = [here + r.take("i") for _ in range(high - low + 1)]
            else:
                targets = [here + r.take("ii")[1] for _ in range(r.take("i"))]
            kind, step = "switch", r.at - base - pc
        else:
            step = SIZE[op]
            if op == 0xC4:
                step = 6 if r.data[base + pc + 1] == 0x84 else 4
            if 0x99 <= op <= 0xA6 or 0xC6 <= op <= 0xC7:
                kind, targets = "if", [here + struct.unpack_from(">h", r.data, base + pc + 1)[0]]
            elif op in (0xA7, 0xC8):
                kind, targets = "goto", [here + struct.unpack_from(">h" if op == 0xA7 else ">i", r.data, base + pc + 1)[0]]
            elif 0xAC <= op <= 0xB1:
                kind = "return_void" if op == 0xB1 else "return"
            elif op == 0xBF:
                kind = "throw"
            elif op in INVOKES:
                kind = "invoke"
                cls, name, desc = r.member(struct.unpack_from(">H", r.data, base + pc + 1)[0])
                out["call"].append((method, here, cls, name + desc, INVOKES[op]))
            elif op == 0xBA:
                kind = "invoke"
                at, nat = r.constants[struct.unpack_from(">H", r.data, base + pc + 1)[0]]
                name, desc = (r.constants[k] for k in r.constants[nat])
                out["lambda"].append((method, here, at, name, desc))
        out["stmt"].append((method, here, kind, targets, default))
        pc += step
    r.at = base + size
    for i in range(r.take("H")):
        begin, end, handler, caught = r.take("HHHH")
        out["trap"].append((method, i, begin, end, handler, r.name(caught) or "java.lang.Throwable"))


def decode(data: bytes) -> dict[str, list[tuple]]:
    """The rows of class, field, method, stmt, call, trap and lambda of one class file."""
    r = _Reader(data)
    access, this, above, n = r.take("HHHH")
    cls = r.name(this)
    out: dict[str, list] = {"class": [(cls, r.name(above), [r.name(r.take("H")) for _ in range(n)], access)], "field": [], "method": [], "stmt": [], "call": [], "trap": [], "lambda": []}
    for what in ("field", "method"):
        for _ in range(r.take("H")):
            flags, name, desc = r.take("HHH")
            name, desc = r.constants[name], r.constants[desc]
            held = r.attributes()
            if what == "field":
                out["field"].append((cls, name, desc, flags))
                continue
            method = f"{cls}.{name}{desc}"
            out["method"].append((method, cls, name, desc, name + desc, flags))
            if "Code" in held:
                back = r.at
                _code(r, held["Code"][0], method, out)
                r.at = back
    held = r.attributes()
    made = []
    if "BootstrapMethods" in held:
        r.at = held["BootstrapMethods"][0]
        made = [(r.take("H"), [r.take("H") for _ in range(r.take("H"))]) for _ in range(r.take("H"))]
    out["lambda"] = [x for x in (_lambda(r, made, *row) for row in out["lambda"]) if x]
    return out


def _lambda(r: _Reader, made: list, method: str, at: int, which: int, name: str, desc: str) -> tuple | None:
    """(method, idx, interface, interface method, implementation, captured types) of a call site that makes a lambda."""
    handle, args = made[which]
    cls, factory, _ = r.member(r.constants[handle][1])
    if cls != "java.lang.invoke.LambdaMetafactory" or factory not in ("metafactory", "altMetafactory"):
        return None
    owner, impl, impl_desc = r.member(r.constants[args[1]][1])
    captured, _, made_type = desc[1:].rpartition(")")
    types = re.findall(r"\[*(?:L[^;]*;|[BCDFIJSZ])", captured)
    return method, at, made_type[1:-1].replace("/", "."), name + r.constants[r.constants[args[0]]], f"{owner}.{impl}{impl_desc}", types


_ROWS = {
    "class": "name string, super_name string, interfaces array<string>, access int",
    "field": "class string, name string, descriptor string, access int",
    "method": "method_id string, class string, name string, descriptor string, subsig string, access int",
    "stmt": "method string, idx int, kind string, targets array<int>, default_target int",
    "call": "method string, idx int, class string, subsig string, kind string",
    "trap": "method string, ord int, begin_idx int, end_idx int, handler_idx int, exception string",
    "lambda": "method string, idx int, interface string, subsig string, impl string, captures array<string>",
}


def facts(found: DataFrame) -> dict[str, DataFrame]:
    """The fact tables of class files (path, origin, data): each file is decoded once, into a row of arrays."""
    from graphloom.plans.checkpoint import stored

    schema = "path string, origin string, " + ", ".join(f"`{k}` array<struct<{', '.join(f'`{p.split()[0]}`:{p.split()[1]}' for p in v.split(', '))}>>" for k, v in _ROWS.items())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {k: [p.split()[0] for p in v.split(", ")] for k, v in _ROWS.items()}
        for part in batches:
            rows = []
            for row in part.itertuples(index=False):
                got = decode(bytes(row.data))
                rows.append({"path": row.path, "origin": row.origin} | {k: [dict(zip(names[k], x)) for x in got[k]] for k in _ROWS})
            yield pd.DataFrame(rows, columns=["path", "origin", *_ROWS])

    rows = found.where(F.col("path").endswith(".class")).select("path", "origin", "data").mapInPandas(read, schema)
    rows = stored(rows, "class-facts")
    out = {k: rows.select("origin", F.explode(F.col(f"`{k}`")).alias("r")).select("r.*", "origin") for k in _ROWS}
    bit = lambda n: F.col("access").bitwiseAND(1 << n) != 0
    out["method"] = out["method"].withColumns({"is_static": bit(3), "is_native": bit(8), "is_abstract": bit(10)})
    out["field"] = out["field"].withColumn("is_static", bit(3))
    return out


def mains(methods: DataFrame, lenient: bool = False) -> DataFrame:
    """Methods that can start a program: public and static, called main, of one array of strings; either flag if lenient."""
    bits = F.col("access").bitwiseAND(0b1001)
    return methods.where((F.col("name") == "main") & (F.col("descriptor") == "([Ljava/lang/String;)V") & (bits != 0 if lenient else bits == 0b1001))
