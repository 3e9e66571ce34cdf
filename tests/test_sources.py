"""Sources: class files compiled here, archives, record sets, text formats, and the loop graph of a real program."""

import shutil
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.operators import loops, program, reach
from graphloom.sources import classfiles, packets, text

JAVA = """
package demo;
public class Main {
  static int total;
  interface Shape { int area(int n); }
  static class Box implements Shape { public int area(int n) { int s = 0; for (int i = 0; i < n; i++) s += i; return s; } }
  static class Dot implements Shape { public int area(int n) { return n; } }
  static int sum(int[] a) { int s = 0; for (int x : a) { int k = x; while (k > 0) { s += k; k--; } } return s; }
  static int pick(int n) { switch (n) { case 1: return 10; case 2: return 20; default: throw new IllegalStateException(); } }
  static int fact(int n) { return n < 2 ? 1 : n * fact(n - 1); }
  static int twice(int k) { java.util.function.IntUnaryOperator f = n -> n * k; return f.applyAsInt(2); }
  public static void main(String[] args) {
    Shape s = args.length > 0 ? new Box() : new Dot();
    try { total = s.area(3) + sum(new int[] {1, 2}) + pick(1) + fact(4); } catch (IllegalStateException e) { total = -1; }
  }
}
"""


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def jar(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no javac")
    top = tmp_path_factory.mktemp("java")
    (top / "Main.java").write_text(JAVA)
    subprocess.run(["javac", "-d", str(top / "out"), str(top / "Main.java")], check=True)
    (top / "lib").mkdir()
    inner = top / "inner.jar"
    with zipfile.ZipFile(inner, "w") as z:
        for f in (top / "out").rglob("*.class"):
            z.write(f, f.relative_to(top / "out"))
    with zipfile.ZipFile(top / "lib" / "app.jar", "w") as z:
        z.writestr("META-INF/MANIFEST.MF", "Manifest-Version: 1.0\r\nMain-Class: demo.Main\r\n")
        z.write(inner, "inner.jar")
    return str(top / "lib")


@pytest.fixture(scope="module")
def facts(spark, jar):
    found = classfiles.entries(classfiles.scan(spark, jar))
    return found, classfiles.facts(found)


def test_archives_and_mains(spark, facts):
    found, f = facts
    mains = classfiles.main_classes(found)
    assert [r.main_class for r in mains.collect()] == ["demo.Main"]
    assert classfiles.app(mains, "demo").first().main_method == "main"
    assert rows(classfiles.mains(f["method"]), "class") == [("demo.Main",)]
    assert rows(f["class"], "name") == [("demo.Main",), ("demo.Main$Box",), ("demo.Main$Dot",), ("demo.Main$Shape",)]
    assert ("demo.Main", "total", True) in rows(f["field"], "class", "name", "is_static")


def test_program_graphs(spark, facts):
    _, f = facts
    flow = program.flow_edges(f["stmt"]).withColumn("g", F.col("method")).select("method", "src", "dst")
    roots = f["stmt"].groupBy("method").agg(F.min("idx").alias("node"))
    dom = loops.dominators(flow, roots, ["method"])
    bodies = loops.natural_loops(flow, loops.back_edges(flow, dom, ["method"]), ["method"])
    forest = loops.loop_forest(bodies, ["method"])
    per = {r.method.split("(")[0]: r.n for r in forest.groupBy("method").agg(F.count("*").alias("n")).collect()}
    assert per == {"demo.Main$Box.area": 1, "demo.Main.sum": 2}
    assert rows(forest.where("depth = 1"), "n_members")  # the inner loop of sum
    sub = program.subtypes(program.supers(f["class"]))
    targets = program.cha_targets(f["call"].select("method", "idx", "class", "subsig", "kind"), f["method"].select("class", "subsig"), sub)
    area = rows(targets.where("subsig like 'area%'"), "target")
    assert ("demo.Main$Box",) in area and ("demo.Main$Dot",) in area
    calls = targets.select("method", F.col("idx").alias("stmt"), F.concat("target", F.lit("."), "subsig").alias("callee"))
    main = classfiles.mains(f["method"]).select(F.col("method_id").alias("method"))
    graph = loops.loop_graph(calls, bodies, forest.withColumn("parent", F.col("parent").cast("string")), main)
    got = {(r.src.method.split("(")[0], r.src.head is None, r.dst.method.split("(")[0], r.dst.head is None) for r in graph.collect()}
    assert ("demo.Main.main", True, "demo.Main.sum", True) in got and ("demo.Main.sum", True, "demo.Main.sum", False) in got and ("demo.Main.sum", False, "demo.Main.sum", False) in got
    own = calls.select(F.col("method").alias("src"), F.col("callee").alias("dst"))
    assert [r.node.split("(")[0] for r in reach.self_recursive(own).collect()] == ["demo.Main.fact"]
    made = f["lambda"].first()
    assert (made.interface, made.subsig, made.captures) == ("java.util.function.IntUnaryOperator", "applyAsInt(I)I", ["I"]) and made.impl.startswith("demo.Main.lambda$twice$0")
    traps = f["trap"]
    assert rows(traps, "exception") == [("java.lang.IllegalStateException",)]


def test_record_sets(spark, tmp_path):
    edges = spark.createDataFrame([(1, 1, 2)], "id long, src long, dst long")
    packets.write({"state_edge": edges}, str(tmp_path / "a"))
    packets.write({"state_edge": edges}, str(tmp_path / "b"))
    both = packets.read(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert both["state_edge"].count() == 2
    assert packets.lines(both).first().line == "edge-1 1 -> 2"
    with pytest.raises(packets.WrongFormat):
        packets.write({"state_edge": edges.withColumn("more", F.lit(1))}, str(tmp_path / "c"))
    spark.createDataFrame([("{}",)], "value string").write.text(str(tmp_path / "d" / "_manifest_"))
    with pytest.raises(packets.WrongFormat):
        packets.read(spark, str(tmp_path / "d"))
    assert packets.dot(spark.createDataFrame([('a"b', "c")], "src string, dst string")).first().line == '  "a\\"b" -> "c";'


def test_text_sources(spark, tmp_path):
    (tmp_path / "snap").write_text("static field: class=A\tfield=f\ttype=I\tvalue=<null>\narray element: array=7\ttype=I\tindex=2\telement=5\nother: x=1\n")
    snap = text.snapshot(spark, str(tmp_path / "snap"))
    assert rows(snap["snap_static_field"], "class", "field") == [("A", "f")] and snap["snap_static_field"].first().value is None
    assert rows(snap["snap_array_element"], "array", "index", "element") == [(7, 2, "5")]
    (tmp_path / "lib").write_text("# core\njava.\n\njavax.\n")
    prefixes = text.library_prefixes(spark, str(tmp_path / "lib"))
    classes = spark.createDataFrame([("java.lang.X",), ("my.Y",)], "name string")
    assert rows(text.matches_prefix(classes, prefixes), "name", "is_library") == [("java.lang.X", True), ("my.Y", False)]
    (tmp_path / "rules").write_text("+^a\n-b\nnote\n")
    assert rows(text.rules(spark, str(tmp_path / "rules")), "include", "pattern") == [(False, "b"), (True, "^a")]


def test_streaming_store(spark, tmp_path):
    from graphloom.streaming.store import grow

    source, store, news, checkpoint = (str(tmp_path / x) for x in ("in", "store", "news", "cp"))
    schema = "addr string, value string"
    for batch in ([("a", "1"), ("b", "1")], [("a", "1"), ("a", "2")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        grow(spark.readStream.schema(schema).parquet(source), store, news, checkpoint).awaitTermination()
    assert rows(spark.read.parquet(store), "addr", "value") == [("a", "1"), ("a", "2"), ("b", "1")]
    assert spark.read.parquet(news).groupBy("batch").count().count() == 2
