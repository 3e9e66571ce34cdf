"""The pipeline: its stages' contract, and each stage's decisions."""

import corpus_pipeline
from graphloom.llm import catalog

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        n = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0 < n <= before
        before = n
    assert docs.columns == ["doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots"]
    assert sorted(map(str, docs.collect())) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "mix"]
    assert sorted(int(k[2:].split("_")[0]) for k in catalog.QUERIES) == list(range(1, 14))


def test_exact_copies_and_leaks_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = docs.where("doc_id = 3").first()
    more = spark.createDataFrame([(9001, clean.text, clean.lang, clean.source, clean.n_chars), (9002, "words before it " + item, "en", "src1", 1), (9003, "1234 !!", "en", "src1", 1)], docs.schema)
    now = docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
    ids = {r.doc_id for r in now.select("doc_id").collect()}
    assert not ids & {9001, 9002, 9003} and 3 in ids


def test_near_copies_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one = docs.where("doc_id = 3").first()
    words = " ".join(one.text.split()[:100]).split()
    changed = " ".join([*words[:40], "elsewhere", *words[41:]])
    both = spark.createDataFrame([(1, " ".join(words), "en", "s", 1), (2, changed, "en", "s", 1)], docs.schema)
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, both, SF).collect()] == [1]


def test_stages_on_odd_tables(spark):
    """No rows, nulls in every column, repeated rows, and extra columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_lines string, n_removed string, `_text` string, `doc.x` string"
    none = spark.createDataFrame([], schema)
    rows = [(None,) * 8, (1, None, None, None, "a", "b", "c", "d"), (2, "some words of a text here", "en", "s", "a", "b", "c", "d"), (2, "some words of a text here", "en", "s", "a", "b", "c", "d"), (3, "", "en", "s", "a", "b", "c", "d")]
    odd = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none, SF).count() == 0
        kept = stage(spark, odd, SF)
        assert kept.columns == odd.columns
        found = {tuple(r) for r in kept.collect()}
        assert rows[2] in found and found <= set(rows)
    assert corpus_pipeline.mix(spark, none, SF).count() == 0 and corpus_pipeline.mix(spark, odd, SF).count() == 5
