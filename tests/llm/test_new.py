"""The filter audit, the Merkle manifest and the suffix dedup against plain versions."""

import hashlib
import itertools
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from graphloom.llm import catalog, filteraudit, licenses, merkle, suffixdedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# The filter audit


def plain_audit(docs, labels):
    ids = {}
    for i, text, *_ in docs:
        if i is not None:
            ids[text or ""] = min(ids.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1}
    bad = {i for i, _, t in labels if t == 1}
    rows = []
    for i, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": i is not None and ids.get(text, i) < i,
        }
        rows.append((lang or "", fails, i in good, i in bad))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                gone = [any(f[y] for y in order[:k]) for _, f, _, _ in own]
                here = [r for r, g in zip(own, gone) if r[1][x] and not g]
                shapley[x] += len(here)
                out[part, "".join(order), k + 1] = [
                    sum(not g and not r[1][x] for r, g in zip(own, gone)), len(here), sum(g and r[1][x] for r, g in zip(own, gone)),
                    sum(r[1][x] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in here), sum(r[3] for r in here), x,
                ]
        for key, row in out.items():
            if key[0] == part:
                out[key] = [*row[:6], shapley[row[6]]]
    return out


def audited(spark, docs, labels):
    found = filteraudit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}


def test_audit_like_plain_counts(spark, words):
    rng = random.Random(11)
    texts = [None, "", "A", "short $", " ".join(rng.choice(words) for _ in range(150)), " ".join(words[:120]), " ".join(words[:120]).upper(), " ".join(words[:3]) * 200, "a\tb\x0bc\x0cd\re\nf " * 20, "é" * 50 + "ABC"]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "en", "de"]), None, None) for _ in range(200)]
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    assert audited(spark, docs, labels) == plain_audit(docs, labels)


def test_audit_of_nothing_and_of_long_texts(spark):
    assert audited(spark, [], []) == {}
    long = "word " * 400_000 + "X"
    found = audited(spark, [(1, long, "en", None, None), (2, long, "en", None, None)], [(2, 1, 1)])
    assert found["en", "ABCDE", 5] == [0, 0, 1, 0, 0, 0, 60]
    assert found["en", "EABCD", 1] == [1, 1, 0, 0, 1, 1, 120 // 2]


def test_audit_ignores_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", "en", 5, "x")], "doc_id long, text string, lang string, mask int, part string")
    labels = spark.createDataFrame([(1, 1, 0, 3)], "doc_id long, quality int, toxic int, first int")
    assert filteraudit.audit(docs, labels).where("removed > 0").count() > 0


# The Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 16])) for i in range(0, len(last), 16)])
    return levels


def plain_sides(levels, i):
    out = []
    for level in levels[:-1]:
        run = i // 16 * 16
        out.append(("".join(level[run:i]), "".join(level[i + 1 : run + 16])))
        i //= 16
    return out


def plain_verify(docs):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    groups = {}
    for i, text, lang, source, n in docs:
        leaf = plain_leaf(i, source, lang, n, text)
        bad = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        groups.setdefault(source, []).append((i is not None, i or 0, leaf, i, plain_leaf(i, source, lang, n, text and text.translate(lower)) if bad else leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([r[2] for r in sorted(groups[s])]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, doc, start) in enumerate(sorted(groups[s])):
            sides, acc = plain_sides(trees[s], i) + plain_sides(top, k), start
            for left, right in sides:
                acc = sha(left + acc + right)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in sides)), acc, acc == top[-1][0]))
    return sorted(out, key=repr)


def verified(spark, docs):
    return sorted(map(tuple, merkle.verify(spark.createDataFrame(docs, DOCS)).collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [17], [1, 16, 17, 33, 300], [2] * 20, [4200, 3]])
def test_manifest_like_plain_trees(spark, sizes):
    rng = random.Random(sum(sizes))
    sources = [None, "", "a", "B", "é", "𐀀", "￿", *(f"s{k}" for k in range(30))][: len(sizes)]
    docs = [(None if rng.random() < 0.02 else rng.randrange(10**6), rng.choice([None, "", "Some TEXT", "é" * 9, "plain"]), rng.choice([None, "en"]), s, rng.choice([None, 7])) for s, n in zip(sources, sizes) for _ in range(n)]
    docs += docs[:5]
    rng.shuffle(docs)
    assert verified(spark, docs) == plain_verify(docs)


def test_tampering_shows(spark):
    docs = [(i, "Text With Capitals", "en", "a", 18) for i in range(500)]
    found = verified(spark, docs)
    bad = {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert bad and {r[0] for r in found if not r[6]} == bad


def test_manifest_of_nothing_of_long_texts_and_other_columns(spark):
    assert verified(spark, []) == []
    docs = [(1, "Long " * 300_000, None, None, None)]
    assert verified(spark, docs) == plain_verify(docs)
    more = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS idx", "2 AS part", "3 AS leaf", "4 AS n", "5 AS path")
    assert len(merkle.verify(more).collect()) == 1


# The suffix dedup


def plain_dedup(docs, width=100):
    seen, out = set(), []
    for i, text in sorted(docs, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - width + 1):
            s = raw[p : p + width]
            if s in seen:
                gone[p : p + width] = True
            seen.add(s)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        out.append((i, len(raw), [tuple(e) for e in edges.reshape(-1, 2).tolist()], bytes(np.frombuffer(raw, np.uint8)[~gone])))
    return out


def deduped(spark, docs, **settings):
    found = suffixdedup.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **settings).collect()
    return sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found)


def passages(rng, words, n):
    parts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(12)] + ["é" * 40, "ab" * 80, "x" * 300, "aab" * 50]
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            text = rng.choice([None, "", "short"])
        elif kind < 0.2 and docs:
            text = rng.choice(docs)[1]
        else:
            text = "".join(rng.choice([rng.choice(parts), rng.choice(parts)[rng.randint(0, 40) :], " ".join(rng.choice(words) for _ in range(20))]) for _ in range(rng.randint(1, 6)))
        docs.append((rng.randrange(10**9) - 10**8, text))
    return list({d[0]: d for d in docs}.values())


@pytest.mark.parametrize("seed", range(3))
def test_dedup_like_all_strings(spark, words, seed):
    docs = passages(random.Random(seed), words, 80)
    assert deduped(spark, docs) == plain_dedup(docs)


def test_dedup_with_common_grams_by_class(spark, words):
    rng = random.Random(5)
    docs = [(i, rng.choice(words) * 9 + "-" * rng.randint(0, 9) + "the same passage of over a hundred bytes, which very many of the documents have, amid words that differ" + rng.choice(["", "!"]) + rng.choice(words) * 9) for i in range(300)]
    assert deduped(spark, docs, least_common=1) == plain_dedup(docs) == deduped(spark, docs)


def test_dedup_of_runs_at_edges(spark, words):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij ") for _ in range(300))
    docs = [(1, text[:99]), (2, text[:99]), (3, text[:100]), (4, text[:100]), (5, text[1:101]), (6, text), (7, text[200:] + text[:200]), (8, "z" * 250), (9, "z" * 100)]
    found = deduped(spark, docs)
    assert found == plain_dedup(docs)
    assert found[1][2] == [] and found[3][2] == [(0, 100)] and found[7][2] == [(1, 250)] and found[8][2] == [(0, 100)]


def test_dedup_of_repeated_and_missing_ids(spark):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij ") for _ in range(150))
    rows = [(None, text), (1, text), (1, text), (1, text + "!"), (2, None), (None, text)]
    found = suffixdedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept)) for r in found), key=repr)
    assert kept == sorted([(None, 150, 0), (None, 150, 0), (1, 150, 150), (1, 150, 150), (1, 151, 150), (2, 0, 0)], key=repr)
    assert suffixdedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dedup_of_a_long_text(spark):
    rng = random.Random(3)
    half = "".join(rng.choice("abcdefghijklmnop ") for _ in range(700_000))
    found = deduped(spark, [(1, half + "|" + half), (2, half[:500])])
    assert [(r[0], r[2]) for r in found] == [(1, [(700_001, 1_400_001)]), (2, [(0, 500)])]


def test_suffixes_sort_like_bytes():
    rng = random.Random(4)
    rows = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    group = np.sort(np.array([rng.randrange(40) for _ in rows]))
    suffixes = suffixdedup.Suffixes(rows, 10)
    order, shared = suffixes.verified(group)
    assert [(int(group[i]), rows[i][:10]) for i in order] == sorted((int(g), r[:10]) for g, r in zip(group, rows))
    for k in range(1, len(order)):
        a, b = rows[order[k - 1]][:10], rows[order[k]][:10]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == (same if group[order[k]] == group[order[k - 1]] else -1)


def test_equal_hashes_are_told_apart_by_bytes():
    rows = [b"aaaa", b"abab", b"aaab", b"aaaa"]
    suffixes = suffixdedup.Suffixes(rows, 4)
    suffixes.prefix[:] = 0  # as if all hashes collided
    order, shared = suffixes.verified(np.zeros(4, int))
    assert [rows[i] for i in order] == sorted(rows) and shared.tolist() == [-1, 4, 3, 1]


# Long texts of the older operators


def test_many_scored_words_amid_others_take_one_pass():
    model = toxicity.Model({"bad": 0.5, "good": -0.6})
    began = time.perf_counter()
    found, n = model.passages("bad x x x x x x x x x x x x x x x x " * 100_000)
    assert n == 1_700_000 and len(found) == 100_000 and time.perf_counter() - began < 30


def test_many_license_phrases_in_one_text(spark):
    n = 50_000
    text = "under the mit license apache 2 " * n
    found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (found.n_words, found.n_base, found.first_word, found.last_word, found.base_labels) == (6 * n, n, 0, 6 * (n - 1), "mit")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle", "op13_suffix_dedup"])
def test_queries_like_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    found = catalog.QUERIES[name](spark, sf)
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = db.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
