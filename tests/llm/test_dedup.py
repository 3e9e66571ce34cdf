"""Line deduplication, SimHash and mixing against plain Python, and their corner cases."""

import random
from collections import Counter, defaultdict

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import components, linededup, mixing, simhash, similar

DOCS = "doc_id long, text string, source string, n_lines string, row string, fp string, size string, left string"


def frame(spark, rows):
    """Documents with other columns of clashing names."""
    return spark.createDataFrame([(i, t, s, "x", "x", "x", "x", "x") for i, t, s in rows], DOCS)


def plain_lines(rows, width=3, least_chars=60):
    seen, out = set(), {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out[i] = None
            continue
        lines = [x for x in regex.split(r"(?<=\n)|(?<=[.!?][ \t]+)(?![ \t])|(?<=[\u3002\uff01\uff1f])", t) if x]
        full = [(k, x.strip(" \t\r\n"), x.endswith("\n")) for k, x in enumerate(lines) if x.strip(" \t\r\n")]
        cover = set()
        for a in range(len(full) - width + 1):
            own = full[a : a + width]
            part = tuple(x for _, x, _ in own)
            if sum(map(len, part)) < least_chars and not all(e for _, _, e in own[:-1]):
                continue
            if part in seen:
                cover |= set(range(own[0][0], own[-1][0] + 1))
            seen.add(part)
        out[i] = "".join(x for k, x in enumerate(lines) if k not in cover)
    return out


def test_lines_against_plain(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        lines = [rng.choice(["a", "b", "c ", " d", "", "e"]) if rng.random() < 0.5 else f"l{rng.randint(0, 30)}" for _ in range(rng.randint(0, 14))]
        rows.append((i, "\n".join(lines), "s"))
    said = ["One sentence of five words. ", "Another! ", "A third, it is longer than others?  ", "No end ", "x. ", "\u4e00\u3002", "Two\nlines of it. "]
    for i in range(200, 260):
        rows.append((i, "".join(rng.choice(said) for _ in range(rng.randint(0, 12))), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, rows[0][1], "s"), (None, rows[1][1], "s"), (103, "x\ny\nz\n" * 300, None), (104, "\n \n. \n", "s")]
    got = linededup.dedup_lines(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "source", "row", "fp", "size", "left", "n_lines", "n_removed"]
    assert {r.doc_id: r.text for r in got.collect()} == plain_lines(rows)
    named = linededup.dedup_lines(frame(spark, rows[:3]), n_lines="all_", n_removed="gone").columns
    assert named == [*DOCS.replace(" long", "").replace(" string", "").split(", "), "all_", "gone"]


def test_passages_within_lines_go(spark, words):
    """A passage of over 50 words that repeats, also inside a line and within one line of text."""
    rng = random.Random(40)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = " ".join(f"{make(9)}." for _ in range(7))
    rows = [(i, f"{make(40)} before it {passage} after {make(40)}.\nmore {make(20)}", "s") for i in range(5)]
    got = {r.doc_id: r for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and all(got[i].n_removed >= 5 and sum(x in got[i].text for x in passage.split(". ")[1:-1]) == 0 for i in range(1, 5))


def test_lines_corner_cases(spark):
    none = frame(spark, [])
    assert linededup.dedup_lines(none).count() == 0
    twice = frame(spark, [(1, "a\nb\nc", "s"), (1, "a\nb\nc", "s"), (2, "a\nb\nc\nd", "s")])
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(twice).collect())
    assert got == [(1, "a\nb\nc", 3, 0), (1, "a\nb\nc", 3, 0), (2, "d", 4, 3)]


def plain_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = Counter(b for p in parts for b in range(64) if xxhash.xxh64_intdigest(p, 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(parts))


def test_fingerprints_as_spark_hashes(spark, words):
    text = " ".join(words)
    assert simhash.fingerprint(text) == plain_print(text)
    one = spark.createDataFrame([("Ab c",)], "t string").select(F.xxhash64(F.lit("ab c"))).first()[0]
    assert simhash.fingerprint("AB \t c\n") == one % 2**64
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("É x") == xxhash.xxh64_intdigest("É x".encode(), 42)


def linked(prints):
    """Least id of each row's component, over all pairs of at most three bits."""
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("hot", [512, 2])
def test_near_pairs_also_in_crowded_segments(spark, hot):
    rng = random.Random(hot)
    centre = [rng.getrandbits(64) for _ in range(6)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(25)}
    prints |= {(centre[0] & 0xFFFFFFFF) | rng.getrandbits(32) << 32 for _ in range(20)} | {0, 1, 7, 15}
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {(r.a, r.b) for r in simhash.near(df, hot=hot).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3}


def test_groups_and_one_of_each(spark, words):
    rng = random.Random(9)
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 300))) for _ in range(12)]
    rows = [(i, t, "s") for i, t in enumerate(base)]
    for k in range(40):
        t = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 1)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((100 + k, " ".join(t), "s"))
    rows += [(200, None, "s"), (201, " ", "s"), (202, "one", "s"), (203, "ONE", "s")]
    want = linked({i: plain_print(t) for i, t, _ in rows})
    got = {r.doc_id: r.component_id for r in simhash.groups(frame(spark, rows)).collect()}
    assert got == want and got[201] == 200 and got[203] == 202
    kept = simhash.keep_one(frame(spark, rows + [rows[0], (None, base[0], "s"), (None, "alone here now", "s")]))
    assert kept.columns == frame(spark, []).columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda i: (i is None, i or 0))
    assert ids == [*sorted(set(want.values())), None]
    assert simhash.groups(frame(spark, [])).count() == 0 and simhash.keep_one(frame(spark, [])).count() == 0


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 501), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 501: 500}


def water(sizes, total):
    """Targets by resharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    capped = {}
    while True:
        open_ = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {**capped, **{s: level * weight[s] for s in open_}}
        capped.update({s: 2 * sizes[s] for s in over})


def test_mix(spark, words):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 400))), rng.choice(["a"] * 8 + ["b", "c", "Z", None])) for i in range(300)]
    rows += [(400, None, "a"), (401, "", "e"), (402, " ".join(words * 20), "big"), (None, "x y", "a"), (5, "again", "a")]
    df = frame(spark, rows)
    got = mixing.mix(df, block_words=64).collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes, 1.5 * sum(sizes.values()))
    source = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(df.repartition(7), block_words=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sorted(map(str, mixing.mix(df, block_words=64, long_slots=0).collect())) == sorted(map(str, got))  # points in decimals
    assert all((r.first_slot is None) == (r.n_slots == 0) == (r.taken == 0) for r in got)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_schedule_is_even(spark, words):
    rows = [(i, " ".join(words[:50]), "abc"[i % 3]) for i in range(240)]
    _, schedule = mixing.placed(frame(spark, rows), block_words=50)
    by_slot = defaultdict(Counter)
    last = max(r.slot for r in schedule.collect())
    for r in schedule.collect():
        by_slot[r.slot * 8 // (last + 1)][r.source_no] += r.words
    shares = [[c[n] / sum(c.values()) for n in (1, 2, 3)] for c in by_slot.values()]
    whole = [sum(c[n] for c in by_slot.values()) / sum(sum(c.values()) for c in by_slot.values()) for n in (1, 2, 3)]
    assert all(abs(a - b) < 0.05 for s in shares for a, b in zip(s, whole))


def similarity(a, b):
    x, y = ({tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("hot", [32, 3])
def test_one_of_similar_texts(spark, words, hot):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 200))) for _ in range(8)]
    for _ in range(60):
        t = rng.choice(texts[:8]).split(" ")
        for _ in range(rng.randint(0, max(1, len(t) // 40))):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append(" ".join(t))
    up = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if similarity(texts[a], texts[b]) >= 0.8:
                up = [up[a] if u == up[b] else u for u in up]
    want = sorted({min(k for k in range(len(texts)) if up[k] == u) for u in up})
    assert 8 < len(want) < 68
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    # Rows of one id and other texts are documents of their own; a null id goes where the group has another.
    more = [(0, "a unique text under an id that is taken", "s"), (None, texts[0], "s"), (None, "alone here now", "s"), rows[0]]
    kept = similar.one_of_similar(frame(spark, rows + more), hot=hot)
    assert kept.columns == frame(spark, []).columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in kept.collect()) == sorted([-1, 0, *want])
    assert similar.one_of_similar(frame(spark, [])).count() == 0


def test_similar_texts_link_by_fingerprint_where_no_band_does(spark, words, monkeypatch):
    """The SimHash step finds by itself what differs in at most three bits; the exact test keeps what isn't similar apart."""
    monkeypatch.setattr(similar, "bands", lambda hashed: [])
    base = [words[k % len(words)] for k in range(400)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in (0, 399)]
    prints = [simhash.bits(similar.shingle_set(t)) for t in (" ".join(base), *near)]
    assert 0 < max(bin(prints[0] ^ p).count("1") for p in prints) <= 3
    rows = [(1, " ".join(base), "s"), (2, near[0], "s"), (3, near[1], "s"), (4, " ".join(reversed(base)), "s")]
    assert sorted(r.doc_id for r in similar.one_of_similar(frame(spark, rows)).collect()) == [1, 4]


def test_crowded_bands_join_as_all_pairs_do(spark, words):
    """Copies of one text with few to many changes, of which some are alike to each other but not to the text."""
    rng = random.Random(33)
    base = [rng.choice(words) for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(90):
        t = rng.choice([base, texts[-1].split(" ")])[:]
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], [rng.choice(words)], [t[k], rng.choice(words)]])
        texts.append(" ".join(t[: rng.choice([150, 150, 110])]))
    up = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if similarity(texts[a], texts[b]) >= 0.8:
                up = [up[a] if u == up[b] else u for u in up]
    want = sorted({min(k for k in range(len(texts)) if up[k] == u) for u in up})
    assert 5 < len(want) < 70
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    assert sorted(r.doc_id for r in similar.one_of_similar(frame(spark, rows), hot=2).collect()) == want


def test_one_of_each_with_equal_ids(spark, words):
    rows = [(1, " ".join(words[:100]), "s"), (1, " ".join(words[100:200]), "s"), (2, " ".join(words[:100]), "s")]
    assert sorted(r.text for r in simhash.keep_one(frame(spark, rows)).collect()) == sorted({t for _, t, _ in rows})
