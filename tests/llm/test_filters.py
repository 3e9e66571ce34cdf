"""URL filters, license scans and decontamination against plain Python, and their corner cases."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import regex
from pyspark.sql import functions as F

from graphloom.llm import decontam, licenses, urlfilter


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def plain_rule(host, path):
    best = None
    for what, text in urlfilter.RULES:
        own, _, below = text.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + below) and (best is None or len(text) > len(best[1])):
            best = (what, text)
    return best


URLS = ["http://a.example.com/en/7x?q=1", "http://example.com/en/8", "https://EXAMPLE.NET/de/8", "https://x.net/de/", "http://com/en/", "http://notcom/en/", "http://a.org/es/1#f", "ftp://a.org", "a.org/es/", "://", "http://", None, "", "http://Ä.com/en/#x://y.net/de/", "x://y.com?/en/", "http://b.example.com/EN/7", "http://a.example.com/en/7://"]


def test_hosts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate(URLS)] + [(0, URLS[0], "x", "x")], "page_id long, url string, host string, tokens string")
    got = urlfilter.judge(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = plain_url(URLS[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule[1] if rule else None)
        assert r.verdict == (rule[0] if rule else "allow")
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_words_of_the_contract(spark):
    """Each rule's word, written out here: urls that only this rule decides, and one that a longer rule takes from it."""
    want = {"http://a.com/en/1": "block", "http://x.example.com/en/71": "allow", "http://a.net/de/8": "allow", "http://example.net/de/7": "allow", "http://x.example.net/de/81": "block", "http://a.org/es/": "block", "http://a.org/fr/": "allow"}
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(pages).collect()} == dict(enumerate(want.values()))


def test_mined_rules_block(spark):
    hosts = ["news.example.com", "cheap-pills.example.com", "pills-now.example.org", "shop.example.org"]
    rows = [(i, f"http://{hosts[i % 4]}/fr/{i}?page=2") for i in range(400)] + [(900 + i, f"http://my.site.net/track/{i}") for i in range(20)]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[i].verdict == ("block" if "pills" in rows[i][1] else "allow") for i in range(400))
    assert "host=pills" in got[1].mined
    tagged = spark.createDataFrame([(["a", "b"], True)] * 30 + [(["a"], False)] * 30 + [(["b", "c"], False)] * 30, "tokens array<string>, blocked boolean")
    rules = {tuple(r.tokens): r.confidence for r in urlfilter.mine(tagged, min_support=0.01).collect()}
    assert rules == {("a", "b"): 1.0}
    assert urlfilter.mine(tagged, min_count=31).count() == 0
    # Labels of one's own go before the seed words.
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.select("page_id", F.contains("url", F.lit("shop")).alias("blocked"))
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, labels=labels).collect()}
    assert all(got[i] == ("block" if i % 4 == 3 else "allow") for i in range(400))


def test_rules_and_index_against_all_subsets(spark):
    """Mined rules are those of counting every token set; the index finds what trying every rule finds."""
    rng = random.Random(16)
    baskets = [(sorted(rng.sample("abcdef", rng.randint(1, 4))), None) for _ in range(400)]
    baskets = [(t, ("a" in t and "b" in t) or rng.random() < 0.1) for t, _ in baskets]
    share = sum(y for _, y in baskets) / len(baskets)
    want = {}
    for size in (1, 2, 3):
        for x in combinations("abcdef", size):
            of = [y for t, y in baskets if set(x) <= set(t)]
            if sum(of) >= 10 and sum(of) >= 0.02 * len(baskets) and sum(of) >= 0.5 * len(of) and sum(of) / len(of) >= 1.2 * share:
                want[x] = sum(of) / len(of)
    got = urlfilter.mine(spark.createDataFrame(baskets, "tokens array<string>, blocked boolean"), min_support=0.02, min_confidence=0.5, min_lift=1.2).collect()
    assert {tuple(r.tokens): round(r.confidence, 9) for r in got} == {k: round(v, 9) for k, v in want.items()} and len(want) > 3
    once = Counter(x for t, _ in baskets for x in t)
    assert all(r.key == min(r.tokens, key=lambda x: (once[x], x)) for r in got)
    # Urls: whatever rule decides, it is the best of all whose tokens the url has.
    rows = [(i, f"http://{rng.choice(['cheap', 'news', 'pills', 'blog'])}.{rng.choice(['shop', 'site'])}.net/{rng.choice(['buy', 'read'])}/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = pages.select("page_id", (F.contains("url", F.lit("pills")) & F.contains("url", F.lit("buy"))).alias("blocked"))
    found = {r.page_id: r for r in urlfilter.judge(pages, labels=labels).collect()}
    bad = {i for i, u in rows if "pills" in u and "buy" in u}
    assert {i for i, r in found.items() if r.verdict == "block"} == bad and all({"host=pills", "path=buy"} <= set(found[i].mined.split()) for i in bad)


def plain_words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_base(text):
    w = plain_words(text)
    at = [(k, label) for phrase, label in licenses.BASE for p in [phrase.split()] for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    None, "", "...", "Under the MIT License.", "under the mit license under the mit license", "Licensed under the Apache License, Version 2.0 (CC-BY-NC 4.0)", "cc by nc cc by nc", "underthe mit license", "x under\nthe\tMIT-license y",
    "released under the GNU General Public License version 3 or later", "SPDX-License-Identifier: MPL-2.0", "apache license version 2", "apache license version 22", "été under the mit licenseé", "All rights reserved.", "under the mit license " * 500,
    "no licence here", "CC BY-NC-SA 4.0", "\u212a under the mit license", "x \ue000 under the mit license \ue001 y under the mit license", "UNDER THE M\u0130T LICENSE, cc by nc.", "BSD 2-clause license", "the common public license plate", "artistic license was taken",
]


def test_licenses(spark):
    df = spark.createDataFrame([(i, t, "x", "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", "x"), (None, TEXTS[3], "x", "x")], "doc_id long, text string, norm string, label string")
    got = licenses.scan(df).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS):
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by[9].labels == "gpl-3" and by[5].labels == "apache-2,apache-2.0,cc-by-nc,cc-by-nc-4.0"
    assert by[10].labels == "mpl-2.0" and by[16].labels == "" and by[16].score == 0
    assert "cc-by-nc-sa-4.0" in by[17].labels and by[14].labels == "proprietary"
    assert licenses.scan(df.limit(0)).count() == 0


    assert by[21].labels == "bsd-2-clause" and by[22].labels == by[23].labels == ""


def without_groups(pattern):
    """The alternatives of a pattern, with a space for each group, but what is fixed."""
    out, depth = [""], 0
    for k, ch in enumerate(pattern):
        depth += (ch == "(") - (ch == ")")
        if depth == 0 and ch == "|":
            out.append("")
        elif depth == 0 and not (ch in "?)" and pattern[k - 1] in ")?") and ch != ")":
            out[-1] += ch
        elif depth == 0:
            out[-1] += " "
    return [re.sub(" +", " ", f" {x} ") for x in out]


def test_rules_compile_and_hold_their_triggers():
    known = licenses.rules()
    assert len({r[0] for r in known}) == len(known) and all(r[4] and re.compile(r[5]) for r in known)
    lines = licenses.SIGNATURES.strip().splitlines()
    assert len(lines) > 200 and len(set(lines)) == len(lines)
    for line in lines:
        _, _, trigger, pattern = (x.strip() for x in line.split(";"))
        for alternative in without_groups(pattern):
            assert f" {trigger} " in alternative, (trigger, alternative)
            assert re.fullmatch(r"[a-z0-9]+|[a-z0-9]*\[sz\][a-z0-9]*", trigger)


def plain_labels(text):
    """The labels that stand, by running every rule on the whole text and comparing all detections with all."""
    norm = " " + " ".join(plain_words(text)) + " "
    found = [(m.start(), m.end(), p, i, label, base) for i, label, p, _, _, pattern, base in licenses.rules() for m in re.finditer(pattern, norm)]
    order = lambda d: (d[0], -d[1], -d[2], d[3])
    def falls(d):
        return any(o is not d and o[2] >= d[2] and o[0] <= d[0] and d[1] <= o[1] and order(o) < order(d) for o in found)
    return ",".join(sorted({d[4] for d in found if d[5] or not falls(d)}))


def test_labels_against_all_rules(spark, words):
    """Keyword gate, priority and containment against running every rule: texts pieced together from the rules' own words."""
    rng = random.Random(11)
    plain = [re.sub(r"\(\?[:!<=]*[^()]*\)\??|[?\\^|\[\]{}.,]", " ", r[5]) for r in licenses.rules()]
    texts = [" ".join(rng.choice([rng.choice(plain), rng.choice(words), rng.choice(list(SAMPLES)), rng.choice([t for t in TEXTS if t and len(t) < 99])]) for _ in range(6)) for _ in range(250)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licenses.scan(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_labels(t), t
    assert sum(bool(x) for x in got.values()) > 150


def passages(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], "doc_id long, text string, row string, tokens string, hash string")


def test_leaks(spark, words):
    rng = random.Random(8)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = {k: make(n) for k, n in enumerate([40, 25, 13, 8, 30])}
    items[5] = "anna had 12 apples and 5 kg of flour so she sold 12 apples to Bob for 30 dollars in all"
    items[6] = "too short"
    bench = spark.createDataFrame([*items.items(), (7, None)], "item_id long, text string")
    docs = [(k, make(60) + " " + items[k] + ". " + make(60)) for k in range(5)]
    docs += [(10 + k, make(200)) for k in range(30)]
    docs += [(50, items[0].upper()), (51, "\n".join(items[1].split())), (52, items[0][: len(items[0]) // 2]), (53, None), (54, ""), (55, make(10) + " " + " ".join(items[0].split()[:7]) + " " + make(10))]
    docs += [(60, "so anna had 17 apples and 8 kg of flour so she sold 17 apples to Bob for 44 dollars in all"), (61, "so anna had 17 apples and 8 kg of flour so she sold 99 apples to Bob for 44 dollars in all")]
    docs += [(None, items[0]), (70, items[0] + " " + make(20000)), (50, "clean text under an id that is not clean elsewhere with many words")]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(passages(spark, docs), bench).collect()}
    assert got == {*((k, k) for k in range(5)), (50, 0), (51, 1), (52, 0), (60, 5), (None, 0), (70, 0)}
    kept = decontam.decontaminate(passages(spark, docs), bench)
    assert kept.columns == ["doc_id", "text", "row", "tokens", "hash"]
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted([*range(10, 40), 50, 53, 54, 55, 61])
    assert decontam.leaks(passages(spark, []), bench).count() == 0
    assert decontam.leaks(passages(spark, docs), bench.limit(0)).count() == 0
    assert decontam.decontaminate(passages(spark, docs), bench.limit(0)).count() == len(docs)


def test_leaks_that_were_lost(spark, words):
    rng = random.Random(18)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    dense = "12 34 kg 5 m 67 89 21 7 cm 3 14 15 92 65 35 89 79 32"
    twice = "anna paid 12 dollars for 3 kg of rice and then 12 dollars more for 4 kg of beans in town"
    starts = "Tom has 3 red hats. Tom gives 2 hats to Ann. How many hats does Tom have now in all?"
    bench = spark.createDataFrame([(1, dense), (2, twice), (2, twice), (3, twice), (4, "What is the capital city?"), (None, starts), (5, "too short"), (6, "she sold 12 pens and 5 cups for 12 euros and 7 more")], "key long, text_ string")
    docs = [(1, make(20) + " " + dense + " " + make(20)), (2, make(9) + " " + twice), (4, make(9) + " what is the capital city " + make(9)), (5, make(9) + " what is a capital city " + make(9)), (6, "a text that is too short for it")]
    # Two versions of one template in a text, and a verbatim copy beside a variant: alignments are judged apart.
    one, other = (twice.replace("12", x).replace(" 3 kg", f" {y} kg") for x, y in (("17", "5"), ("44", "9")))
    docs += [(7, one + ". " + make(30) + " " + other), (8, one.replace("17", "18", 1))]
    # Both ways: two values of the item must not fall into one of the document.
    docs += [(9, "she sold 12 pens and 12 cups for 12 euros and 7 more"), (13, "she sold 17 pens and 5 cups for 12 euros and 7 more"), (14, "she sold 8 pens and 6 cups for 8 euros and 2 more"), (10, starts.replace("Tom", "Eva").replace("Ann", "Bob").replace("3", "9")), (12, starts.lower())]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(passages(spark, docs), bench, item_column="key", item_text_column="text_").collect()}
    assert got == {(1, 1), (2, 2), (2, 3), (4, 4), (7, 2), (7, 3), (10, None), (12, None), (14, 6)}


def plain_tokens(text):
    """(word, type) of each token; type is empty, number, name or unit."""
    out = []
    unit = regex.compile(rf"(?:{decontam.UNITS})(?!\p{{L}})", regex.I)
    at = 0
    while at < len(text):
        number = regex.compile(decontam.DIGITS).match(text, at)
        word = regex.compile(r"[\p{L}\p{M}\p{N}]+").match(text, at)
        if number:
            out.append((number[0], "number"))
            at = number.end()
            gap = at + (at < len(text) and text[at] == " ")
            near = unit.match(text, gap) or regex.compile("%").match(text, gap)
            if near:
                out.append((near[0].lower(), "unit"))
                at = near.end()
        elif word:
            out.append((word[0].lower(), "name" if word[0][0].isupper() else ""))
            at = word.end()
        else:
            at += 1
    return out


def plain_leaks(doc, item, width, need, most_slots, least=4):
    d, i = plain_tokens(doc), plain_tokens(item)
    if len(i) < width:
        return len(i) >= least and any([w for w, _ in d[k : k + len(i)]] == [w for w, _ in i] for k in range(len(d)))
    enough = min(need, len(i) - width + 1)
    shape = lambda t: [(k or w) for w, k in t]
    exact, lines = set(), defaultdict(set)
    for p in range(len(d) - width + 1):
        for a in range(len(i) - width + 1):
            x, y = d[p : p + width], i[a : a + width]
            if [w for w, _ in x] == [w for w, _ in y]:
                exact.add(a)
                lines[p - a].add(a)
            if shape(x) == shape(y) and sum(bool(k) for _, k in y) <= most_slots:
                lines[p - a].add(a)
    if len(exact) >= enough:
        return True
    for shift, found in lines.items():
        if len(found) >= enough:
            pairs = {(i[a + k][0], d[a + k + shift][0]) for a in found for k in range(width) if i[a + k][1]}
            if len(pairs) == len({x for x, _ in pairs}) == len({y for _, y in pairs}):
                return True
    return False


def test_templates_against_plain(spark):
    """Placeholders, windows, alignments and slot consistency against comparing every window with every window."""
    rng = random.Random(21)
    piece = lambda: rng.choice(["has", "buys", "for", "of", "Ann", "Bob", "Eva", "3", "4", "5 kg", "6 kg", "rice", "."])
    items_ = [" ".join(piece() for _ in range(rng.randint(3, 16))) for _ in range(14)]
    docs = []
    for _ in range(90):
        base = rng.choice(items_)
        swap = dict(zip(["Ann", "Bob", "Eva"], rng.sample(["Ann", "Bob", "Eva", "Kim", "Lea"], 3))) | dict(zip("3456", rng.choices("3456789", k=4) if rng.random() < 0.3 else rng.sample("3456789", 4)))
        changed = [swap.get(w, w) if rng.random() < 0.97 else piece() for w in base.split(" ")]
        docs.append(" ".join([*(piece() for _ in range(rng.randint(0, 8))), *changed, *(piece() for _ in range(rng.randint(0, 8)))]))
    settings = {"width": 4, "need": 4, "most_slots": 3, "least": 3}
    found = decontam.leaks(passages(spark, list(enumerate(docs))), spark.createDataFrame(list(enumerate(items_)), "item_id long, text string"), **settings).collect()
    want = {(d, i) for d, t in enumerate(docs) for i, u in enumerate(items_) if plain_leaks(t, u, **settings)}
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == len(want)
    kinds = Counter(r.n_slots > 0 for r in found)
    assert kinds[True] > 10 and kinds[False] > 5 and len(want) < 0.6 * len(docs) * len(items_)


def test_windows_against_plain(spark, words):
    """Word for word, the windows found are those of plain Python."""
    rng = random.Random(2)
    few = words[:6]
    docs = [(k, " ".join(rng.choice(few) for _ in range(rng.randint(0, 60)))) for k in range(40)]
    items = [(k, " ".join(rng.choice(few) for _ in range(12))) for k in range(20)]
    grams = lambda t: [tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)]
    want = {}
    for d, t in docs:
        have = set(grams(t))
        for i, u in items:
            n = sum(g in have for g in grams(u))
            if n >= 6:
                want[d, i] = n
    found = decontam.leaks(passages(spark, docs), spark.createDataFrame(items, "item_id long, text string"), width=2)
    assert {(r.doc_id, r.item_id): r.n_windows for r in found.collect()} == want


SAMPLES = {"released under MIT": "mit", "distributed under Apache 2.0": "apache-2.0", "Mozilla Public 2.0": "mpl-2.0", "GNU General Public v3": "gpl-3", "Boost Software 1.0": "boost-1.0", "Artistic 2.0": "artistic-2.0", "gpl3": "gpl-3", "GPLv3": "gpl-3", "lgplv2.1": "lgpl-2.1"}


def test_the_filter_passes_what_rules_match(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(df).collect()}
    assert all(label in got[i] for i, label in enumerate(SAMPLES.values())), got
