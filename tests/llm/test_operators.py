"""Each operator against brute force on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_cnn, components, divergence, html_main, license_scan, lsh_forest, source_mix, subword_lm, suffix_merge, templates, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ref long, row long, cls string, h long, spans__x string"


def _corpus():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base = say(120)
    words = base.split()
    texts = [base, base, base.upper(), " ".join([*words[:60], "changed", *words[61:]]), " ".join([*words[:115], "x", "y"]), say(90), say(3), "one", "", "   ", None, say(4000), say(80) + " " + base[:260], "tab\tand\nline\x0bbreak  " + say(30), "é" * 300, "é" * 300, "ab " * 200, "###$$$ | | |" * 9, say(40) + "\n" + say(5) + "\n" + "dup line\ndup line\ndup line"]
    rows = [(i, t, ["en", "de", None, "xx"][i % 4], ["a", "b", None, "c"][i % 4]) for i, t in enumerate(texts)]
    rows += [(0, base, "en", "a"), (None, say(50), "en", None), (None, None, None, None)]
    return [(i, t, g, s, None if t is None else len(t), 1, 2, "c", 3, "z") for i, t, g, s in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return _corpus()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, str(x)) for x in r)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (4, 10), (10, 11)], "a long, b long")
    assert {r["node"]: r["label"] for r in components.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 10: 1, 11: 1, 7: 7, 8: 7, 9: 7}


def test_near_duplicates(docs, rows, none):
    sets, ids = [], []
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append(frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
        ids.append(i)
    comp = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y) and comp[a] != comp[b]:
            comp = [comp[a] if c == comp[b] else c for c in comp]
    want = []
    for k, i in enumerate(ids):
        group = [ids[j] for j in range(len(rows)) if comp[j] == comp[k] and ids[j] is not None] if sets[k] else [i]
        least = min(group) if group and group[0] is not None else None
        want.append((i, len(sets[k]), least, i == least if i is not None else least is None))
    same(lsh_forest.near_duplicates(docs).collect(), want)
    assert lsh_forest.near_duplicates(none).count() == 0


def test_near_duplicates_in_a_crowd(spark):
    """One group of hundreds of near copies: all of them, linked by chains, and nothing else."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    texts = []
    for _ in range(300):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(150)] = word()
        texts.append(" ".join(w))
    texts += [" ".join(base[:30] + [word() for _ in range(60)]) for _ in range(100)]
    got = lsh_forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sets = [frozenset(tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)) for t in texts]
    comp = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            comp = [comp[a] if c == comp[b] else c for c in comp]
    assert {x["doc_id"]: x["component_id"] for x in got} == {i: min(j for j in range(len(texts)) if comp[j] == comp[i]) for i in range(len(texts))}


@pytest.mark.parametrize("length", [60, 200])
def test_repeated_strings(docs, rows, none, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    want = []
    for (i, *_), t in zip(rows, texts, strict=True):
        cov = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                cov[p : p + length] = [True] * length
        left = bytes(x for x, c in zip(t, cov, strict=True) if not c)
        want.append((i, len(t), sum(cov), sum(1 for k, c in enumerate(cov) if c and not (k and cov[k - 1])), hashlib.sha256(left).hexdigest()))
    same(suffix_merge.dedup_digest(docs, length).collect(), want)
    cut = suffix_merge.dedup_texts(docs, length)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert suffix_merge.dedup_digest(none, length).count() == 0 and suffix_merge.dedup_texts(none, length).count() == 0


def test_source_mix(docs, rows, none):
    got = source_mix.mix_sources(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    total = collections.Counter()
    for _, t, _, s, *_ in rows:
        total[s] += size(t)
    order = sorted((s for s in total if s is not None)) + [None]
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while True:
        each = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if each[s] > 2 * total[s]}
        if not over:
            target.update(each)
            break
        for s in over:
            target[s] = 2 * total[s]
            left -= target[s]
        free -= over
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert sorted(r["size"] for r in got) == sorted(size(t) for _, t, *_ in rows)
    for s in order:
        assert abs(taken[s] - target[s]) <= max([1, *(size(t) for _, t, _, x, *_ in rows if x == s)]) / 2
    # The rates: the tilt by size whose tokens meet the target, found by bisection.
    for s in order:
        z = [size(t) for _, t, _, x, *_ in rows if x == s and size(t)]
        unit = sum(z) / len(z)
        rate = lambda lam, n: min(2.0, math.exp(min(50, lam * n / unit)))  # noqa: E731, B023
        low, high = -500.0, 500.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * rate(mid, n) for n in z) < target[s] else (low, mid)
        for r in got:
            if r["source"] == s and r["size"]:
                assert abs(r["rate"] - rate(high, r["size"])) < 1e-4
                assert abs(r["copies"] - r["rate"]) <= 2
    again = source_mix.mix_sources(docs.repartition(5)).collect()
    same([(r["doc_id"], r["taken"]) for r in got], [(r["doc_id"], r["taken"]) for r in again])
    assert source_mix.mix_sources(none).count() == 0


def test_quality_rules(docs, rows, none):
    want = []
    for i, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cov = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov), len(w) < 20 or 100 * len(cov) > 30 * len(w)))
    got = divergence.quality_rules(docs).collect()
    same([r[:7] for r in got], want)
    assert not any(r["base_failed"] and r["kept"] for r in got)
    assert divergence.quality_rules(none).count() == 0


def test_js_distance(spark):
    d = spark.createDataFrame([([1.0, 1.0], [1.0, 0.0])], "p array<double>, q array<double>")
    h = lambda *x: -sum(v * math.log2(v) for v in x if v)
    got = d.select(divergence.js_distance(F.col("p"), F.col("q"), F.lit(2.0), F.lit(1.0))).first()[0]
    assert math.isclose(got, math.sqrt(h(0.75, 0.25) - h(0.5, 0.5) / 2))


def test_classifier(spark, docs, none):
    r = random.Random(1)
    good = lambda: " ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7))) for _ in range(60)) + "."
    bad = lambda: " ".join("#$%" + r.choice("XYZ") * 3 for _ in range(60))
    made = [(i, good() if i % 2 else bad()) for i in range(240)]
    d = spark.createDataFrame(made, "doc_id long, text string")
    lab = spark.createDataFrame([*[(i, i % 2) for i in range(240)], (None, 1), (999, 0), (5, None)], "doc_id long, quality int")
    net = byte_cnn.fit(d, lab, max_rows=80)
    got = byte_cnn.score(d, net).collect()
    held = [x for x in got if x["held_out"]]
    assert {x["doc_id"] for x in held} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(x["predicted"] == x["doc_id"] % 2 for x in held) >= 0.95 * len(held)
    out = byte_cnn.score(docs, net).collect()
    assert len(out) == docs.count() and all(0 <= x["score"] <= 1 for x in out)
    assert byte_cnn.score(none, net).count() == 0 and byte_cnn.keep_good(docs, net).columns == docs.columns
    assert byte_cnn.fit(d, lab.limit(0)) is None and {x["score"] for x in byte_cnn.score(d, None).collect()} == {0.5}


def test_lattice_against_all_segmentations():
    import numpy as np
    import pyarrow as pa

    pieces = [b"a", b"b", b"ab", b"ba", b"abb", "▁".encode(), "▁a".encode(), "▁ab".encode(), b"\xe2", b"\x96", b"\x81"]
    logp = np.log(np.arange(1, len(pieces) + 1) / sum(range(1, len(pieces) + 1)))
    lat = subword_lm.Lattice(pieces, [logp], [0.3])
    weight = dict(zip(pieces, np.exp(logp) * 0.7, strict=True))

    def brute(x):
        if not x:
            return 1.0
        return sum(w * brute(x[len(p) :]) for p, w in weight.items() if x.startswith(p))

    words = ["a", "abba", "bbabab", "c", "ab" * 6]
    got = lat.score(*subword_lm.marked(pa.array(words)))[:, 0]
    for g, w in zip(got, words, strict=True):
        b = brute("▁".encode() + w.encode()) * 0.3 / 0.7
        assert g == -math.inf if b == 0 else math.isclose(g, math.log(b), rel_tol=1e-9)
    n = lat.expected(0, *subword_lm.marked(pa.array(["abb"])), np.array([2.0]))
    sizes = np.array([len(p) for p in pieces])
    assert math.isclose((n * sizes).sum(), 2 * len("▁abb".encode()))
    # Words out of the range of floats go by logarithms, with the same result.
    long = pa.array(["abba" * 3, "ab" * 1500, "c"])
    got, ones = lat.expected(0, *subword_lm.marked(long), np.ones(3)), np.ones(3)
    data, offs = subword_lm.marked(long)
    by_logs = sum(lat._expected_by_logs(0, data, offs, np.array([i]), int(np.diff(offs)[i]), ones) for i in range(2))
    assert np.allclose(got, by_logs, rtol=1e-6)


def test_lattice_walks_a_trie(monkeypatch):
    """Pieces in words are found by steps in a trie, without hashes or searches of every substring; classes share a walk, and scores leave logarithms to extreme words."""
    import random

    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    pieces = sorted({"".join(r.choice("abé") for _ in range(r.randrange(1, 7))).encode() for _ in range(200)} | {bytes([i]) for i in range(256)} | {"▁".encode()})
    logp = [np.log(w / w.sum()) for w in (np.array([r.random() + 0.01 for _ in pieces]) for _ in range(3))]
    lat = subword_lm.Lattice(pieces, logp, [0.2, 0.3, 0.4])
    base, owner, to, piece = lat.trie
    for i, x in enumerate(pieces):
        node = 0
        for b in x:
            assert owner[base[node] + b] == node
            node = to[base[node] + b]
        assert piece[node] == i
    words = ["", "a", "éb", "xyz", *("".join(r.choice("abéc") for _ in range(r.randrange(1, 30))) for _ in range(60)), "ab" * 900, "é" * 700]
    data, offs = subword_lm.marked(pa.array(words))

    def banned(*_, **__):
        raise AssertionError("substrings are hashed")

    monkeypatch.setattr(subword_lm.Block, "hashes", banned)
    for i in range(len(words)):
        w, rows = data[offs[i] : offs[i + 1]].tobytes(), np.array([0, i])  # beside a shorter word
        got = {(int(at) // 2, int(k)) for length, where, ids in lat._arcs(data, offs, rows, max(3, len(w))) for at, k in zip(where, ids, strict=True) if at % 2}
        want = {(at, k) for at in range(len(w)) for k, x in enumerate(pieces) if w.startswith(x, at)} if len(w) < 100 else got
        assert got == want
    scores = lat.score(data, offs)
    for i in range(len(words)):
        for cls in range(3):
            n = int(offs[i + 1] - offs[i])
            arcs = lat._arcs(data, offs, np.array([i]), n)
            assert math.isclose(scores[i, cls], lat._forward(cls, arcs, 1, n)[0][n, 0] + lat.end[cls], rel_tol=1e-9)
    counts = [np.array([(i + cls) % 3 * 0.5 for i in range(len(words))]) for cls in range(3)]
    all_ = lat.uses([0, 1, 2], data, offs, counts)
    for cls in range(3):
        assert np.allclose(all_[cls], lat.expected(cls, data, offs, counts[cls]), rtol=1e-9)
        by_logs = sum(lat._expected_by_logs(cls, data, offs, np.array([i]), int(offs[i + 1] - offs[i]), counts[cls]) for i in range(len(words)))
        assert np.allclose(all_[cls], by_logs, rtol=1e-6, atol=1e-9)


def test_scores(docs, rows, none):
    got = subword_lm.score_documents(docs, head=20).collect()
    train = collections.Counter()
    toks = []
    for i, t, *_ in rows:
        w = [*WORD.findall((t or "").translate(LOW)), 0]
        ho = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        toks.append((i, ho, w))
        if not ho:
            train.update(w)
    n, v = sum(train.values()), len(train)
    want = [(i, ho, len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 6)) for i, ho, w in toks]
    same([(*r[:5], round(r["base_score"], 6)) for r in got], want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert subword_lm.score_documents(none).count() == 0


def test_licenses(docs, none, spark):
    texts = ["Released under the MIT License. Licensed under the Apache License, Version 2.0.", "cc by gnu GENERAL public license. cc by", "licensed under the terms of the GNU General Public License, version 3", None, "nothing", license_scan.TEMPLATES["mit-text"].replace("<<optional>>", "").replace("<</optional>>", ""), "Licensed under CC BY-NC 4.0."]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (2, 3, 8, "apache,mit") and "apache-2.0-notice" in got[0]["labels"] and "mit-notice" in got[0]["labels"]
    assert (got[1]["n_base"], got[1]["base_labels"], got[1]["score"]) == (3, "cc-by,gpl", 0.5)
    assert "gpl-notice" in got[2]["labels"] and "mit-text" in got[5]["labels"] and "cc-by-nc-notice" in got[6]["labels"]
    assert got[3]["n_words"] == 0 and got[3]["first_word"] is None and got[3]["labels"] == "" and got[4]["score"] == 0.0
    assert license_scan.scan_licenses(docs).count() == docs.count() and license_scan.scan_licenses(none).count() == 0


def test_decontamination(spark, docs, none):
    items = [(1, "Alice has 12 apples and gives 5 apples to Bob. How many apples does Alice keep in her red basket today?"), (2, "too short"), (3, None), (4, "The quick river crosses seven old valleys before it reaches the grey northern sea at last")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [
        "Intro words here. " + items[0][1] + " Outro.", "Carol has 30 apples and gives 7 apples to Dave. How many apples does Carol keep in her red basket today?",
        "Carol has 30 apples and gives 7 apples to Dave. How many apples does Emma keep in her red basket today?", "has apples and gives apples to. many keep", None, "", items[3][1].upper(),
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["cover"], 3), r["kind"]) for r in templates.find_leaks(d, bench).collect()}
    assert got[(0, 1)] == (1.0, "exact") and got[(1, 1)] == (1.0, "re-parameterised") and got[(6, 4)][1] == "exact"
    assert set(got) == {(0, 1), (1, 1), (6, 4)}  # in text 2, Alice would be two persons
    assert sorted(r["doc_id"] for r in templates.drop_leaks(d, bench).collect()) == sorted(set(range(7)) - {a for a, _ in got})
    assert templates.find_leaks(none, bench).count() == 0 and templates.drop_leaks(docs, bench.limit(0)).count() == docs.count() and templates.drop_leaks(docs, bench).columns == docs.columns


def test_html(spark):
    page = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a>menu</a></nav><div class="ad">buy</div><article><h1>Head &amp; more</h1><p><b>One<br>two  \n three</p><p>caf&eacute;<aside>x</aside><div class="comments">c</div></article><footer>f</footer></body></html>'
    a = "<body><div>Welcome to the site of all the news</div><p>Unique words %s stand here alone</p><div>All rights reserved by the owners of it</div></body>"
    rows = [(1, "http://h/a", page), (2, None, None), (3, "http://h/b", ""), (4, "http://k/1", a % "first"), (5, "http://k/2", a % "second"), (6, "http://k/1", a % "first"), (7, "http://z/", "<p>alone</p>"), (8, "u", "<article><p>cut o<b")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_main.extract_main(d).collect()}
    assert got == {1: "Head & more\nOne two three\ncafé", 2: "", 3: "", 4: "Unique words first stand here alone", 5: "Unique words second stand here alone", 6: "Unique words first stand here alone", 7: "alone", 8: "cut o"}
    assert html_main.extract_main(d.limit(0)).count() == 0


def test_urls(spark):
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")], url_filter.RULES_SCHEMA)
    urls = ["https://A.Example.org/en/17?x#y", "http://example.org/es/a", "http://example.org", "http://x.com/de/1", "http://com/fr/", "ftp://notorg/", None, "", "no scheme/path", "http://xexample.org/es/", "http://example.org/en/17", "http://h?q=/de/"]
    d = spark.createDataFrame([(i, u, "z") for i, u in enumerate([*urls, urls[0]])] + [(None, urls[3], "z")], "page_id long, url string, host string")
    got = collections.Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(d, rules).collect())
    want = [
        (0, "a.example.org", "/en/17", "example.org/en/1", "block"), (1, "example.org", "/es/a", "example.org/es/", "block"), (2, "example.org", "", None, "allow"), (3, "x.com", "/de/1", "com/de/", "block"), (4, "com", "/fr/", "com/fr/", "allow"),
        (5, "notorg", "/", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "xexample.org", "/es/", "org/", "allow"), (10, "example.org", "/en/17", "example.org/en/1", "block"), (11, "h", "", None, "allow"),
        (12, "a.example.org", "/en/17", "example.org/en/1", "block"), (None, "x.com", "/de/1", "com/de/", "block"),
    ]
    assert got == collections.Counter(want)
    assert url_filter.filter_urls(d.limit(0), rules).count() == 0 and url_filter.filter_urls(d, rules.limit(0)).where("rule IS NOT NULL").count() == 0


def test_scores_against_the_formula(docs, rows):
    """The law of the docstring with dictionaries, on top of the adapted lattice (which has a test of its own)."""
    import numpy as np
    import pyarrow as pa

    train = [(t, g) for i, t, g, *_ in rows if not (i is not None and zlib.crc32(str(i).encode()) % 7 == 2)]
    order = [g for g, _ in sorted(collections.Counter(g for _, g in train if g).items(), key=lambda x: (-x[1], x[0]))][: subword_lm.CLASSES - 1]
    k = len(order) + 1
    words = lambda t: WORD.findall((t or "").translate(LOW))
    by, texts_of, n_docs = [collections.Counter() for _ in range(k)], collections.Counter(), [0] * k
    for t, g in train:
        c = order.index(g) if g in order else k - 1
        by[c].update(words(t))
        n_docs[c] += 1
        texts_of.update(set(words(t)))
    both = sum(by, collections.Counter())
    ends = len(train)

    def law(counts, more):
        one, two = (sum(v == x for v in counts.values()) for x in (1, 2))
        d = one / (one + 2 * two) if one else 0.5
        n = sum(counts.values()) + more
        return (d, d * (len(counts) + (more > 0)) / n, n) if n else (0.0, 1.0, 1)

    laws = [law(by[i], n_docs[i]) for i in range(k)]
    d, old, total = law(both, ends)
    u = min(0.5, sum(both[w] for w in both if texts_of[w] == 1) / total or old)
    pieces, start = subword_lm.load_pieces()
    spark = docs.sparkSession
    held = spark.createDataFrame([(-1 if i is not None and zlib.crc32(str(i).encode()) % 7 == 2 else order.index(g) if g in order else k - 1, t) for i, t, g, *_ in rows], "cls int, text string")
    lattice = subword_lm.Lattice(pieces, *subword_lm.adapt(subword_lm.count_words(held, k), k, pieces, start))
    vocab = sorted({w for _, t, *_ in rows for w in words(t)})
    lat = dict(zip(vocab, lattice.score(*subword_lm.marked(pa.array(vocab))), strict=True))

    def log_p(w, c, n_class, n_both, low):
        seen = (1 - u) / (1 - old) * max(n_both - d, 0) / total
        back = np.logaddexp(math.log(seen) if seen else -math.inf, math.log(u) + low)
        own = max(n_class - laws[c][0], 0) / laws[c][2]
        return np.logaddexp(math.log(own) if own else -math.inf, math.log(max(laws[c][1], 1e-12)) + back)

    want = []
    for i, t, *_ in rows:
        logs = [math.log((n_docs[c] + 0.5) / (ends + 0.5 * k)) + sum(log_p(w, c, by[c][w], both[w], lat[w][c]) for w in words(t)) + log_p(None, c, n_docs[c], sum(n_docs), math.log(1e-4)) for c in range(k)]
        want.append((str(i), np.logaddexp.reduce(logs) / math.log(10)))
    got = sorted((str(r["doc_id"]), r["score"]) for r in subword_lm.score_documents(docs, head=20).collect())
    for (a, x), (b, y) in zip(got, sorted(want), strict=True):
        assert a == b and math.isclose(x, y, rel_tol=1e-6, abs_tol=1e-6)
