"""Cases in which an operator once did less than its whole job."""

import random

from tessera.llm import byte_cnn, html_main, license_scan, lsh_forest, templates


def _say(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


def test_html_structure_is_only_a_prior(spark):
    r = random.Random(1)
    body, lead = [_say(r, 20) for _ in range(4)], [_say(r, 20) for _ in range(4)]
    note = "Subscribe to our paper and read it each day"
    pages = [
        f"<article><p>{lead[0]}</p><p>{note}</p></article><div>{body[0]}</div>",  # a teaser, the body outside
        f"<div class='banner-layout'><p>{lead[1]}</p><main><p>{body[1]}</p><p>{note}</p></main></div>",
        f"<div class='related'><p>{lead[2]}</p></div><article><p>{body[2]}</p></article>",
        f"<article><p>{body[3]}</p></article>",
        f"<article><p>{body[3]}</p></article>",  # a copy of the page before
        f"<div>{note}</div><article><p>{body[2][:59]} {lead[3]}</p></article>",  # the note as furniture
    ]
    d = spark.createDataFrame([(i, f"http://h/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in html_main.extract_main(d).collect()}
    assert got == {0: f"{lead[0]}\n{body[0]}", 1: f"{lead[1]}\n{body[1]}", 2: body[2], 3: body[3], 4: body[3], 5: f"{body[2][:59]} {lead[3]}"}


def test_html_articles_keep_shared_sentences(spark):
    """A sentence that articles share stays; one that also stands outside all articles on another page goes, within a shard and across shards."""
    r = random.Random(5)
    shared, slipped, own = _say(r, 9), _say(r, 9), _say(r, 9)
    pages = [f"<article><p>{_say(r, 30)}</p><p>{shared}</p><p>{slipped}</p></article>" for _ in range(24)]
    pages[3] += f"<div>{slipped}</div>"
    pages[4] = f"<article><p>{_say(r, 30)}</p><p>{own}</p></article><div>{own}</div>"  # twice on one page only
    rows = [(i, f"http://h/{i}", p, "x") for i, p in enumerate(pages)] + [(50, "http://one/1", pages[0], "x"), (3, "http://h/3", pages[3], "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    lead = [p[12:].split("</p>")[0] for p in pages]
    want = {i: f"{lead[i]}\n{shared}" for i in range(24)} | {50: f"{lead[0]}\n{shared}\n{slipped}", 4: f"{lead[4]}\n{own}\n{own}"}
    want[3] = f"{lead[3]}\n{shared}\n{slipped}"  # no other page tells that it is furniture there, while the block outside is repeated
    for size in (4, 256):
        got = html_main.extract_main(d, shard_pages=size).collect()
        assert len(got) == 26 and {x["page_id"]: x["text"] for x in got} == want


def test_html_repeats_across_shards(spark):
    """A notice on two pages of a host goes, whatever the number of shards."""
    r = random.Random(2)
    notes = [_say(r, 12) for _ in range(20)]
    rows = [(i, f"http://h/{i}", f"<div>{_say(r, 20)}</div><div>{notes[i % 20]}</div>") for i in range(40)] + [(99, None, f"<div>{notes[0]}</div>")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: h[5:].split("</div>")[0] for i, _, h in rows}
    for size in (2, 256):
        assert {x["page_id"]: x["text"] for x in html_main.extract_main(d, shard_pages=size).collect()} == want


def test_decontamination_of_items_made_of_slots(spark):
    items = [(1, "What is 12 + 7 * 3 - 4 / 2 + 9?"), (2, "Alice Bob Carol Dave Emma Frank Grace Henry"), (3, "1 2 3 4 5 6 7 8 9 10"), (4, "7 8"), (5, "What is 12 + 7 * 3 - 4 / 2 + 9?")]
    texts = ["we ask: what is 12 + 7 * 3 - 4 / 2 + 9? no more", "what is 12 + 7 * 3 - 4 / 2 + 8?", "Alice Bob Carol Dave Emma Frank Grace", f"guests: {items[1][1]}.", f"{items[2][1]} {items[2][1]}", "7 8", None, "1 2 3 4 5"]
    texts += ["6 7 8 9 10 and the rest"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = sorted(tuple(x) for x in templates.find_leaks(d, bench).collect())
    assert got == [(0, 1, 1.0, "exact"), (0, 5, 1.0, "exact"), (3, 2, 1.0, "exact"), (4, 3, 1.0, "exact")]
    assert sorted(x["doc_id"] for x in templates.drop_leaks(d, bench).collect()) == [1, 2, 5, 6, 7, 8]


def _exact(texts, k=4):
    """Smallest place of each text's component, by comparing all pairs."""
    sets = [frozenset(tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)) for t in texts]
    comp = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    least = {}
    for i, c in enumerate(comp):
        least.setdefault(c, i)
    return {i: least[c] for i, c in enumerate(comp)}


def _family(r, n, edits, words=120):
    base = _say(r, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(*edits)):
            w[r.randrange(words)] = _say(r, 1)
        out.append(" ".join(w))
    return out


def test_near_duplicates_in_crowds_below_the_threshold(spark):
    """Families whose members are mostly a little less alike than a link asks for, so that few pairs of a crowd are links."""
    r = random.Random(4)
    texts = _family(r, 250, (2, 7)) + _family(r, 120, (4, 9)) + [_say(r, 60) for _ in range(30)]
    r.shuffle(texts)
    got = {x["doc_id"]: x["component_id"] for x in lsh_forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == _exact(texts)


def _edited(r, text, n):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = _say(r, 1)
    return " ".join(w)


def test_near_duplicates_lose_no_link_in_a_crowd_of_long_texts(spark):
    """240 edits of one text at a similarity of about 0.77, and 40 of them edited again to stand just above the threshold."""
    r = random.Random(12)
    base = _say(r, 900)
    crowd = [_edited(r, base, 15) for _ in range(240)]
    texts = crowd + [_edited(r, t, 23) for t in crowd[:40]]
    want = _exact(texts)
    assert sum(want[i] != i for i in want) >= 20
    got = {x["doc_id"]: x["component_id"] for x in lsh_forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == want


def test_near_duplicates_in_a_crowd_of_many_tiles(spark, monkeypatch):
    """The last step alone, with regions cut into tiles and products into slices."""
    r = random.Random(13)
    monkeypatch.setattr(lsh_forest, "TILE", 50)
    monkeypatch.setattr(lsh_forest, "SLICE", 64)
    monkeypatch.setattr(lsh_forest, "REACHES", (1, 4))
    base = _say(r, 150)
    crowd = [_edited(r, base, r.randint(3, 6)) for _ in range(300)]
    texts = crowd + [_edited(r, t, 3) for t in crowd[:60]] + [_say(r, 40) for _ in range(20)]
    got = {x["doc_id"]: x["component_id"] for x in lsh_forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == _exact(texts)


def test_near_duplicates_across_the_edges_of_partitions(spark, monkeypatch):
    """The same links, whether neighbours stand in one range partition and block or in several."""
    r = random.Random(8)
    texts = _family(r, 60, (0, 4)) + [_say(r, 50) for _ in range(20)] + _family(r, 40, (2, 6))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lsh_forest, "PART_ROWS", 400)
    monkeypatch.setattr(lsh_forest, "HELD_ROWS", 300)
    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", 260)
    got = {x["doc_id"]: x["component_id"] for x in lsh_forest.near_duplicates(d).collect()}
    assert got == _exact(texts)


def test_sketches_estimate_the_similarity():
    import numpy as np

    r = np.random.Generator(np.random.PCG64(3))
    for share in (0.5, 0.8, 0.95):
        both = r.integers(0, 2**63, int(400 * share)).astype(np.uint64)
        own = [r.integers(0, 2**63, (400 - len(both)) // 2).astype(np.uint64) for _ in range(2)]
        sig = [lsh_forest.minhash(np.concatenate((both, x))) for x in own]
        true = len(both) / (len(both) + len(own[0]) + len(own[1]))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.1


def test_near_duplicates_of_reused_ids(spark):
    import corpus_pipeline

    r = random.Random(6)
    a, b = _say(r, 60), _say(r, 60)
    docs = spark.createDataFrame([(5, a, "x"), (5, b, "x"), (3, b, "x"), (7, None, "x"), (None, a, "x")], "doc_id long, text string, source string")
    got = {(x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {(5, a), (3, b), (7, None), (None, a)}


def test_scores_do_not_depend_on_the_next_text():
    import numpy as np
    import pyarrow as pa

    from tessera.llm.textbytes import string_parts

    net = byte_cnn.Network()
    texts = ["a" * byte_cnn.HALF, "b" * (2 * byte_cnn.HALF - 1), "c", "", "d" * 700]
    score = lambda x: net.predict(*string_parts(pa.array(x)))
    alone = np.concatenate([score([t]) for t in texts])
    assert np.allclose(score(texts), alone, atol=1e-6, rtol=0) and np.allclose(score(texts[::-1])[::-1], alone, atol=1e-6, rtol=0)


def test_html_against_brute_force_on_a_large_host(spark):
    """All six-token windows of a host of several shards, compared page by page."""
    r = random.Random(9)
    run = html_main.RUN
    notes = [_say(r, 8) for _ in range(150)]  # most stand on two pages or three
    pages = []
    for i in range(330):
        body = [_say(r, r.randint(4, 15)) for _ in range(3)]
        pages.append([body[0], notes[r.randrange(150)], body[1] + " " + notes[r.randrange(150)], body[2]])
    pages[7] = list(pages[8])
    seen = {}
    for p, blocks_ in enumerate(pages):
        w = " ".join(blocks_).split()
        for k in range(len(w) - run + 1):
            seen.setdefault(tuple(w[k : k + run]), set()).add(p)
    want = {}
    for p, blocks_ in enumerate(pages):
        w = " ".join(blocks_).split()
        hit = [False] * len(w)
        for k in range(len(w) - run + 1):
            if len(seen[tuple(w[k : k + run])]) > 1:
                hit[k : k + run] = [True] * run
        at, left = 0, []
        for b in blocks_:
            n = len(b.split())
            if sum(hit[at : at + n]) < html_main.COVERED * n:
                left.append(b)
            at += n
        want[p] = "\n".join(left)
    rows = [(p, f"http://h.org/{p}", "".join(f"<div>{b}</div>" for b in blocks_)) for p, blocks_ in enumerate(pages)]
    rows.append((7, "http://h.org/7", rows[7][2]))  # a page that is stored twice is one page
    d = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for size in (64, 1000):
        got = html_main.extract_main(d, shard_pages=size).collect()
        assert len(got) == 331 and {x["page_id"]: x["text"] for x in got} == want


def test_html_attributes_are_read_by_whole_names(spark):
    page = '<article><p data-id="ad-12">kept one</p><p>see <a href="x?id=ad">kept link</a></p><div class="related-work">kept two</div><div class="ad-slot left">gone</div><div data-class=\'ad\' id=notice>gone</div><p title="a > class=ad">kept three</p><div class="comments">gone</div></article>'
    long = "<p>" + "word " * 60_000 + "</p><div><div><<p>></b></i>tail"
    d = spark.createDataFrame([(1, "http://a/1", page), (2, "http://a/2", long), (None, "http://a/3", "<p>no id</p>")], "page_id long, url string, html string")
    got = {x["page_id"]: x["text"] for x in html_main.extract_main(d).collect()}
    assert got[1] == "kept one\nsee kept link\nkept two\nkept three" and got[2].count("word") == 60_000 and got[2].endswith("tail") and got[None] == "no id"


def _leaks_by_brute_force(texts, items):
    """The definition of a leak, with dictionaries and tuples over ASCII texts whose names are all in the list."""
    import re

    numbers, units, names = set(templates.NUMBER_WORDS), set(templates.UNITS), set(templates.FIRST_NAMES)

    def canonical(text):
        out, last = [], None
        for m in re.finditer(r"[0-9]+|[A-Za-z]+", text):
            w = m[0].lower()
            after_number = last == "<number>"
            kind = "<number>" if w[0].isdigit() or w in numbers else "<unit>" if after_number and w in units else "<name>" if m[0][0].isupper() and w in names else None
            if kind and out and out[-1][0] == kind:
                out[-1][1].append(w)
            else:
                out.append((kind or w, [w], kind is not None))
            last = kind
        return out

    found = set()
    for item, text in items:
        c = canonical(text)
        w = min(templates.WINDOW, len(c))
        use = [o for o in range(len(c) - w + 1) if 2 * sum(not x[2] for x in c[o : o + w]) >= w]
        raw = lambda x: re.findall(r"[0-9]+|[a-z]+", x.lower())
        for k, t in enumerate(texts):
            if not use:  # no window can be told from chance: all raw tokens in a row
                if f" {' '.join(raw(text))} " in f" {' '.join(raw(t))} ":
                    found.add((k, item, 1.0, "exact"))
                continue
            d = canonical(t)
            covered, bound = set(), {}
            by = {}
            for p in range(len(d) - w + 1):
                for o in use:
                    if [x[0] for x in d[p : p + w]] == [x[0] for x in c[o : o + w]]:
                        by.setdefault(p - o, []).append((p, o))
            for _, hits in sorted(by.items(), key=lambda x: (-len(x[1]), x[0])):
                trial, fine = dict(bound), True
                for p, o in hits:
                    for i in range(w):
                        if c[o + i][2]:
                            fine &= trial.setdefault(tuple(c[o + i][1]), tuple(d[p + i][1])) == tuple(d[p + i][1])
                if fine:
                    bound = trial
                    covered |= {o for _, o in hits}
            if len(covered) >= templates.COVER * len(use):
                found.add((k, item, round(len(covered) / len(use), 6), "exact" if all(a == b for a, b in bound.items()) else "re-parameterised"))
    return found


def test_decontamination_against_brute_force(spark):
    r = random.Random(12)
    words = "basket river stone window garden market yellow slow carries paints sells finds under near before many".split()

    def sentence(n):
        return " ".join(r.choice([r.choice(words), r.choice(words), r.choice(words), str(r.randint(2, 40)), r.choice(["Alice", "Bob", "Carol", "Hans", "Pedro"]), r.choice(["three km", "zwei", "7 kg"])]) for _ in range(n))

    def renamed(t):
        return t.replace("Alice", "Emma").replace("Bob", "Frank").replace("zwei", "neun").replace("7 kg", "9 kg")

    items = [(i, sentence(r.randint(14, 30))) for i in range(25)]
    texts = [sentence(60) for _ in range(20)]
    for i, t in items:
        cut_ = t.split()
        texts += [f"{sentence(5)} {t} {sentence(5)}", f"{sentence(5)} {renamed(t)} {sentence(4)}", " ".join(cut_[: len(cut_) // 2]), renamed(" ".join(cut_[:10])) + " " + " ".join(cut_[10:]), t + " " + renamed(t)]
    texts += [texts[-1], ""]
    # No sentence opens here, so that a capital tells a name.
    texts = ["so " + t for t in texts]
    bench = spark.createDataFrame([(i, "so " + t) for i, t in items], "item_id long, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = _leaks_by_brute_force(texts, [(i, "so " + t) for i, t in items])
    got = {(x["doc_id"], x["item_id"], round(x["cover"], 6), x["kind"]) for x in templates.find_leaks(d, bench).collect()}
    assert got == want and {x[3] for x in want} == {"exact", "re-parameterised"}
    assert {x["doc_id"] for x in templates.drop_leaks(d, bench).collect()} == set(range(len(texts))) - {x[0] for x in want}


def test_decontamination_in_other_languages(spark):
    bench = spark.createDataFrame([(1, "der korb hat zwei volle kisten und drei leere kisten, wie viele kisten sind es"), (2, "le panier contient douze pommes vertes et cinq poires, combien de fruits y a-t-il")], "item_id long, text string")
    d = spark.createDataFrame([(1, "der korb hat zwölf volle kisten und neun leere kisten, wie viele kisten sind es"), (2, "le panier contient quinze pommes vertes et huit poires, combien de fruits y a-t-il"), (3, "der korb hat viele kisten"), (None, None)], "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["kind"]) for x in templates.find_leaks(d, bench).collect()}
    assert got == {(1, 1, "re-parameterised"), (2, 2, "re-parameterised")}


def test_license_variables_need_a_value(spark):
    plain = {k: t.replace("<<optional>>", "").replace("<</optional>>", "").replace("<<var:1>>", "3").replace("<<var:4>>", "MIT") for k, t in license_scan.TEMPLATES.items()}
    texts = ["SPDX-License-Identifier:", "SPDX-License-Identifier: MIT", "licensed under the GNU General Public License, version", "licensed under the GNU General Public License, version 2", *plain.values()]
    texts += [plain["mit-text"].replace("noninfringement", "something"), "mit license " * 50_000, plain["bsd-text"].replace("1.", "").replace("2.", "")]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[1], "x")]
    got = {r["doc_id"]: (r["labels"].split(","), r["n_base"]) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()}
    assert got[0][0] == [""] and got[1][0] == ["spdx-tag"] == got[None][0] and got[2][0] == ["gpl"] and "gpl-notice" in got[3][0]
    for i, name in enumerate(plain):
        assert name in got[4 + i][0]
    at = 4 + len(plain)
    assert got[at][0] == ["mit-permission"] and got[at + 1] == (["mit"], 50_000) and "bsd-text" in got[at + 2][0]


def test_classifier_against_a_slow_forward_pass():
    """Filters position by position, chunk by chunk, text by text."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm.textbytes import string_parts

    net = byte_cnn.Network(3)
    net.p["mu"] += 0.1
    half, width, p = byte_cnn.HALF, byte_cnn.WIDTH, net.p
    texts = ["", "a", "b" * half, "xy" * half, "é" * 200, "one two three " * 90, "one two three " * 90]

    def slow(text):
        raw = text.encode()
        n = max(1, -(-len(raw) // half))
        data = raw.ljust(n * half, b"\0") + b"\0" * (width - 1)
        best = [[max(sum(p["table"][k][data[h * half + i + k]][f] for k in range(width)) for i in range(half)) for f in range(byte_cnn.FILTERS)] for h in range(n)]
        chunks = [np.maximum(best[i], best[i + 1]) for i in range(n - 1)] or [np.array(best[0])]
        hidden = [np.maximum((c - p["mu"]) @ p["w1"] + p["b1"], 0) for c in chunks]
        f = np.concatenate([np.mean(hidden, axis=0), np.max(hidden, axis=0), [np.log1p(len(raw)) / 8]])
        return 1 / (1 + np.exp(-(f @ p["w2"] + p["b2"][0])))

    got = net.predict(*string_parts(pa.array(texts)))
    assert np.allclose(got, [slow(t) for t in texts], atol=1e-4) and got[-1] == got[-2]
