import random

import pytest

from chunkloom.llm import leakage as L

WORDS = [f"w{k}" for k in range(400)]


def item(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def brute_longest(items, doc):
    """The longest match that ends at each word."""
    held = {tuple(x[a:b]) for x in items for a in range(len(x)) for b in range(a + 1, len(x) + 1)}
    out = []
    for e in range(1, len(doc) + 1):
        n = 0
        while n < e and tuple(doc[e - n - 1 : e]) in held:
            n += 1
        out.append(n)
    return out


def test_automaton_matches_brute_force():
    rng = random.Random(3)
    items = [[rng.choice("abc") for _ in range(rng.randrange(5, 14))] for _ in range(6)]
    auto = L.build(items)
    for _ in range(30):
        doc = [rng.choice("abcd") for _ in range(40)]
        ids = [auto.vocabulary.get(w, -1) for w in doc]
        want = brute_longest(items, doc)
        for v, n, at in L.events(auto, ids):
            assert want[at] == n
            for k, end, longest in auto.places[v].tolist():
                m = min(n, longest)
                assert items[k][end - m + 1 : end + 1] == doc[at - m + 1 : at + 1]


def test_rules(spark):
    rng = random.Random(5)
    items = [item(rng, 60) for _ in range(30)]
    pad = lambda n: ["x%d" % rng.randrange(10**6) for _ in range(n)]
    docs, want = [], set()

    def add(words, leaks):
        docs.append((len(docs), " ".join(words)))
        want.update((len(docs) - 1, i) for i in leaks)

    add(pad(50) + items[0] + pad(50), [0])
    add(pad(20) + items[1][:31] + pad(20), [1])  # half
    add(pad(20) + items[1][:24] + pad(20), [])  # a shorter quote
    changed = list(items[2])
    for k in range(4, 60, 8):
        changed[k] = "changed"
    add(pad(9) + changed + pad(9), [2])
    added = [y for k, w in enumerate(items[3]) for y in ([w, "added"] if k % 9 == 4 else [w])]
    add(added, [3])
    mixed = list(items[4])
    rng.shuffle(mixed)
    add(mixed, [])
    apart = [y for k in range(0, 60, 10) for y in items[5][k : k + 10] + pad(30)]
    add(apart, [])  # in no single passage
    add(items[6] + items[7], [6, 7])
    docs.append((len(docs), "<p>" + ", ".join(w.upper() for w in items[8]) + "</p>\n> \\n"))
    want.add((len(docs) - 1, 8))
    docs.append((len(docs), " ".join(items[9]).replace(" ", "\\n") + "&amp;"))
    want.add((len(docs) - 1, 9))
    docs += [(100, None), (101, ""), (102, "   "), (0, docs[0][1]), (103, " ".join(pad(300_000) + items[10]))]
    want.add((103, 10))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(200, None), (201, ""), (202, "one two"), (0, " ".join(items[0]))], "item_id long, text string")
    found = L.found(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    whole = next(r for r in found if r.doc_id == 0)
    assert (whole.words_held, whole.first_word, whole.last_word) == (60, 50, 110)
    assert L.scrub(docs[0][1], [(50, 110)]).split() == docs[0][1].split()[:50] + docs[0][1].split()[110:]
    assert L.found(d.limit(0), i).count() == 0 and L.found(d, i.limit(0)).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "ITEM_CHARS", 300)
    monkeypatch.setattr(L, "BROADCAST_BYTES", 60_000)
    rng = random.Random(6)
    items = [item(rng, 40) for _ in range(12)]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "doc_id long, text string")
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in L.found(d, i).collect()} == {(k, k) for k in range(12)}


@pytest.mark.parametrize("n", [20, 100, 400, 1600])
@pytest.mark.parametrize("kind", ["added", "changed"])
def test_long_items_with_one_word_in_eight(n, kind):
    rng = random.Random(n)
    words = [f"u{rng.randrange(5000)}" for _ in range(n)]
    body = [y for k, w in enumerate(words) for y in (([w, "more"] if kind == "added" else ["other"]) if k % 8 == 3 else [w])]
    doc = [f"u{rng.randrange(5000)}" for _ in range(300)] + body + [f"u{rng.randrange(5000)}" for _ in range(300)]
    auto = L.build([words])
    (found,) = L.leaks(auto, [[auto.vocabulary.get(w, -1) for w in doc]])
    assert n - 4 <= found[2] + (0 if kind == "added" else (n + 4) // 8) <= n
    assert abs(found[3] - 300) <= 5 and abs(found[4] - 300 - len(body)) <= 5


def test_each_passage_of_an_item_comes_out():
    words = [f"v{k}" for k in range(30)]
    doc = ["x"] * 3 + words + ["x"] * 5 + words[:20] + ["x"] * 300 + words
    auto = L.build([words])
    found = L.leaks(auto, [[auto.vocabulary.get(w, -1) for w in doc]])
    assert sorted(x[2:] for x in found) == [(20, 38, 58), (30, 3, 33), (30, 358, 388)]


def test_scrub_keeps_all_else():
    text = "<p>Hello \"caf&eacute;\" w\\u00f6rld\\n <b>big</b> ﬁne été day"
    assert L.words(text) == ["hello", "café", "wörld", "big", "fine", "été", "day"]
    assert L.scrub(text, [(1, 3)]) == "<p>Hello \"\\n <b>big</b> ﬁne été day"
    assert L.scrub(text, [(5, 6), (4, 5)]) == "<p>Hello \"caf&eacute;\" w\\u00f6rld\\n <b>big</b>  day"
    assert L.scrub(None, [(0, 1)]) is None and L.scrub("", [(0, 1)]) == ""


def test_without_leaks(spark):
    words = [f"w{k}" for k in range(40)]
    d = spark.createDataFrame([(1, "<b>before</b> " + " ".join(words) + " after."), (2, "nothing here"), (3, None), (4, "")], "doc_id long, text string")
    i = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    out = {r.doc_id: (r.text, r.removed) for r in L.without_leaks(d, i).collect()}
    assert out == {1: ("<b>before</b>  after.", 40), 2: ("nothing here", 0), 3: (None, 0), 4: ("", 0)}
    assert L.without_leaks(d, i, least=41).where("removed > 0").count() == 0
