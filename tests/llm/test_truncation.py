import math
import random
import re

import pandas as pd

from chunkloom.llm import truncation as X

NOUNS = "queue graph shard window ledger cursor token batch".split()
VERBS = "reads writes keeps drops moves checks".split()


def sentence(rng):
    return f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} the {rng.choice(NOUNS)} before the {rng.choice(NOUNS)} {rng.choice(VERBS)} it."


def text(rng):
    out = " ".join(sentence(rng) for _ in range(rng.randrange(2, 6)))
    end = rng.random()
    if end < 0.2:
        out += "\n\nRegards,\n" + rng.choice(["Lapefa", "Komoda", "Tamteda", "Rolinge", "Vejarda"])
    elif end < 0.4:
        out += "".join(f"\n- {rng.choice('trim load sync'.split())} the {rng.choice(NOUNS)} {rng.choice(NOUNS)}" for _ in range(3))
    elif end < 0.5:
        out += "\n\nMore next week..."
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows, cut = [], set()
    for k in range(n):
        t = text(rng)
        if k % 12 == 0:
            body = " ".join(sentence(rng) for _ in range(4))
            at = body.rfind(" ", 0, len(body) - 20)
            t = body[: at + rng.randrange(3, 5)] + rng.choice(["", "...", "…", "\ufffd"])
            if t.rstrip(".…\ufffd")[-1:] in " .":
                t = body[: at + 3]
            cut.add(k)
        rows.append((k, t, "en", f"S{k % 3} ", "document"))
    return rows, cut


def test_held_out_accuracy(spark):
    rows, cut = corpus(1500)
    df = spark.createDataFrame([(*r, True, 0.0) for r in rows], "doc_id long, text string, lang string, source string, source_type string, cut boolean, log_odds double")
    got = {r.doc_id for r in X.found(df).collect()}
    assert len(got & cut) >= 0.9 * len(cut)
    assert len(got - cut) <= 0.05 * len(cut)
    report = {r.source: r for r in X.report(df).collect()}
    assert set(report) == {"s0", "s1", "s2"} and sum(r.documents for r in report.values()) == 1500


def model():
    rng = random.Random(7)
    texts = [text(rng) for _ in range(800)]
    fenced = ["Look:\n```\n" + "\n".join(f"x = {rng.randrange(9)}" for _ in range(9)) + "\n```\n" + text(rng) * (k % 2) for k in range(60)]
    tables = ["| a | b |\n|---|---|\n" + "| c | d |\n" * rng.randrange(2, 5) for _ in range(30)]
    code = ["int f(int a) {\n" + "    a += 1;\n" * rng.randrange(2, 9) + "    return a;\n}\n" for _ in range(60)]
    plain = texts + fenced + tables
    return X.train([*plain, *code], [False] * len(plain) + [True] * len(code))


def cut(m, said, code=False):
    return X.judge(m, said, code)[1] < 0


def test_the_state_of_the_whole_text():
    m = model()
    assert m["states"]["open"] < -3 < 0 < m["states"]["closed"]
    assert X.judge(m, None, False) is None and X.judge(m, "", False) is None and X.judge(m, " \n\t", False) is None
    assert X.judge(m, "Look:\n```\nx = 1\n", False)[0] < X.judge(m, "Look:\n```\nx = 1\n```", False)[0] - 3
    assert cut(m, "Look:\n```\nx =")
    assert not cut(m, "Look:\n```\nx = 1\n```")
    assert X.judge(m, "int f() {\n    return 1;\n", True)[0] < X.judge(m, "int f() {\n    return 1;\n}\n", True)[0]
    assert not cut(m, "| a | b |\n|---|---|\n| c | d |")
    assert not cut(m, "The queue reads the graph. It is called aaaaaaaaaaaa.")
    assert not cut(m, "word " * 100_000 + "end.")


def test_without_a_model_nothing_is_judged_by_rules():
    assert X.judge(X.EMPTY, "Look:\n```\nx = 1\n", False)[0] == X.judge(X.EMPTY, "Look:\n```\nx = 1\n```", False)[0]


def test_threshold_of_a_language(spark):
    assert X.valley({}) == 0.0
    assert X.valley({-4: 5, -3: 5, -2: 9, -1: 9, 0: 9, 1: 9, 2: 0, 3: 0, 4: 0, 5: 0}) == 1.0
    rows = [(k, "s", "de", 0.0, -0.3 if k < 60 else 3.0) for k in range(200)] + [(k, "s", "en", 0.0, 0.9 if k % 2 else -0.8) for k in range(100)] + [(1, "s", "fr", 0.0, -0.2), (2, "s", "", None, None)]
    each = spark.createDataFrame(rows, "doc_id long, source string, language string, log_odds double, margin double")
    assert X.thresholds(each) == {"de": 0.25, "en": 0.0, "fr": 0.0}


def test_another_column(spark):
    rows, cut_ = corpus(600)
    df = spark.createDataFrame([(*r[:1], "x", *r[2:], r[1]) for r in rows], "doc_id long, text string, lang string, source string, source_type string, summary string")
    got = {r.doc_id for r in X.found(df, "summary").collect()}
    assert len(got & cut_) >= 0.9 * len(cut_)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, source_type string"
    rows = [(1, None, None, None, None), (2, "", None, None, None), (None, "The queue re", "en", "a", "document"), (3, "The queue reads the graph.", None, "A", None), (3, "The queue reads the graph.", None, "A", None)]
    assert X.found(spark.createDataFrame(rows, schema)).count() == 0
    assert X.found(spark.createDataFrame([], schema)).count() == 0
    assert X.report(spark.createDataFrame([], schema)).count() == 0


SCHEMA = "doc_id long, text string, lang string, source string, source_type string"


def test_contexts_are_counted_over_all_texts(spark):
    rng = random.Random(3)
    # single letters are never folded, so plain counting gives the truth; 5.5 million characters
    texts = ["".join(rng.choices(["a ", "b ", "b\n", "c "], k=k)) + "b" for k in [340_000] * 8 + [30] * 40]
    df = spark.createDataFrame([(k, t, "en", "s", "document") for k, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {r.doc_id: r.log_odds for r in X.judged(df).where("doc_id >= 46").collect()}
    for doc, odds in got.items():
        p = None
        for depth in range(X.ORDER + 1):
            context = re.escape(texts[doc][len(texts[doc]) - depth :]) if depth else r"(?<=[^\n])"
            seen = [m[1] for t in texts for m in re.finditer(f"(?={context}(\n|\\Z|))", t)]
            ended, seen = sum(x == "\n" for x in seen), len(seen)
            ended += sum(t.endswith(texts[doc][len(texts[doc]) - depth :]) for t in texts)
            ended, seen = ended - 1, seen - 1  # the text itself doesn't tell
            if p is None:
                p = (ended + 0.05) / (seen + 0.1)
                continue
            if seen < X.LEAST:
                break
            p = (ended + X.STRENGTH * p) / (seen + X.STRENGTH)
            if not ended and seen >= X.PURE:
                break
        assert abs(odds - math.log(p / (1 - p))) < 1e-6
    assert len(got) == 2


def test_tasks_count_what_one_process_counts(spark):
    rows, _ = corpus(300)
    rows += [(k, "int f(int a) {\n" + "    a += 1;\n" * (k % 7) + "    return a;\n" + "}\n" * (k % 3 > 0), None, None, "code") for k in range(300, 340)]
    rows += [(k, "Look:\n```\nx = 1\n" + "```\n" * (k % 4 > 0), "de", "b", None) for k in range(340, 360)]
    m = X.train([r[1] for r in rows], [r[4] == "code" for r in rows])
    got = {r.doc_id: r.log_odds for r in X.judged(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    assert len(got) == 360
    for k, t, _, _, kind in rows:
        assert abs(got[k] - X.judge(m, t, kind == "code", trained=True)[0]) < 1e-9


def test_long_texts_are_counted_in_pieces(monkeypatch):
    rng = random.Random(5)
    said = "\n".join(rng.choice([text(rng), "```\nx = f(1)\n\ny = 2\n```", "| a | b |", "see https://a.b/c?d for it", " ".join(text(rng).split() * 9), "  ```", "# Head"]) for _ in range(400))
    texts, code = [said, text(rng), said[9:30000]], [False, False, True]
    known = X.train(texts[1:2], code[1:2])["known"]

    def counted():
        groups = list(X.chunks(texts, code))
        words = pd.concat([X.word_counts(g) for g in groups]).groupby("word").agg({"count": "sum", "first": "sum", "free": "max"})
        contexts = X.added([X.context_counts(g, known) for g in groups])
        return len(groups), words, contexts.set_index("context").sort_index()

    n, words, contexts = counted()
    monkeypatch.setattr(X, "CHUNK", 1500)
    more, words_, contexts_ = counted()
    assert n == 1 and more > 50
    assert words.sort_index().equals(words_.sort_index())
    assert contexts.equals(contexts_)


def test_cuts_do_not_vouch_for_each_other():
    whole = [f"void f{k}(int a) {{\n    if (!{NOUNS[k % 8]}) {{\n        {VERBS[k % 6]}(a);\n    }}\n}}\n" for k in range(96)]
    cuts = [f"void g(int a) {{\n    if (!{noun[:k]}" for noun in NOUNS for k in (3, 4) if noun[:k] != noun]
    m = X.train([*whole, *cuts], [True] * (len(whole) + len(cuts)))
    assert all(X.judge(m, t, True, trained=True)[1] < 0 for t in cuts)
    assert not any(X.judge(m, t, True, trained=True)[1] < 0 for t in whole)
