import random

import pytest
from pyspark.sql import functions as F

from chunkloom.operators import graph


@pytest.mark.parametrize("k", [1, 4, 60])
def test_boost_is_that_of_a_whole_search(spark, monkeypatch, k):
    """The best k by depth and id, whatever is left out on the way; a full query does not search on."""
    draw = random.Random(11)
    names = ["alpha one", "beta", "gamma alpha", "hub"]
    ents = [(n, names[n] if n < 4 else f"x{n}", 1, None if n % 3 else n * 10) for n in range(120)]
    pairs = [(3, n) for n in range(40, 80)] + [(draw.randrange(120), draw.randrange(120)) for _ in range(70)]
    attr = [(n, -1 if n % 7 == 0 else 5000 - n) for n in range(0, 120, 2)]
    asked = [(7, "alpha"), (2, "alpha"), (3, "beta"), (4, "hub beta"), (5, "nothing")]
    entities = spark.createDataFrame(ents, "id long, canonical_name string, mentions long, chunk_id long")
    deps = spark.createDataFrame([(a, b, "calls", None) for a, b in pairs], "source_entity long, target_entity long, dep_type string, valid_to timestamp")
    attributes = spark.createDataFrame(attr, "entity_id long, chunk_id long")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    searched = []
    whole = graph.seed_entities
    monkeypatch.setattr(graph, "seed_entities", lambda e, q: searched.append(q.count()) or whole(e, q))
    got = {(r.query_id, r.id): r.score for r in graph.graph_boost(entities, deps, attributes, queries, k).collect()}
    near, held = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    for n, c in [(n, c) for n, _, _, c in ents if c is not None] + [(n, c) for n, c in attr if c != -1]:
        held.setdefault(n, set()).add(c)
    want = {}
    for q, text in asked:
        depth = {n: 0 for n, name, _, _ in ents if any(w in name for w in text.split())}
        for d in range(1, 4):
            depth.update({m: d for n in [n for n in depth if depth[n] == d - 1] for m in near.get(n, ()) if m not in depth})
        best = {}
        for n, d in depth.items():
            for c in held.get(n, ()):
                best[c] = min(best.get(c, 9), d)
        want.update({(q, c): 0.2 * 0.5**d for d, c in sorted((d, c) for c, d in best.items())[:k]})
    assert got == pytest.approx(want) and want and searched == [4]
