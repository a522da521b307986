from datetime import datetime as D

from chunkloom.operators import orphans as O


def test_pack_round_trip():
    import numpy as np

    for places in ([], [0], [5, 32767], list(range(0, 32768, 2)), list(range(9000))):
        bits = np.zeros(O.RANGE_BITS, np.uint8)
        bits[places] = 1
        raw = np.packbits(bits, bitorder="little").tobytes()
        packed = O.pack(raw)
        assert (O.unpack(packed) == bits).all()
        assert len(packed) <= len(raw) + 1


def ref(spark, rows):
    df = spark.createDataFrame(rows, "ref_id long, key string, at timestamp")
    return O.Reference("t", "f", "k", df)


def parents(spark, rows):
    return spark.createDataFrame(rows, "kind string, key string, since timestamp, gone boolean")


def test_missing_gone_late_null_and_repeated(spark):
    jan, mid, feb = D(2025, 1, 1), D(2025, 1, 15), D(2025, 2, 1)
    r = ref(spark, [(1, "a", mid), (1, "a", mid), (2, "b", mid), (3, "c", mid), (4, "d", mid), (5, None, mid), (6, "a", None), (7, "x", None), (8, "c", feb), (9, "a", jan)])
    p = parents(spark, [("k", "a", jan, False), ("k", "b", jan, True), ("k", "c", D(2025, 1, 20), False), ("k", "d", None, False), ("other", "x", jan, False)])
    got = {(x.ref_id, x.month) for x in O.orphans([r], p).collect()}
    assert got == {(2, "2025-01"), (3, "2025-01"), (4, "2025-01"), (7, "9999-99")}
    assert O.orphans([ref(spark, [])], p).count() == 0
    assert O.orphans([r], parents(spark, [])).select("ref_id").distinct().count() == 8


def test_many_keys_in_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "RANGE_FILL", 50)
    r = ref(spark, [(i, str(i % 700), D(2025, 1 + i % 5, 2)) for i in range(3000)])
    p = parents(spark, [("k", str(i), D(2025, 1 + i % 6, 3), i % 11 == 0) for i in range(0, 700, 2)])
    want = set()
    for i in range(3000):
        k = i % 700
        if k % 2 or k % 11 == 0 or D(2025, 1 + k % 6, 3) > D(2025, 1 + i % 5, 2):
            want.add(i)
    assert {x.ref_id for x in O.orphans([r], p).collect()} == want


def test_state_of_chunks(spark):
    rows = [(1, D(2025, 1, 1), None, False), (1, D(2025, 1, 1), D(2025, 2, 1), True), (2, D(2025, 1, 1), D(2025, 3, 1), False), (2, D(2025, 1, 1), D(2025, 2, 1), True), (3, D(2025, 1, 1), None, None)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, updated_at timestamp, is_deleted boolean")
    assert {r.key: r.gone for r in O.chunk_parents(df).collect()} == {"1": True, "2": False, "3": False}
