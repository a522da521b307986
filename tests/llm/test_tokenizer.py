from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.llm import tokenizer as T


def library():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


LIBRARY = library()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_same_ids_as_the_other_library_and_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = T.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert T.encode(text, least=7) == ids
    assert T.encoding().decode_bytes(ids) == text.encode()


def test_special_empty_and_long():
    assert T.encode(None) == [] and T.encode("") == []
    assert 50256 not in T.encode("a <|endoftext|> b")
    long = "x" * 120_000 + " tail\n" + "word  two\n\n" * 20_000
    assert T.encode(long) == LIBRARY.encode(long, add_special_tokens=False).ids


def test_table(spark):
    rows = [(1, "Hello wörld", 1), (2, None, 1), (3, "", 1), (3, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in T.encoded(df).collect()]
    assert sorted(got) == [(1, T.encode("Hello wörld")), (2, []), (3, []), (3, [])]
    back = T.encoded(df).select("doc_id", T.decode_column("ids").alias("raw")).collect()
    assert {r.doc_id: bytes(r.raw).decode() for r in back} == {1: "Hello wörld", 2: "", 3: ""}
    assert T.encoded(df.limit(0)).count() == 0
