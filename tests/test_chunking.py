from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_search.operators import chunking


def _rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("doc_id", "chunk_index").collect()]


def test_chunk_fixed_edges(spark):
    docs = spark.createDataFrame(
        [(1, "s", ""), (2, "s", "abc"), (3, "s", "abcdefghij"), (4, "s", "abcdefghijk"), (5, "s", None)],
        "doc_id long, source string, text string",
    )
    out = _rows(chunking.chunk_fixed(docs, size=10, overlap=3), "doc_id", "chunk_index", "start", "text")
    assert out == [
        (2, 0, 1, "abc"),
        (3, 0, 1, "abcdefghij"),
        (4, 0, 1, "abcdefghij"),
        (4, 1, 8, "hijk"),
    ]


def test_chunk_fixed_code_points(spark):
    docs = spark.createDataFrame([(1, "s", "é😀" * 6)], "doc_id long, source string, text string")
    out = _rows(chunking.chunk_fixed(docs, size=5, overlap=1), "doc_id", "text")
    # 12 code points, windows start at 1, 5, 9 (odd positions hold é)
    assert [t for _, t in out] == ["é😀é😀é", "é😀é😀é", "é😀é😀"]


def test_chunk_tokens(spark):
    docs = spark.createDataFrame([(1, "s", "  a b\tc\nd e  "), (2, "s", "   ")], "doc_id long, source string, text string")
    out = _rows(chunking.chunk_tokens(docs, size=3, overlap=1), "doc_id", "chunk_index", "text", "n_tokens")
    assert out == [(1, 0, "a b c", 3), (1, 1, "c d e", 3)]


def test_length_guard(spark):
    docs = spark.createDataFrame([(1, "x" * 25), (2, "short")], "doc_id long, text string")
    out = [(r.doc_id, r.piece, len(r.text)) for r in chunking.length_guard(docs, limit=20, slice_size=10).orderBy("doc_id", "piece").collect()]
    assert out == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, 0, 5)]


def test_chunk_ids_deterministic(spark):
    docs = spark.createDataFrame([(7, "s", "abcdef" * 50)], "doc_id long, source string, text string")
    a = chunking.with_chunk_ids(chunking.chunk_fixed(docs, size=100, overlap=10)).select("chunk_id").collect()
    b = chunking.with_chunk_ids(chunking.chunk_fixed(docs.repartition(3), size=100, overlap=10)).select("chunk_id").collect()
    assert sorted(a) == sorted(b)


def test_recursive_separator_choice():
    assert chunking.split_recursive("", 10, 2) == []
    assert chunking.split_recursive("   \n  ", 10, 2) == []
    text = "para one.\n\npara two is here.\n\nthree"
    out = chunking.split_recursive(text, 20, 0)
    assert out == ["para one.", "para two is here.", "three"]
    # one word longer than the size falls through to single characters
    assert chunking.split_recursive("abcdefghij", 4, 0) == ["abcd", "efgh", "ij"]
    # no separator matches and "" is not allowed: hard cut
    assert chunking.split_recursive("abcdefghij", 4, 0, separators=("\n",)) == ["abcd", "efgh", "ij"]


@settings(max_examples=150, deadline=None)
@given(
    st.text(alphabet=st.sampled_from(list("ab c.\n\té😀")), max_size=400),
    st.integers(min_value=2, max_value=60),
    st.data(),
)
def test_recursive_properties(text, size, data):
    overlap = data.draw(st.integers(min_value=0, max_value=size - 1))
    chunks = chunking.split_recursive(text, size, overlap)
    pos = 0
    for c in chunks:
        assert 0 < len(c) <= size
        assert c == c.strip("\t\n\x0b\f\r ")
        i = text.find(c, max(0, pos - size))
        assert i >= 0, "chunk must be a substring in source order"
        pos = i
    covered = "".join(chunks)
    for ch in set(text) - set("\t\n\x0b\f\r "):
        assert ch in covered


def test_chunk_recursive_partition_invariant(spark):
    rows = [(i, "s", ("word " * (i * 7)) + "\n\nend.") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    a = chunking.chunk_recursive(docs, size=40, overlap=10).collect()
    b = chunking.chunk_recursive(docs.repartition(5), size=40, overlap=10).collect()
    assert sorted(a) == sorted(b)
    direct = sum(len(chunking.split_recursive(t, 40, 10)) for _, _, t in rows)
    assert len(a) == direct
