import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from corpus_search.llm import bpe
from corpus_search.llm.common import documents  # noqa: F401

PATH = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rnd = random.Random(1)
    symbols = [*" \n\t  'sthed.,!?0123éñß漢字\r\x1c\u0085 　", "<|endoftext|>", " the", " hello", "'ll", "😀", "É", "×", "÷", "'", "s", "re", "ö"]
    made = ["".join(rnd.choice(symbols) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    return [*made, "", "a" * 3000, "ab " * 500, " " * 100, "1" * 700, "\n\n x", "x  ", "it's we'LL don't"]


def test_ids_and_text_equal_the_tokenizer(tmp_path):
    own, every = Tokenizer.from_file(PATH), texts()
    words = [p.as_py() for p in bpe.cut_words(pa.array(every[:200]))[0]]
    words = [w for w in words if not bpe.regex.search(bpe.WIDE_SPACE + "|endoftext", w.decode())]
    for frequent in ([], words):
        path = tmp_path / f"lexicon-{len(frequent)}"
        path.write_bytes(bpe.compile_lexicon(PATH, frequent))
        codec = bpe.Codec(str(path))
        ids, ends = codec.encode(pa.array(every))
        for k, text in enumerate(every):
            got = ids[ends[k] : ends[k + 1]]
            assert got.tolist() == own.encode(text, add_special_tokens=False).ids
            assert codec.decode(got)[0].tobytes().decode() == own.decode(got.tolist(), skip_special_tokens=False)


def test_transducer_is_minimal_and_counts():
    words = sorted({b"tap", b"taps", b"top", b"tops", b"star", b"stars"})
    t = bpe.transducer(words)
    assert len(t["final"]) == 8  # "ta" and "to" are one state, and so are the ends of "tap" and "star"
    state_of = {int(k): (int(n), int(a)) for k, n, a in zip(t["arc_keys"], t["arc_next"], t["arc_add"])}
    for place, w in enumerate(words):
        state, total = int(t["meta"][0]), 0
        for b in w:
            state, add = state_of[state * 256 + b]
            total += add
        assert t["final"][state] and total == place


def test_round_trip_over_rows(spark):
    rows = [(1, "the cat sat"), (1, "the cat sat"), (2, None), (None, "  x\n"), (3, "")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, ids int")
    got = bpe.round_trip(spark, docs, PATH).collect()
    own = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = own.encode(t or "", add_special_tokens=False).ids
        sha = hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        want.append((i, len(ids), sha, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.round_trip(spark, docs.limit(0), PATH).count() == 0


def test_ids_array(spark):
    docs = spark.createDataFrame([(1, "the cat sat on it")], "doc_id long, text string")
    lexicon = bpe.build_lexicon(docs, "text", PATH)
    coded = bpe.encode_documents(docs, lexicon)
    got = coded.select(bpe.ids_array(coded["ids"]).alias("a")).first()["a"]
    assert got == Tokenizer.from_file(PATH).encode("the cat sat on it", add_special_tokens=False).ids
    assert np.all(np.array(got) >= 0)


@pytest.mark.parametrize("word", [b"abcabcabc" * 30, b"aaaaaaaaaaaaaaaa" * 10])
def test_long_and_short_merging_agree(word):
    spec = bpe.read_tokenizer(PATH)
    merge = bpe.Merger(spec["merges"], spec["byte_ids"])
    ids = [merge.byte_ids[b] for b in word]
    assert merge._short(list(ids)) == merge._long(list(ids))
