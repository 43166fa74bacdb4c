"""Byte-level BPE encoding and decoding with a memory-mapped lexicon transducer.

Frequent words of the corpus (counted over all documents) are encoded once, by exact merging,
and compiled into a minimal acyclic transducer: an automaton with shared prefixes and shared
suffixes whose arcs carry numbers; their sum along a word is the word's place in the sorted
word list, which leads to its token ids. The transducer, the merge table and the vocabulary
are one flat file that Spark hands to the executors (``addFile``) and tasks memory-map. Words
that the lexicon lacks are merged exactly, so the lexicon changes speed, never results.

Null text counts as empty; an empty text has no tokens. Texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import heapq
import json
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_search.llm.common import no_nulls, ranges, scratch, text_bytes, utf8_parts, written

# Fixed values of the byte-level tokenizer format: how it cuts text into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
# White space outside ASCII: texts that hold any of it take the plain path.
WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

_SECTIONS = ("vocab_ends", "vocab_bytes", "merges", "byte_ids", "specials", "arc_keys", "arc_next", "arc_add", "final", "out_ends", "out_ids", "meta")


def _byte_symbols() -> dict[str, int]:
    """The format's printable stand-in for each byte: itself where printable, else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_tokenizer(path: str) -> dict:
    """Vocabulary (bytes by id), merges as (left id, right id, new id) by rank, and special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    symbols, vocab = _byte_symbols(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *special.values()]) + 1
    words = [b""] * size
    for s, i in vocab.items():
        words[i] = bytes(symbols[c] for c in s)
    for s, i in special.items():
        words[i] = s.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
    byte_ids = np.full(256, -1, np.int64)
    for s, b in symbols.items():
        byte_ids[b] = vocab.get(s, -1)
    return {"words": words, "merges": merges, "byte_ids": byte_ids, "special": special}


class Merger:
    """Exact merging of one word: the pair of lowest rank first, the leftmost of equal ones."""

    def __init__(self, merges: np.ndarray, byte_ids: np.ndarray):
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges.tolist())}
        self.byte_ids = byte_ids.tolist()

    def __call__(self, word: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in word]
        return self._short(ids) if len(ids) <= 48 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        rank, top = self.rank, (1 << 60, -1)
        while len(ids) > 1:
            best, at = top, -1
            for i in range(len(ids) - 1):
                r = rank.get((ids[i], ids[i + 1]), top)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = c, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if r := rank.get((c, ids[after[i]])):
                    heapq.heappush(heap, (r[0], i, c, ids[after[i]], r[1]))
            if (h := before[i]) >= 0 and (r := rank.get((ids[h], c))):
                heapq.heappush(heap, (r[0], h, ids[h], c, r[1]))
        return [x for x in ids if x >= 0]


def transducer(words: list[bytes]) -> dict[str, np.ndarray]:
    """Minimal acyclic transducer of sorted distinct words; arcs add up to the word's place.

    States are made from the end of the words backwards: a branch is closed when the next word
    leaves it, and a closed state equal to an earlier one (same finality, same arcs) is shared.
    """
    known: dict[tuple, int] = {}
    arcs_of: list[tuple] = []
    final: list[bool] = []
    count: list[int] = []

    def close(is_final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (is_final, tuple(arcs))
        if key not in known:
            known[key] = len(arcs_of)
            arcs_of.append(key[1])
            final.append(is_final)
            count.append(is_final + sum(count[t] for _, t in arcs))
        return known[key]

    branch: list[list] = [[False, []]]  # from the root: [final, closed arcs]
    last = b""
    for w in words:
        same = len(os.path.commonprefix([last, w]))
        for depth in range(len(last), same, -1):
            state = close(*branch.pop())
            branch[-1][1].append((last[depth - 1], state))
        branch.extend([False, []] for _ in range(len(w) - same))
        branch[-1][0] = True
        last = w
    for depth in range(len(last), 0, -1):
        state = close(*branch.pop())
        branch[-1][1].append((last[depth - 1], state))
    root = close(*branch[0])
    keys, to, add = [], [], []
    for s, arcs in enumerate(arcs_of):
        passed = int(final[s])
        for b, t in arcs:
            keys.append(s * 256 + b)
            to.append(t)
            add.append(passed)
            passed += count[t]
    return {
        "arc_keys": np.array(keys, np.int64), "arc_next": np.array(to, np.int64), "arc_add": np.array(add, np.int64),
        "final": np.array(final, np.int64), "meta": np.array([root, max((len(w) for w in words), default=0)], np.int64),
    }


def _pack(parts: dict[str, np.ndarray]) -> bytes:
    head, blobs, at = [], [], 16 * len(_SECTIONS)
    for name in _SECTIONS:
        raw = parts[name].tobytes()
        head += [at, len(raw)]
        raw += b"\0" * (-len(raw) % 8)
        blobs.append(raw)
        at += len(raw)
    return np.array(head, np.int64).tobytes() + b"".join(blobs)


def compile_lexicon(tokenizer_path: str, frequent: list[bytes]) -> bytes:
    """The flat file: vocabulary, merges, special tokens and the transducer of the frequent words."""
    spec = read_tokenizer(tokenizer_path)
    merge, words = Merger(spec["merges"], spec["byte_ids"]), sorted(set(frequent))
    coded = [_word_ids(w.decode("utf-8"), merge) for w in words]
    parts = transducer(words) | {
        "vocab_ends": np.cumsum([0, *map(len, spec["words"])]).astype(np.int64),
        "vocab_bytes": np.frombuffer(b"".join(spec["words"]), np.uint8),
        "merges": spec["merges"], "byte_ids": spec["byte_ids"],
        "specials": np.array(list(spec["special"].values()), np.int64),
        "out_ends": np.cumsum([0, *map(len, coded)]).astype(np.int64),
        "out_ids": np.array([i for c in coded for i in c], np.uint32),
    }
    return _pack(parts)


_WORDS = regex.compile(WORD_PATTERN)


def _word_ids(text: str, merge: Callable[[bytes], list[int]]) -> list[int]:
    out: list[int] = []
    for m in _WORDS.finditer(text):
        out += merge(m.group().encode("utf-8"))
    return out


class Codec:
    """Encoder and decoder over a memory-mapped lexicon file; one per worker process."""

    #: Words met outside the lexicon whose ids a worker remembers; beyond, it starts anew.
    REMEMBERED = 200_000

    def __init__(self, path: str):
        head = np.memmap(path, np.int64, "r", shape=(2 * len(_SECTIONS),))
        kinds = {"vocab_bytes": np.uint8, "out_ids": np.uint32}
        whole = np.memmap(path, np.uint8, "r")
        for k, name in enumerate(_SECTIONS):
            at, size = int(head[2 * k]), int(head[2 * k + 1])
            setattr(self, name, whole[at : at + size].view(kinds.get(name, np.int64)))
        self.merge = Merger(self.merges.reshape(-1, 3), self.byte_ids)
        self.root, self.longest = (int(x) for x in self.meta)
        self.met: dict[bytes, np.ndarray] = {}
        ends = self.vocab_ends
        self.special = {bytes(self.vocab_bytes[ends[i] : ends[i + 1]]).decode(): int(i) for i in self.specials}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = "|".join([WIDE_SPACE, *map(regex.escape, self.special)])

    def places(self, words: pa.Array) -> np.ndarray:
        """Place of each word in the lexicon, or -1; all words step through the automaton together."""
        raw, ends = text_bytes(words)
        n = len(words)
        state, place = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        size = np.diff(ends)
        live = np.flatnonzero(size <= self.longest)
        state[size > self.longest] = -1
        if len(self.arc_keys) == 0:
            return np.full(n, -1, np.int64)
        for k in range(self.longest):
            live = live[(size[live] > k) & (state[live] >= 0)]
            if not len(live):
                break
            key = state[live] * 256 + raw[ends[live] + k]
            at = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
            hit = self.arc_keys[at] == key
            place[live] += np.where(hit, self.arc_add[at], 0)
            state[live] = np.where(hit, self.arc_next[at], -1)
        ok = state >= 0
        ok[ok] = self.final[state[ok]] == 1
        return np.where(ok, place, -1)

    def unseen(self, word: bytes) -> np.ndarray:
        ids = self.met.get(word)
        if ids is None:
            ids = np.array(_word_ids(word.decode("utf-8"), self.merge), np.uint32)
            if len(word) <= 256:
                if len(self.met) >= self.REMEMBERED:
                    self.met.clear()
                self.met[word] = ids
        return ids

    def plain(self, text: str) -> np.ndarray:
        """A text with special tokens or wide white space."""
        out = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], np.uint32))
            else:
                out += [self.unseen(m.group().encode("utf-8")) for m in _WORDS.finditer(part)]
        return np.concatenate([np.zeros(0, np.uint32), *out])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of texts without nulls, and the n + 1 offsets of the texts' ids."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if odd.any():
            ids, ends = self._even(texts.filter(pa.array(~odd)))
            even = np.flatnonzero(~odd)
            each: list = [None] * len(texts)
            for k, i in enumerate(even):
                each[i] = ids[ends[k] : ends[k + 1]]
            for i in np.flatnonzero(odd):
                each[i] = self.plain(texts[int(i)].as_py())
            return np.concatenate(each), np.cumsum([0, *map(len, each)]).astype(np.int64)
        return self._even(texts)

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, firsts = cut_words(texts)
        if len(pieces) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        coded = pieces.dictionary_encode()
        words, which = coded.dictionary, coded.indices.to_numpy()
        place = self.places(words)
        start, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        known = place >= 0
        start[known] = self.out_ends[place[known]]
        size[known] = self.out_ends[place[known] + 1] - start[known]
        extra, at = [], len(self.out_ids)
        for i, word in zip(np.flatnonzero(~known).tolist(), words.filter(pa.array(~known)).to_pylist()):
            ids = self.unseen(word)
            start[i], size[i] = at, len(ids)
            extra.append(ids)
            at += len(ids)
        pool = np.concatenate([self.out_ids, *extra])
        ends = np.concatenate([[0], np.cumsum(size[which])])
        return pool[ranges(start[which], size[which])], ends[firsts]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id's bytes end."""
        starts = self.vocab_ends[ids]
        size = self.vocab_ends[ids.astype(np.int64) + 1] - starts
        return self.vocab_bytes[ranges(starts, size)], np.concatenate([[0], np.cumsum(size)])


#: 1 for ASCII letters, 2 for digits, 3 for marks; 0 for white space, control characters and bytes beyond ASCII.
_KIND = np.array([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if 32 < b < 127 else 0 for b in range(128)] + [0] * 128, np.uint8)


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts (ASCII white space only) cut into pieces that merge alone, and each text's first piece.

    A piece is a run without white space with the one blank before it, or what is left of a run
    of white space: all but its last character, and that one if it is no blank, or the whole run
    at the end of a text. Runs are cut again where letters (ASCII and the Latin letters of two bytes
    that begin with C3) meet digits or ASCII marks, but not after an apostrophe, which may take the
    letters after it. The tokenizer's pattern never makes a word across two such pieces.
    """
    raw, ends = text_bytes(texts)
    n = len(raw)
    if n == 0:
        return pa.array([], pa.binary()), np.zeros(len(texts) + 1, np.int64)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts_text = np.zeros(n + 1, bool)
    starts_text[ends] = True
    # a piece begins at each text's start; where white space follows other characters;
    # and at the last character of white space before other characters, or after it if that is no blank
    cut = starts_text[:n].copy()
    cut[1:] |= space[1:] & ~space[:-1]
    lead = space[:-1] & ~space[1:] & ~starts_text[1:n]  # last of its run, and its text goes on
    cut[:-1] |= lead
    cut[1:] |= lead & (raw[:-1] != 32)
    kind = _KIND[raw]
    latin = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    begins, stops = kind.copy(), kind.copy()  # kind of the character that begins, or ends, at a byte
    begins[:-1][latin] = 1
    stops[1:][latin] = 1
    a, b = stops[:-1], begins[1:]
    cut[1:] |= (a != b) & (a > 0) & (b > 0) & (raw[:-1] != 39)
    at = np.flatnonzero(cut)
    offsets = np.append(at, n).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    return pieces, np.searchsorted(at, ends)


@functools.lru_cache(maxsize=2)
def _codec(name: str) -> Codec:
    return Codec(SparkFiles.get(name))


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """Columns ``word`` (binary piece) and ``n`` over the whole texts of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in utf8_parts(no_nulls(batch.column(0)), 4 << 20):
                pieces, _ = cut_words(part)
                got = pc.value_counts(pieces)
                yield pa.RecordBatch.from_arrays([got.field("values"), got.field("counts")], ["word", "n"])

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word binary, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text_col: str, tokenizer_path: str, size: int = 100_000, longest: int = 40) -> str:
    """Compile the most frequent words, ``size`` at most, of up to ``longest`` bytes; returns the shipped file's name.

    The file lies in the shared folder and reaches every executor with ``addFile``.
    """
    import pyarrow.fs as pafs

    spark = docs.sparkSession
    counts = written(word_counts(docs, text_col).where(F.length("word") <= longest), "words")
    # the least count that leaves at most ``size`` words, from a histogram of counts by powers of 2 ** 0.25
    step = F.floor(F.log2("n") * 4)
    steps = sorted(((r["s"], r["m"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("m")).collect()), reverse=True)
    least, total = math.inf, 0
    for s, m in steps:
        total += m
        if total > size:
            break
        least = s
    top = counts.where(step >= least) if steps and least < math.inf else counts.limit(0)
    words = [bytes(r["word"]) for r in top.select("word").collect()]  # at most size * longest bytes
    data = compile_lexicon(tokenizer_path, [w for w in words if not regex.search(WIDE_SPACE, w.decode("utf-8", "replace"))])
    path = scratch(spark, "lexicon") + ".bin"
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    fs, inner = pafs.FileSystem.from_uri(uri)
    fs.create_dir(os.path.dirname(inner), recursive=True)
    with fs.open_output_stream(inner) as out:
        out.write(data)
    spark.sparkContext.addFile(uri)
    return os.path.basename(path)


def encoded(text: Column, lexicon: str) -> Column:
    """Column expression: struct(n_tokens long, ids binary), ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("struct<n_tokens: bigint, ids: binary>")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(lexicon)
        for batch in texts:
            n, blobs = [], []
            for _, part in utf8_parts(no_nulls(batch), 1 << 20):
                ids, ends = codec.encode(part)
                raw = ids.astype("<u4").tobytes()
                n.append(np.diff(ends))
                blobs += [raw[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            counts = np.concatenate([np.zeros(0, np.int64), *n])
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], ["n_tokens", "ids"])

    return encode(text)


def decoded(ids: Column, lexicon: str) -> Column:
    """Column expression: the text of encoded ids (special tokens kept, broken UTF-8 replaced)."""

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(lexicon)
        for batch in batches:
            out: list[str] = []
            for _, part in utf8_parts(pc.fill_null(batch, b""), 1 << 20):
                raw, ends = text_bytes(part)
                data, at = codec.decode(np.frombuffer(raw.tobytes(), "<u4"))
                text = data.tobytes()
                at = at[ends // 4].tolist()
                out += [text[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
            yield pa.array(out, pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, lexicon: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers).

    Repeated rows give repeated rows; an empty table gives an empty one; other columns are not read.
    """
    one = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return one.withColumn("_code", encoded(F.col("_text"), lexicon)).select(id_col, "_code.n_tokens", "_code.ids")


def ids_array(ids: Column) -> Column:
    """Packed ids as array<int>."""

    @F.arrow_udf("array<int>")
    def unpack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            raw, ends = text_bytes(pc.fill_null(batch, b""))
            values = np.frombuffer(raw.tobytes(), "<u4").astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array((ends // 4).astype(np.int32)), pa.array(values))

    return unpack(ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    lexicon = build_lexicon(docs, "text", tokenizer_path or default_tokenizer())
    coded = encode_documents(docs, lexicon)
    back = coded.withColumn("decoded", decoded(F.col("ids"), lexicon))
    return back.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
