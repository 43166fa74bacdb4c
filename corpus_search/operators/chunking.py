"""Splitting documents into chunks.

* ``chunk_fixed``      - character windows with overlap, fully native (posexplode + substring).
* ``chunk_tokens``     - whitespace-token windows with overlap, fully native.
* ``length_guard``     - cut texts above a hard limit into fixed slices, native.
* ``chunk_recursive``  - separator-aware recursive splitting; the per-text rule is a small
                         Python helper run through ``mapInArrow`` in the scan's partitions.
* ``with_chunk_ids``   - deterministic ids ``md5(doc:chunk_index)``, stable under task retry.

All functions take and return DataFrames; the document row is exploded in place, so no
shuffle is introduced. Chunk counts per task follow input bytes, which parquet splits balance.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_search.functions import text as T
from corpus_search.functions.batches import parts

# Defaults of the question flows (1000/200), the PDF flow (500/50 with its
# separator list), bulk indexing (40000/500), the hard text guard (65535 limit, 65000 slice)
# and the token splitter (510 - 2 = 508 tokens, 200 overlap).
QUESTION_CHUNK = (1000, 200)
PDF_CHUNK = (500, 50)
BULK_CHUNK = (40000, 500)
TEXT_LIMIT = 65535
TEXT_SLICE = 65000
TOKEN_CHUNK = (508, 200)
DEFAULT_SEPARATORS = ("\n\n", "\n", " ", "")
PDF_SEPARATORS = ("\n\n", ".", " ", "")


def _check(size: int, overlap: int) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError(f"need size > overlap >= 0, got size={size} overlap={overlap}")


def chunk_fixed(
    df: DataFrame,
    text_col: str = "text",
    size: int = QUESTION_CHUNK[0],
    overlap: int = QUESTION_CHUNK[1],
    keep: Sequence[str] = ("doc_id", "source"),
) -> DataFrame:
    """Windows of ``size`` characters starting every ``size - overlap`` characters.

    A window starts at 1, 1+step, ... while the start is <= max(1, len - overlap), so the
    last window always adds at least one character not in the previous one. Empty or
    null text yields no rows. Output: keep..., chunk_index, start, text.
    """
    _check(size, overlap)
    step = size - overlap
    txt = F.col(text_col)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(txt) - F.lit(overlap)), F.lit(step))
    # build the chunk strings inside the row, then explode them: the generated rows carry
    # only their own chunk, never another copy of the whole document
    pieces = F.transform(starts, lambda s: F.struct(s.cast("bigint").alias("start"), F.substring(txt, s, F.lit(size)).alias("text")))
    exploded = df.select(*keep, F.posexplode(pieces).alias("chunk_index", "p"))
    return exploded.select(
        *keep,
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("p.start").alias("start"),
        F.col("p.text").alias("text"),
    ).filter(F.length("text") > 0)


def chunk_tokens(
    df: DataFrame,
    text_col: str = "text",
    size: int = TOKEN_CHUNK[0],
    overlap: int = TOKEN_CHUNK[1],
    keep: Sequence[str] = ("doc_id", "source"),
) -> DataFrame:
    """Windows of ``size`` whitespace tokens every ``size - overlap`` tokens, joined by a space."""
    _check(size, overlap)
    step = size - overlap
    # one split; removing '' drops the empty pieces a leading/trailing whitespace run leaves
    toks = F.array_remove(F.split(F.col(text_col), T.WHITESPACE_RUN), "")
    tok = F.col("_tok")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tok) - F.lit(overlap)), F.lit(step))
    pieces = F.transform(starts, lambda s: F.slice(tok, s, F.lit(size)))
    return (
        df.select(*keep, toks.alias("_tok"))
        .select(*keep, F.posexplode(pieces).alias("chunk_index", "p"))
        .filter(F.size("p") > 0)
        .select(
            *keep,
            F.col("chunk_index").cast("int").alias("chunk_index"),
            (F.col("chunk_index") * F.lit(step) + F.lit(1)).cast("bigint").alias("start_token"),
            F.array_join("p", " ").alias("text"),
            F.size("p").cast("bigint").alias("n_tokens"),
        )
    )


def length_guard(
    df: DataFrame,
    text_col: str = "text",
    limit: int = TEXT_LIMIT,
    slice_size: int = TEXT_SLICE,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Texts longer than ``limit`` are cut into consecutive ``slice_size`` pieces; others pass whole.

    Output: keep..., piece, text (piece numbered from 0).
    """
    if slice_size <= 0 or slice_size > limit:
        raise ValueError("need 0 < slice_size <= limit")
    txt = F.col(text_col)
    n = F.length(txt)
    n_pieces = F.when(n > limit, F.ceil(n / F.lit(slice_size)).cast("int")).otherwise(F.lit(1))
    pieces = F.transform(
        F.sequence(F.lit(0), n_pieces - 1),
        lambda i: F.when(n > limit, F.substring(txt, i * F.lit(slice_size) + F.lit(1), F.lit(slice_size))).otherwise(txt),
    )
    return df.select(*keep, F.posexplode(pieces).alias("piece", "text")).select(
        *keep, F.col("piece").cast("int").alias("piece"), "text"
    )


def with_chunk_ids(df: DataFrame, doc_col: str = "doc_id", index_col: str = "chunk_index") -> DataFrame:
    """Deterministic chunk id, so a retried task or a re-run writes the same keys."""
    return df.withColumn(
        "chunk_id", F.md5(F.concat_ws(":", F.col(doc_col).cast("string"), F.col(index_col).cast("string")))
    )


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Source/position metadata for each chunk (end offset, length)."""
    return chunks.select(
        "doc_id",
        "source",
        "chunk_index",
        "start",
        (F.col("start") + T.n_chars("text") - 1).alias("end"),
        T.n_chars("text").alias("n_chars"),
    )


# ---------------------------------------------------------------------------------------
# recursive, separator-aware splitting (small per-text helper + mapInArrow)
# ---------------------------------------------------------------------------------------

_ASCII_WS = "\t\n\x0b\f\r "


def _pieces(text: str, sep: str) -> list[str]:
    if sep == "":
        return list(text)
    parts = text.split(sep)
    out = [parts[0]] if parts[0] else []
    out.extend(sep + p for p in parts[1:])
    return out


def _split(text: str, size: int, overlap: int, seps: Sequence[str], out: list[str]) -> None:
    chosen, rest = None, ()
    for i, s in enumerate(seps):
        if s == "" or s in text:
            chosen, rest = s, tuple(seps[i + 1 :])
            break
    if chosen is None:  # nothing matches and "" not allowed: hard cut
        out.extend(text[i : i + size] for i in range(0, len(text), size))
        return
    window: deque[str] = deque()
    length = 0
    for p in _pieces(text, chosen):
        if len(p) > size:
            if window:
                out.append("".join(window))
                window.clear()
                length = 0
            _split(p, size, overlap, rest, out)
            continue
        if window and length + len(p) > size:
            out.append("".join(window))
            while window and (length > overlap or length + len(p) > size):
                length -= len(window.popleft())
        window.append(p)
        length += len(p)
    if window:
        out.append("".join(window))


def split_recursive(text: str | None, size: int, overlap: int, separators: Sequence[str] = DEFAULT_SEPARATORS) -> list[str]:
    """Chunks of one text under the recursive contract."""
    _check(size, overlap)
    if not text:
        return []
    raw: list[str] = []
    _split(text, size, overlap, tuple(separators), raw)
    return [c.strip(_ASCII_WS) for c in raw if c.strip(_ASCII_WS)]


def chunk_recursive(
    df: DataFrame,
    text_col: str = "text",
    size: int = PDF_CHUNK[0],
    overlap: int = PDF_CHUNK[1],
    separators: Sequence[str] = DEFAULT_SEPARATORS,
    keep: Sequence[str] = ("doc_id", "source"),
    lists: bool = False,
) -> DataFrame:
    """Recursive chunking. Runs in the input's partitions (no shuffle); output rows per chunk. A task holds the
    chunks of a bounded part of a batch; what is kept is repeated for each chunk, so whole texts are better
    kept with ``lists``, which gives a text's chunks as an array in its one row (:func:`recursive_lists`)."""
    _check(size, overlap)
    if lists:
        return recursive_lists(df, text_col, size, overlap, separators, keep)
    seps = tuple(separators)
    src = df.select(*keep, F.col(text_col).alias("_t"))
    key_fields = [src.schema[k] for k in keep]
    out_schema = pa.schema(
        [pa.field(f.name, _arrow_type(f.dataType.simpleString())) for f in key_fields]
        + [pa.field("chunk_index", pa.int32()), pa.field("text", pa.string())]
    )

    def run(batches):
        for rb in (part for whole in batches for part in parts(whole, "_t", 1 << 20)):
            cols = {k: rb.column(k).to_pylist() for k in keep}
            texts = rb.column("_t").to_pylist()
            rows: dict[str, list] = {k: [] for k in keep}
            idx, chunks = [], []
            for i, t in enumerate(texts):
                for j, c in enumerate(split_recursive(t, size, overlap, seps)):
                    for k in keep:
                        rows[k].append(cols[k][i])
                    idx.append(j)
                    chunks.append(c)
            arrays = [pa.array(rows[k], type=out_schema.field(k).type) for k in keep]
            arrays += [pa.array(idx, type=pa.int32()), pa.array(chunks, type=pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in key_fields] + ["chunk_index int", "text string"])
    return src.mapInArrow(run, ddl)


def recursive_lists(
    df: DataFrame,
    text_col: str = "text",
    size: int = PDF_CHUNK[0],
    overlap: int = PDF_CHUNK[1],
    separators: Sequence[str] = DEFAULT_SEPARATORS,
    keep: Sequence[str] = ("doc_id", "source"),
    out_col: str = "chunks",
) -> DataFrame:
    """The chunks of :func:`chunk_recursive` as an array, a row a text: what is kept is there once, whole texts too."""
    _check(size, overlap)
    seps = tuple(separators)
    sent = text_col if text_col in keep else "_t"  # a kept text goes to Python once
    src = df.select(*keep) if text_col in keep else df.select(*keep, F.col(text_col).alias(sent))

    def run(batches):
        for rb in (part for whole in batches for part in parts(whole, sent, 1 << 20)):
            lists = [split_recursive(t, size, overlap, seps) for t in rb.column(sent).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rb.column(k) for k in keep), pa.array(lists, pa.list_(pa.string()))], [*keep, out_col])

    ddl = ", ".join([f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keep] + [f"`{out_col}` array<string>"])
    return src.mapInArrow(run, ddl)


def _arrow_type(simple: str) -> pa.DataType:
    return {
        "bigint": pa.int64(),
        "int": pa.int32(),
        "string": pa.string(),
        "double": pa.float64(),
        "float": pa.float32(),
        "boolean": pa.bool_(),
    }[simple]
