"""Cost-balanced packing of documents into token sequences.

A piece of n tokens costs LINEAR * n + QUADRATIC * n * n. Tasks pack groups of documents of bounded size, each on its
own, so nothing is shuffled. In a group, whole sequences are cut from documents longer than one; what is left goes,
longest first, to the sequence of the lowest cost that still has room for it. What no sequence has room for is cut to
fill the roomiest ones. A group's sequences hold exactly its tokens: full ones, and at most one of each smaller power
of two, so no sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import binaries, fresh, schema_with, slices, strings
from tracewright.llm.words import WordEncoder, drops_white_space, library_tokenizer

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Tokens of a group, about; a group ends with the document that passes it.
GROUP_TOKENS = 1 << 20
ADDED = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("ids", T.BinaryType())]


def capacities(total: int, capacity: int) -> list[int]:
    """Sizes of the sequences that hold exactly total tokens: full ones, then falling powers of two."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths; sequences count from 0."""
    pieces, tails, sequence = [], [], 0
    for doc, n in enumerate(lengths):
        full = int(n) // capacity
        for i in range(full):
            pieces.append((doc, i * capacity, capacity, sequence, 0))
            sequence += 1
        if n - full * capacity:
            tails.append((int(n) - full * capacity, doc, full * capacity))
    tails.sort(key=lambda x: (-x[0], x[1]))
    room = np.array(capacities(sum(t[0] for t in tails), capacity), np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    for n, doc, start in tails:
        while n:
            fits = room >= n
            at = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
            part = min(n, int(room[at]))
            pieces.append((doc, start, part, sequence + at, int(size[at] - room[at])))
            room[at] -= part
            cost[at] += LINEAR * part + QUADRATIC * part * part
            n, start = n - part, start + part
    return pieces


def pack_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: the document's columns but its text, then start, length, doc_tokens, sequence_id,
    offset and ids (little-endian unsigned 32-bit).

    A null or empty text is the end id alone. Repeated rows are documents of their own. Input columns named like an
    added one give way to it. No rows: no pieces. The capacity must be a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    by_word = drops_white_space(tokenizer_path)
    taken = {n for n, _ in ADDED}
    kept = [c for c in docs.columns if c != text_col and c.lower() not in taken]
    text = fresh(kept, "packed_text")
    source = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(text))
    out_schema = schema_with(source.drop(text).schema, ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordEncoder(tokenizer_path) if by_word else None
        whole = None if by_word else library_tokenizer(tokenizer_path)
        base, used = TaskContext.get().partitionId() << 33, 0
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used
            rows = pa.Table.from_batches([b for b, _, _ in held])
            ids, lengths = np.concatenate([i for _, i, _ in held]), np.concatenate([n for _, _, n in held])
            pieces = np.array(pack(lengths, capacity), np.int64).reshape(-1, 5)
            pieces = pieces[np.lexsort((pieces[:, 1], pieces[:, 0]))]  # as the ids lie
            doc, start, length, sequence, offset = pieces.T
            columns = rows.take(pa.array(doc)).combine_chunks().columns
            added = [start, length, lengths[doc], base + used + sequence, offset]
            yield from pa.Table.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in added), binaries(ids, length)], names=out_schema.names).to_batches(max_chunksize=1000)
            used += int(sequence.max()) + 1
            held.clear()

        for batch in slices(batches, text):
            if by_word:
                ids, n = words.encode(batch.column(text))
            else:
                found = [e.ids for e in whole.encode_batch_fast(strings(batch, text), add_special_tokens=False)]
                ids, n = np.array([i for f in found for i in f], np.uint32), np.array([len(f) for f in found], np.int64)
            ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
            held.append((batch.drop_columns([text]), ids.astype("<u4", copy=False), n + 1))
            if sum(len(i) for _, i, _ in held) >= GROUP_TOKENS:
                yield from flush()
        if held:
            yield from flush()

    return source.mapInArrow(run, out_schema)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
