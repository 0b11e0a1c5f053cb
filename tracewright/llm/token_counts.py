"""Token counts by overlap resynchronisation.

A text of up to chunk_chars characters is encoded whole, where the tokenizer drops white space by looking up its words,
of which a task encodes each once. A longer one is encoded in chunks that overlap, with
offsets. Two neighbours are spliced at a stable common boundary in their overlap: an ASCII white-space character that
no token of either covers, after which both have the same tokens up to the end of the overlap's next stable boundary.
The tokenizer is checked to drop white space and to encode what lies on its two sides apart, which proves that the
tokens on either side of such a boundary are those of the whole text. Where there is none in the overlap, it is
widened, up to the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import schema_with, slices, strings, with_columns
from tracewright.llm.words import WordEncoder, drops_white_space, library_tokenizer

CHUNK_CHARS, OVERLAP_CHARS = 1 << 15, 256
_SPACE = re.compile(r"[\x20\x09-\x0D]")


def _spans(tokenizer, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """(start, end, id) of the tokens of text[start:end], as offsets in text."""
    e = tokenizer.encode(text[start:end], add_special_tokens=False)
    return [(start + a, start + b, i) for (a, b), i in zip(e.offsets, e.ids, strict=True)]


def _stable(spans: list[tuple[int, int, int]], at: int) -> bool:
    return not any(a <= at < b for a, b, _ in spans)


def splice_point(text: str, left: list, right: list, start: int, end: int) -> int | None:
    """The first stable boundary in text[start:end] at which left and right agree, or None."""
    left, right = [x for x in left if x[1] > start and x[0] < end], [x for x in right if x[0] < end]
    spaces = [m.start() for m in _SPACE.finditer(text, start, end)]
    for i, at in enumerate(spaces[:-1]):
        to = spaces[-1]
        if _stable(left, at) and _stable(right, at) and [x for x in left if at < x[0] < to] == [x for x in right if at < x[0] < to]:
            return at
    return None


def count_tokens(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens of text, encoded in chunks."""
    total, begin, end = 0, 0, min(chunk, len(text))
    spans = _spans(tokenizer, text, 0, end)
    while end < len(text):
        width = overlap
        while True:
            back = max(begin, end - width)
            to = min(len(text), back + max(chunk, 2 * width))
            following = _spans(tokenizer, text, back, to)
            at = splice_point(text, spans, following, back, end)
            if at is not None:
                break
            if back == begin:  # nothing is left to widen to on the left: one longer chunk in place of both
                at, following = begin - 1, _spans(tokenizer, text, begin, to)
                break
            width *= 2
        total += sum(a < at for a, _, _ in spans)
        begin, end, spans = at + 1, to, [x for x in following if x[0] > at]
    return total + len(spans)


def with_token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """docs with n_tokens (long) added; a null text has none. An input column of that name gives way to it.

    Rows are counted one by one, so repeated rows, ties and an empty table need no rule. Texts longer than
    chunk_chars are counted in chunks if the tokenizer drops white space, else whole.
    """
    in_chunks = drops_white_space(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordEncoder(tokenizer_path) if in_chunks else None
        tokenizer = words.tokenizer if in_chunks else library_tokenizer(tokenizer_path)
        for batch in slices(batches, text_col, 4 << 20 if in_chunks else 1 << 20):
            found = strings(batch, text_col)
            if in_chunks:
                long = [i for i, t in enumerate(found) if len(t) > chunk_chars]
                counts = words.encode(pa.array(["" if len(t) > chunk_chars else t for t in found], pa.string()))[1].tolist()
                for i in long:
                    counts[i] = count_tokens(tokenizer, found[i], chunk_chars, overlap_chars)
            else:
                counts = [len(e) for e in tokenizer.encode_batch_fast(found, add_special_tokens=False)]
            yield with_columns(batch, {"n_tokens": pa.array(counts, pa.int64())})

    return docs.mapInArrow(run, schema_with(docs.schema, [("n_tokens", T.LongType())]))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = with_token_counts(sized, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
