"""Token counts of whole texts by overlap resynchronisation.

Ordinary texts are encoded at once. A huge text is encoded in overlapping chunks and the counts are
spliced at a boundary that both chunks have in their overlap, so memory stays with one chunk.

Why a splice is exact: the library first cuts a text into pieces (words with their blank, numbers,
marks, special strings) from left to right, and the cut after a piece depends on the text from there
on, never on what lies before. A piece start of the left chunk is therefore a piece start of the whole
text, unless the chunk's end was within reach of the rules, which look a few characters ahead; starts
within ``MARGIN`` of the end are not trusted. If the right chunk, which began anywhere, has a piece start
at the same place, both go on alike from there. Merges never cross pieces. If an overlap has no common
start, as in a very long run of letters, the overlap is doubled, at the utmost up to the whole left chunk.

Defined results: a null text counts as empty: no bytes, no tokens. Special strings inside a text count as
the library's default has it. Repeated rows each get their row; an empty table gives an empty table.
Input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.llm.common import free_name, slices, without

# Characters of a chunk, of the first overlap, and of the distrusted end of a chunk. The margin is
# longer than any special string and than the pieces' rules look ahead.
CHUNK = 32_768
OVERLAP = 512
MARGIN = 64
BATCH_TEXTS = 64

RESULTS = ("n_bytes", "n_tokens", "over_limit")

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _loaded[path] = loaded
    return _loaded[path]


def _encode(encoder, text: str):
    """Piece starts within the text, each with the number of tokens before it, and the token count."""
    encoding = encoder.encode(text, add_special_tokens=False)
    starts, last = {}, None
    for place, ((start, _), piece) in enumerate(zip(encoding.offsets, encoding.word_ids, strict=True)):
        # A special string is no piece of its own number; its neighbours are told apart by None.
        if piece is None or piece != last:
            starts.setdefault(start, place)
        last = piece
    return starts, len(encoding.ids)


def count_in_chunks(encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Number of tokens of ``text``, never encoding much more than ``chunk`` characters at once."""
    begin, end = 0, min(chunk, len(text))
    starts, total = _encode(encoder, text[begin:end])
    done = 0  # tokens before the chunk [begin, end)
    trusted = 0  # the first piece start of the chunk that is one of the whole text
    while end < len(text):
        reach = min(overlap, end - begin)
        while True:
            right = max(begin + trusted, end - reach)
            stop = min(len(text), end + chunk)
            right_starts, right_total = _encode(encoder, text[right:stop])
            common = [
                place
                for place in starts
                if trusted <= place < end - begin - margin and place + begin - right in right_starts
            ]
            if common:
                splice = max(common)
                break
            if right == begin + trusted:
                splice = trusted  # the right chunk begins at a start of the whole text
                break
            reach *= 2
        done += starts[splice] - right_starts[begin + splice - right]
        trusted = begin + splice - right
        begin, end, starts, total = right, stop, right_starts, right_total
    return done + total


def _counts(path: str, texts: list[str | None], chunk: int, overlap: int) -> list[int]:
    encoder = tokenizer(path)
    counts = [0] * len(texts)
    short = [k for k, text in enumerate(texts) if text and len(text) <= chunk]
    for start in range(0, len(short), BATCH_TEXTS):
        part = short[start : start + BATCH_TEXTS]
        for k, encoding in zip(part, encoder.encode_batch_fast([texts[k] for k in part], add_special_tokens=False)):
            counts[k] = len(encoding)
    for k, text in enumerate(texts):
        if text and len(text) > chunk:
            counts[k] = count_in_chunks(encoder, text, chunk, overlap)
    return counts


def count_tokens(
    docs: DataFrame,
    tokenizer_file: str,
    limit: int = 512,
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit.

    ``tokenizer_file`` is a path that exists on every executor, as installed there.
    """
    rows = without(docs, *RESULTS)
    count = free_name(rows, "n_tokens")
    schema = T.StructType([*rows.schema.fields, T.StructField(count, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts = _counts(tokenizer_file, batch.column(text).to_pylist(), chunk, overlap)
            columns = [*batch.columns, pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, count])

    counted = rows.mapInArrow(run, schema)
    return counted.select(
        *[F.col(f"`{c}`") for c in rows.columns],
        F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(count).alias("n_tokens"),
        (F.col(count) > limit).alias("over_limit"),
    )
