"""Token counts by the public libraries: batches of about equal bytes in Arrow functions that return lengths only.

Every task gathers texts to batches of `BATCH_BYTES`, so that one call of the library has about the same work whether texts
are short or long, and adds up the lengths per row. Texts and ids never come back from the workers.

A text longer than `PIECE_CHARS` is split before white space that follows something else, where that is safe: byte-level
tokenizers without normalizer, whose added tokens hold no white space, never join or compare anything across such a place
(`splits_at_space`). For other tokenizers, and where a text has no such place, the library gets the whole text.

Row-wise: no shuffle, partitions stay as read. The library object is kept per worker process, it needs about 50 MB.

Defined cases: null text counts like empty text: no bytes, no tokens. Special strings inside a text are treated as the
library does by default. Rows and carried columns are kept, repeated rows included; a carried column named like an output
gives way to it. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.llm.bpe import _SPACE, rank_file
from sunloom.llm.common import fresh, once, output_schema, replacing, slices

#: Bytes of text in one call of the library.
BATCH_BYTES = 1 << 20
#: Longer texts are split where that is safe.
PIECE_CHARS = 1 << 16
#: Tokens of a usual context; longer documents are marked.
LIMIT = 1024

_BREAK = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")


def splits_at_space(tokenizer: dict) -> bool:
    """Whether counts of the parts add up when a text is cut before white space that follows something else."""
    before, added = tokenizer.get("pre_tokenizer") or {}, tokenizer.get("added_tokens") or []
    return (tokenizer.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c in _SPACE for c in t["content"]) for t in added))


def json_counter(data: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    """Counts of a list of texts by a tokenizer file of the tokenizers library, and whether texts may be split."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    library = Tokenizer.from_buffer(data)
    library.no_truncation()
    library.no_padding()
    return lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)], splits_at_space(json.loads(data))


def model_counter(data: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    """The same for a model of the sentencepiece library, whose normalizer sees whole texts."""
    from sentencepiece import SentencePieceProcessor
    library = SentencePieceProcessor(model_proto=data)
    return lambda texts: [len(ids) for ids in library.encode(texts, num_threads=1)], False


def pieces(text: str, most: int) -> Iterator[str]:
    """`text` in parts of about `most` characters, cut only before white space that follows something else."""
    at = 0
    while len(text) - at > most:
        place = _BREAK.search(text, at + most)
        if place is None:
            break
        yield text[at:place.start()]
        at = place.start()
    yield text[at:] if at else text


def lengths(texts: list[str | None], count: Callable[[list[str]], list[int]], split: bool) -> np.ndarray:
    """Tokens of each text; pieces of all texts go to the library in batches of about equal bytes."""
    total = np.zeros(len(texts), np.int64)
    held, rows, size = [], [], 0

    def add() -> None:
        np.add.at(total, rows, count(held))

    for row, text in enumerate(texts):
        for piece in (pieces(text, PIECE_CHARS) if split and text else [text] if text else []):
            held.append(piece)
            rows.append(row)
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= BATCH_BYTES:
                add()
                held, rows, size = [], [], 0
    if held:
        add()
    return total


def counted(docs: DataFrame, tokenizer_path: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """The columns `carry`, n_bytes (of the text in UTF-8), n_tokens and over_limit (more tokens than `limit`).

    `tokenizer_path` names a file of the tokenizers (.json) or the sentencepiece (.model) library. No begin, end or other
    special tokens are added, nothing is truncated or padded.
    """
    kinds = {".json": json_counter, ".model": model_counter}
    make = kinds.get(os.path.splitext(tokenizer_path)[1])
    if make is None:
        raise ValueError(f"a tokenizer file ends with one of {sorted(kinds)}")
    data = rank_file(tokenizer_path)
    key = ("counter", hashlib.sha256(data).hexdigest())
    sent = docs.sparkSession.sparkContext.broadcast(data)
    content = fresh(list(carry), "content")
    outputs = [("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    kept, schema = replacing(docs.select(*carry), outputs)
    arrow, wide = output_schema(schema), len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, split = once(key, lambda: make(sent.value))
        for batch in batches:
            for part in slices(batch, wide):
                texts = part.column(wide)
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                n = lengths(texts.to_pylist(), count, split)
                yield pa.RecordBatch.from_arrays([*part.columns[:wide], size, pa.array(n), pa.array(n > limit)], schema=arrow)

    return docs.select(*kept.columns, F.col(text).alias(content)).mapInArrow(run, schema)
