"""Token counts by section: each whole document is encoded once, and its tokens are attributed by their offsets.

A section is a paragraph: it starts at the text's first byte or after a run of line ends, and reaches to the next section's
start, so sections cover the text. Byte-level tokens are byte ranges; running sums of their lengths place them, and an interval
join (a binary search over the sections' starts) attributes them. Rule for tokens across a boundary: a token belongs to the
section in which its first byte lies; it also counts as a crossing of that document.

Nulls and edges: a null or empty text has no tokens and no sections; text that looks like a special token is ordinary
text; lone surrogates, which UTF-8 can't hold, count as `?`; equal rows agree, ties can't arise; a long text is encoded whole; other
columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A run of line ends that closes a section.
BREAK = re.compile(rb"\n+")
#: Public pattern of byte-level BPE: contractions, words, numbers, other signs, white space. Fixed values.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OUT = "doc_id long, n_bytes long, n_tokens long, n_sections long, n_crossing long, section_tokens array<int>"
_loaded: dict[str, tuple] = {}


def ranks_of(lines: list[str]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def encoding(key: str, ranks: dict[bytes, int]) -> tuple:
    """The encoder, and each token's length in bytes; made once in a worker."""
    if key not in _loaded:
        import tiktoken

        length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        _loaded.clear()
        _loaded[key] = (tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), length)
    return _loaded[key]


def attributed(text: str, encoder, length: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, int]:
    """Bytes, tokens by section, start of each section, and tokens that cross a boundary."""
    data = text.encode(errors="replace")
    if not data:
        return 0, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    start = np.array([0, *(m.end() for m in BREAK.finditer(data) if 0 < m.end() < len(data))])
    start = np.unique(start)
    size = length[np.asarray(encoder.encode_to_numpy(data.decode(), disallowed_special=()), np.int64)]
    end = np.cumsum(size)
    first = np.searchsorted(start, end - size, side="right") - 1
    last = np.searchsorted(start, end - 1, side="right") - 1
    return len(data), np.bincount(first, minlength=len(start)), start, int((first != last).sum())


def token_counts(docs: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_bytes, n_tokens, n_sections, n_crossing, section_tokens (tokens of each section, in order)."""
    with open(tokenizer) as f:  # a vocabulary's size is fixed, whatever the corpus
        ranks = ranks_of(f.readlines())
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, length = encoding(tokenizer, shared.value)
        for b in batches:
            texts = b.column(1)
            rows = [attributed(texts[i].as_py() or "", encoder, length) for i in range(b.num_rows)]
            sections = pa.ListArray.from_arrays(np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int32), pa.array(np.concatenate([r[1] for r in rows] or [[]]).astype(np.int32)))
            numbers = [[r[0] for r in rows], [int(r[1].sum()) for r in rows], [len(r[1]) for r in rows], [r[3] for r in rows]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in numbers), sections], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)
