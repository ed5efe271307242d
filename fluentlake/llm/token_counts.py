"""Op 5: token counts by offset-mapped attribution.

A document is encoded once, as a whole. The byte lengths of its tokens, summed, give each token's span; these spans are
joined with the spans of the sections, which tile the text, by binary search (numpy.searchsorted), and a token that
crosses a boundary goes to the section that holds most of its bytes, the earlier one on a tie. Sections are paragraphs
(lines), each with the line break that ends it, so the counts of a text's sections add up to the count of the text.

Narrow: one pass of mapInArrow, no shuffle. Null and empty texts have one empty section without tokens. Offsets are in
code points, whole texts of any length. Documents that repeat give their rows again; an empty table gives an empty one; other
columns may have any names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluentlake.llm.shared import text_bytes


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def allocate(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and sections tile the same bytes. Returns each section's number of tokens, and how many of the tokens that
    it got cross a boundary. Most bytes win; ties go to the earlier section."""
    n = len(section_ends)
    if not len(token_ends):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    token_starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, token_starts, "right")
    last = np.searchsorted(section_ends, token_ends, "left")
    owner = first.copy()
    for k in np.flatnonzero(last > first):
        cuts = np.concatenate([[token_starts[k]], section_ends[first[k] : last[k]], [token_ends[k]]])
        owner[k] = first[k] + int(np.argmax(np.diff(cuts)))
    return np.bincount(owner, minlength=n), np.bincount(owner[last > first], minlength=n)


def count_section_tokens(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per section: doc_id, section, start_char, end_char, n_tokens, n_crossing (tokens that it got although they
    cross its boundary) and doc_tokens (of the whole document)."""
    names = ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, lengths = encoder(path, pattern)
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part, columns = batch.slice(begin, 256), [[] for _ in range(6)]
                for raw in part.column(1).to_pylist():
                    ids = np.array(coder.encode_ordinary(raw.decode("utf-8", "replace")), np.int64)
                    data = np.frombuffer(raw, np.uint8)
                    ends = np.append(np.flatnonzero(data[:-1] == 10) + 1, len(data))
                    tokens, crossing = allocate(np.cumsum(lengths[ids]), ends)
                    chars = np.zeros(len(data) + 1, np.int64)
                    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                    stops = chars[ends]
                    for column, values in zip(columns, (np.arange(len(ends)), np.append(0, stops[:-1]), stops, tokens, crossing, np.full(len(ends), len(ids))), strict=True):
                        column.append(values)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), [len(x) for x in columns[0]])))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c), pa.int64()) for c in columns)], names)

    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in names[1:])
    return docs.select(F.col(doc_id).alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(run, schema)
