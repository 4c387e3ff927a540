"""Packing by power-of-two decomposition.

The ids of a document (its tokens, then the end id) are cut into pieces whose
lengths are powers of two: as many of the longest length as fit, then one for
each set bit of the rest, longest first. A piece is a sequence of its own, in the
bucket of its length, so batches of a bucket need no padding and no sequence
crosses documents.

Defined results: a null text counts as empty and gives one piece with the end id
alone; repeated rows are packed each for itself; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, text_or_empty

END_ID = 0
SEQUENCE = 1024


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of the JSON tokenizer, without special tokens added.

    The rank file holds the same vocabulary and its library is several times
    faster; only a text that spells out a special token needs the other one.
    """

    def __init__(self, json_file: str, rank_file: str):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(json_file, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_file, self.exact = json_file, None

    def __call__(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        if self.exact is None:
            from tokenizers import Tokenizer

            self.exact = Tokenizer.from_file(self.json_file)
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def binary_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that sum to n, longest first, none above `longest` (a power of two)."""
    out = [longest] * (n // longest)
    rest = n % longest
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _pack(files: tuple[str, str], longest: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*files)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[] for _ in names]
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text), np.uint32(END_ID)).astype("<u4")
                    start = 0
                    for n in binary_lengths(ids.size, longest):
                        row = (doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), ids.size, ids[start : start + n].tolist() if with_ids else None)
                        for c, v in zip(cols, row):
                            c.append(v)
                        start += n
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def pack(docs: DataFrame, files: tuple[str, str] | None = None, longest: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and the ids).

    bucket is log2 of the length: all sequences of a bucket have the same length.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    pieces = in_arrow(texts, _pack(files or tokenizer_files(), longest, with_ids), schema)
    return pieces.withColumns(
        {
            "sequence_id": F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
            "bucket": F.log2(F.col("length").cast("double")).cast("int"),
        }
    )
