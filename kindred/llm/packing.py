"""Packing by power-of-two decomposition (dataset decomposition, Pouransari et al. 2024).

A document's ids are cut into pieces whose lengths are powers of two: as many of the longest as fit,
then the binary digits of the rest, longest first.  Each piece is a sequence of its own, so no
sequence crosses documents and none needs padding; pieces of one length form a bucket.  One pass
over the documents, no shuffle.

A text with a run of hundreds of characters without a break, or of white space, of any length, takes the
contract's own tokenizer; the others take the same vocabulary's ranks, which give the same ids faster.
A very long text is encoded as a whole by one task, in memory in proportion to its ids.

Rows without a doc_id are left out.  A null text is empty: its one id is the end mark.  Repeated
rows are packed once each, under sequence ids of their own.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import mapped

SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"
MARK = "<|endoftext|>"
#: Runs without or of white space this long go to the slower tokenizer: the faster one backtracks over them.
LONG = re.compile(r"\s{256}|\S{512}")
_loaded: dict[str, object] = {}


def encoder(vocabulary: str, ranks: str | None = None) -> Callable[[str], list[int]]:
    """text -> ids of the JSON vocabulary, one for each process.

    ``ranks`` is the same vocabulary as a file of ranks: where it is given, texts without long runs are
    encoded from it, as that is faster; the ids are the same.
    """
    if (vocabulary, ranks) not in _loaded:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(vocabulary)
        plain = lambda text: slow.encode(text, add_special_tokens=False).ids
        if ranks is None:
            _loaded[vocabulary, ranks] = plain
        else:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
            fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
            _loaded[vocabulary, ranks] = lambda text: plain(text) if MARK in text or has_long_run(text) else fast.encode_ordinary(text)
    return _loaded[vocabulary, ranks]


def has_long_run(text: str) -> bool:
    sizes = [len(w) for w in text.split()]
    if max(sizes, default=0) < 512 and len(text) - sum(sizes) - len(sizes) < 255:  # the rest can't hold such a run
        return False
    return LONG.search(text) is not None


def pieces(n: int, longest: int) -> list[int]:
    """Lengths of the pieces of n ids; ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, longest: int = 2048, end: int = 1) -> DataFrame:
    """One row for each piece: doc_id, start, length, doc_tokens, ids (unsigned little-endian 32-bit), sequence_id, offset.

    ``length`` is the bucket.  ``vocabulary``: the tokenizer's JSON file, by default the public 50k one, and
    ``ranks`` the same vocabulary as ranks.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    if vocabulary is None:
        import public_tokenizers

        vocabulary, ranks = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            ids_of, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text")
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                ids = [*encode(text), end]
                raw, at = np.array(ids, "<u4").tobytes(), 0
                for n in pieces(len(ids), longest):
                    rows.append((ids_of[i], at, n, len(ids), raw[4 * at : 4 * (at + n)]))
                    at += n
                held += len(raw)
                if held > 4 << 20 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(),) * 4 + (pa.binary(),), strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids"])
                    rows, held = [], 0

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return mapped(docs, cut, SCHEMA).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length."""
    packed.write.partitionBy("length").mode("overwrite").parquet(path)
