"""Token counts of a sentencepiece model, with overlap resynchronisation for huge documents.

Short texts go to the library whole. A text longer than `chunk` characters is encoded in overlapping chunks with
offsets; the counts are spliced at a place that is a token boundary in both chunks of an overlap and that no entry of
the vocabulary can bridge, since no entry holds the two characters around it side by side. BPE merges can't cross such
a place, so the tokens after it don't depend on what comes before it: the splice is exact, not a guess. If an overlap
has no such place, it is widened until it has one or reaches the end of the text.

A task holds one Arrow batch and two chunks' tokens. A chunk grows only where a text has no certain boundary within it,
such as a long run of one letter; at worst, for a text without any, to the whole text.

Edge cases: null and empty texts have 0 bytes and 0 tokens. Rows are independent: repeated rows and ids count alike.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"


class Counter:
    """A sentencepiece BPE model that counts tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_control(i) and not self.model.is_byte(i)]
        #: Characters that stand side by side in an entry: a boundary between others is certain.
        self.bridged = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def starts(self, text: str, begin: int, end: int) -> list[int]:
        """Where tokens of text[begin:end], encoded by itself, begin in text."""
        part = text[begin:end]
        at = np.array([p.begin for p in self.model.encode(part, return_type="proto").pieces], dtype=np.int64)
        if not part.isascii():  # from bytes to characters
            leads = np.frombuffer(part.encode(), dtype=np.uint8) & 0xC0 != 0x80
            at = (np.cumsum(leads) - leads)[at]
        return (begin + at).tolist()

    def certain(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.bridged

    def huge(self, text: str, chunk: int, overlap: int) -> int:
        """Tokens of a text longer than a chunk."""
        total, cut, begin, end = 0, 0, 0, min(chunk, len(text))
        here = self.starts(text, begin, end)
        while end < len(text):
            width = overlap
            while True:  # widen until the overlap has a certain common boundary
                after = max(cut + 1, end - width)
                until = min(len(text), after + max(chunk, 2 * width))
                there = self.starts(text, after, until)
                common = set(here) & set(there)
                splice = next((x for x in sorted(common, reverse=True) if after < x < end and self.certain(text, x)), None)
                if splice is not None:
                    break
                if after == cut + 1:  # the whole chunk is one stretch without such a place: a longer chunk
                    end = min(len(text), begin + 2 * (end - begin))
                    here = self.starts(text, begin, end)
                    if end == len(text):
                        break
                    width = overlap
                else:
                    width *= 2
            if splice is None:
                break
            total += sum(cut <= x < splice for x in here)
            cut, begin, end, here = splice, after, until, there
        return total + sum(x >= cut for x in here)

    def counts(self, texts: list[str], chunk: int, overlap: int) -> list[int]:
        """Tokens of each text."""
        short = [i for i, t in enumerate(texts) if len(t) <= chunk]
        out = [0] * len(texts)
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > chunk:
                out[i] = self.huge(t, chunk, overlap)
        return out


@functools.lru_cache(maxsize=2)
def counter(model_path: str) -> Counter:
    """The counter of this worker."""
    return Counter(model_path)


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = 32768, overlap: int = 256, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = own.counts(texts, chunk, overlap)
                columns = [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])]
                yield pa.record_batch(columns, names=[id_column, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text).cast("string")).mapInArrow(run, f"`{id_column}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
