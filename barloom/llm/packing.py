"""Packing of documents into windows of fixed length by the sum-of-squares rule.

Documents are encoded where they lie and cut into full windows and a rest. Rests are placed online: each goes to the
fill level (an open window filled that far, or a new one) that makes the sum over levels of the squared number of open
windows smallest; the counts are kept in an array over levels. Only pieces (ids, lengths, checksums) are shuffled.

Pieces are dealt to packers by a hash of their content, about `bucket` documents each, so packers work at the same
time and their number grows with the input; each leaves only its open windows part-filled.

Edge cases: null and empty texts are the end mark alone, one token; repeated rows are separate documents, dealt to
different packers; a document of exactly k windows has no rest. A task holds one Arrow batch, the ids of the texts that it
encodes at a time, and the words that it remembers.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import copies

#: Words whose ids a worker remembers, and bytes of text that it encodes at a time (a longer text stands alone).
REMEMBERED, AT_ONCE = 250_000, 2_000_000
#: Bytes that end a word: ASCII white space.
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: ASCII letters; second bytes of U+00C0 to U+00FF that are letters; small ASCII letters for capitals.
IS_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
IS_SECOND = np.array([128 <= b < 192 and chr(b + 64).isalpha() for b in range(256)])
SMALL = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Words that no normaliser changes but for capitals and no pattern cuts.
PLAIN = re.compile("[a-zà-öø-ÿß]+").fullmatch


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts in order, as numbers into the distinct ones, and how many each text has.

    A comma or full stop at the end of a word is one of its own if a plain letter stands before it, since no normaliser
    binds such a letter to it. Capitals of ASCII are made small, unless a special string may be there.
    """
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    ends = (ends - ends[0]).astype(np.int64)
    if b"<|" not in data.tobytes():
        data = SMALL[data]
    inside = ~IS_SPACE[data]
    last = np.zeros(len(data) + 1, dtype=bool)  # an end of a text or a space is behind
    last[:-2] = ~inside[1:]
    last[np.maximum(ends - 1, 0)] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(data)]
    first[begins] = inside[begins]  # no word crosses from one text to the next
    marks = np.flatnonzero(((data == 44) | (data == 46)) & last[:-1] & ~first)
    before = data[marks - 1]
    first[marks[IS_LETTER[before] | IS_SECOND[before] & (data[marks - 2] == 0xC3) & ~first[marks - 1]]] = True
    at = np.flatnonzero(first)
    letters = np.concatenate([np.zeros(1, np.int32), np.cumsum(inside, dtype=np.int32)])
    starts = np.append(letters[at], letters[-1])
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(data[inside])])
    return words.dictionary_encode(), np.diff(np.searchsorted(at, ends))


class Encoder:
    """A `tokenizers` file whose tokens never cross ASCII white space, which it drops: whole words are encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shown = self.tokenizer.pre_tokenizer[1].pre_tokenize_str  # bytes as the model's characters
        self.shown = {ord(c): shown(c)[0][0] for c in map(chr, range(97, 256)) if PLAIN(c)}
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, dtype="<u4")
        self.starts = np.zeros(1, dtype=np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's end."""
        if len(self.known) > REMEMBERED:
            self.forget()
        words, per_text = words_of(texts)
        distinct = words.dictionary.to_pylist()
        self.learn([w for w in distinct if w not in self.known])
        at = np.fromiter(map(self.known.__getitem__, distinct), dtype=np.int64, count=len(distinct))[words.indices.to_numpy()]
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.arange(ends[-1]) + np.repeat(self.starts[at] - ends[:-1], sizes)]
        return ids, ends[np.cumsum(per_text)]

    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of words: plain ones by the library's model, which they reach as they are, others in full."""
        model, ids, sizes, odd = self.tokenizer.model.tokenize, [], [], []
        order = []
        for w in words:
            text = w.decode().lower()
            if PLAIN(text):
                found = [t.id for t in model(text if text.isascii() else text.translate(self.shown))]
                ids += found
                sizes.append(len(found))
                order.append(w)
            else:
                odd.append(w)
        for start in range(0, len(odd), 500):  # many as lines of one text, told apart by the tokens' offsets
            block = [w.decode() for w in odd[start : start + 500]]
            found = self.tokenizer.encode("\n".join(block), add_special_tokens=False)
            cuts = np.searchsorted([x for x, _ in found.offsets], np.cumsum([0] + [len(w) + 1 for w in block]))
            ids += found.ids
            sizes += np.diff(cuts).tolist()
        self.known.update(zip(order + odd, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, np.array(ids, dtype="<u4")])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int64)])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this worker."""
    return Encoder(path)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs (first, number) of texts of at most AT_ONCE bytes together, or of one text."""
    sizes, start, held = pc.binary_length(texts).to_pylist(), 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > AT_ONCE:
            yield start, i - start
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes) - start


def pieces(docs: DataFrame, tokenizer_path: str, window: int, end_id: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens: each document's full windows and its rest."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.string())
            for at, n in _parts(texts):
                ids, ends = own.encode(texts.slice(at, n))
                data = memoryview(ids).cast("B")
                rows, starts, lengths, sums, totals = [], [], [], [], []
                begin = 0
                for i, stop in enumerate(ends.tolist()):
                    total = stop - begin + 1  # with the end mark
                    for start in range(0, total, window):
                        last = min(start + window, total)
                        crc = zlib.crc32(data[4 * (begin + start) : 4 * min(begin + last, stop)])
                        rows.append(i)
                        starts.append(start)
                        lengths.append(last - start)
                        sums.append(zlib.crc32(end, crc) if last == total else crc)
                        totals.append(total)
                    begin = stop
                yield pa.record_batch([batch.column(0).slice(at, n).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))], names=[id_column, "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text).cast("string")).mapInArrow(run, f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset there of each piece, in this order, by the sum-of-squares rule."""
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    count = np.zeros(window + 1, dtype=np.int64)
    windows, offsets, used = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64), 0
    for i, size in enumerate(lengths):
        if size == window:
            windows[i], used = used, used + 1
            continue
        room = window - size
        # the change of the sum when a window of level h rises to h + size; a full window leaves the sum
        change = 2 * (count[size : window + 1] - count[: room + 1]) + 2
        change[room] = 1 - 2 * count[room]
        change[count[: room + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * count[size] + 1
        level = room - int(np.argmin(change[::-1]))  # ties go to the fuller window
        if level:
            windows[i] = open_at[level].pop()
            count[level] -= 1
        else:
            windows[i], used = used, used + 1
        offsets[i] = level
        if size < room + size - level:
            open_at[level + size].append(windows[i])
            count[level + size] += 1
    return windows, offsets


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1, bucket: int = 8192, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its sequence and its offset there."""
    kind = docs.schema[id_column].dataType.simpleString()
    order = ["place_key", id_column, "start", "ids_crc32", "length"]
    packers = -(-max(1, docs.count()) // bucket)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable", ignore_index=True)
        windows, offsets = place(group["length"].to_numpy(), window)
        return group.assign(sequence_id=(int(key[0]) << 32) + windows, offset=offsets).drop(columns=["packer", "place_key"])

    cut = pieces(docs, tokenizer_path, window, end_id, id_column, text)
    # repeated rows are counted, and their copies dealt one by one
    cut = copies(cut.groupBy(*cut.columns).agg(F.count("*").alias("times")), "times", "copy")
    cut = cut.withColumn("place_key", F.xxhash64(id_column, "start", "ids_crc32", "copy")).drop("copy")
    cut = cut.withColumn("packer", F.pmod("place_key", F.lit(packers)))
    schema = f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return cut.groupBy("packer").applyInPandas(run, schema)
