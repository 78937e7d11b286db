"""Byte-level BPE by DuckDB recursive queries inside Spark's partitions.

A partition splits its texts by the tokenizer's pattern and keeps the distinct pieces it has not met yet. For these, a
recursive DuckDB query joins token-position rows with the merge table and contracts the leftmost pair of least rank of
every piece until no pair merges. The query holds every turn, some L * L / 2 rows for a piece of L bytes, so pieces meet
in it as far as that sum stays below a fixed number; a longer piece is contracted by itself in the same order, over a
linked list and a heap of pairs that grow with L. Decoding is an ordered aggregation over (document, position, id) rows;
digests() decodes each distinct piece's ids once and joins a document's bytes in order, which is the same.

The merge table holds every way to cut an entry of the vocabulary into two others, so any adjacent pair whose joined
bytes are an entry merges, by that entry's rank. A piece that is itself an entry is that entry.

Edge cases: null and empty texts have no tokens and decode to nothing; a piece of one byte is one token; there is no
limit on lengths of texts or pieces. Rows are independent, so repeated rows and ids are encoded alike.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that one recursive query contracts, and pieces that a worker remembers.
BLOCK, REMEMBERED = 20_000, 400_000
#: Rows of all turns of one recursive query, and the bytes of a piece from which it is contracted by itself.
TURNS, LONG = 4_000_000, 1024
#: Tokens that one decoding query joins.
DECODED = 2_000_000

#: A token's place is its piece's number times 2 ** 40 plus its position in the piece.
CONTRACT = """
WITH RECURSIVE step AS (
    SELECT 0 AS turn, place, token FROM bytes_in
    UNION ALL
    (
        WITH best AS (
            SELECT a.place >> 40 AS piece, min((m.merged::BIGINT << 40) + (a.place & 1099511627775)) AS found
            FROM step a JOIN step b ON b.place = a.place + 1 JOIN merges m ON m.pair = a.token::BIGINT * 65536 + b.token
            GROUP BY ALL
        ), placed AS (
            SELECT *, place & 1099511627775 AS pos, found & 1099511627775 AS best_pos
            FROM step JOIN best ON piece = place >> 40
        )
        SELECT turn + 1, place - (pos > best_pos)::BIGINT, CASE WHEN pos = best_pos THEN (found >> 40)::INTEGER ELSE token END
        FROM placed WHERE pos <> best_pos + 1
    )
)
SELECT place >> 40 AS piece, token
FROM step JOIN (SELECT place >> 40 AS piece, max(turn) AS last FROM step GROUP BY ALL) l ON l.piece = place >> 40 AND turn = last
ORDER BY place
"""

DECODE = "SELECT doc, string_agg(v.shown, '' ORDER BY pos) AS shown FROM tokens_in t JOIN vocabulary v ON v.token = t.token GROUP BY doc"


def _shown(data: bytes) -> str:
    """Bytes as text that DuckDB can join: byte b as the character 256 + b."""
    return data.decode("latin-1").translate({b: 256 + b for b in range(256)})


def _hidden(text: str) -> bytes:
    return text.encode("utf-16-le")[::2]


def _blocks(pieces: list[str]) -> Iterator[list[str]]:
    """Runs of pieces that one recursive query contracts."""
    block, rows = [], 0
    for piece in pieces:
        size = len(piece.encode())
        more = size * (size + 1) // 2
        if block and (len(block) == BLOCK or rows + more > TURNS):
            yield block
            block, rows = [], 0
        block.append(piece)
        rows += more
    if block:
        yield block


class Codec:
    """One vocabulary with its merge table in a DuckDB of one thread."""

    def __init__(self, ranks_path: str, pattern: str):
        import duckdb
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.one_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        cuts = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.merges = {(a << 16) + b: m for a, b, m in cuts}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})  # nothing is spilled to the machine's own disk
        if len(self.ranks) > 65536:
            raise ValueError("the merge table packs a pair of ids below 65,536")
        first, second, merged = (np.array(x, dtype=np.int64) for x in zip(*cuts, strict=True))
        self.load("merges", pair=pa.array(first * 65536 + second), merged=pa.array(merged))
        self.load("vocabulary", token=pa.array(list(self.ranks.values()), pa.int32()), shown=pa.array(map(_shown, self.ranks), pa.string()))
        self.known: dict[str, np.ndarray] = {}
        self.said: dict[str, str] = {}
        self.back: dict[str, bytes] = {}

    def load(self, table: str, **columns: pa.Array) -> None:
        self.db.register("arrow_in", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {table} AS SELECT * FROM arrow_in")
        self.db.unregister("arrow_in")

    def learn(self, pieces: Iterable[str]) -> None:
        """Remember the ids of pieces."""
        new = []
        for piece in pieces:
            if piece in self.known:
                continue
            if (whole := self.ranks.get(piece.encode())) is not None:
                self.known[piece] = np.array([whole], dtype=np.uint32)
            elif len(data := piece.encode()) >= LONG:
                self.known[piece] = self.contract(data)
            else:
                new.append(piece)
        for block in _blocks(new):
            data = [p.encode() for p in block]
            sizes = np.array([len(x) for x in data])
            ends = np.cumsum(sizes)
            self.load(
                "bytes_in",
                place=pa.array((np.repeat(np.arange(len(block)), sizes) << 40) + np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)),
                token=pa.array(self.one_byte[np.frombuffer(b"".join(data), dtype=np.uint8)]),
            )
            got = self.db.execute(CONTRACT).fetchnumpy()
            tokens = np.asarray(got["token"]).astype(np.uint32)
            cuts = np.searchsorted(got["piece"], np.arange(1, len(block)))
            self.known.update(zip(block, np.split(tokens, cuts), strict=True))

    def contract(self, data: bytes) -> np.ndarray:
        """The ids of one long piece: the leftmost pair of least rank merges first, until none does."""
        token = self.one_byte[np.frombuffer(data, dtype=np.uint8)].tolist()
        n = len(token)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merged = self.merges.get
        heap = [(m, i) for i in range(n - 1) if (m := merged((token[i] << 16) + token[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            # a pair of which a side has merged since then is not there any more
            if token[i] is None or (j := after[i]) >= n or merged((token[i] << 16) + token[j]) != m:
                continue
            token[i], token[j], after[i] = m, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (found := merged((token[k] << 16) + token[after[k]])) is not None:
                    heapq.heappush(heap, (found, k))
        return np.array([t for t in token if t is not None], dtype=np.uint32)

    def split(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; what is remembered is cleared when it is too much."""
        if len(self.known) > REMEMBERED:
            for memo in (self.known, self.said, self.back):
                memo.clear()
        return [self.find(t) for t in texts]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Token count, digest of the ids and digest of the decoded bytes of each text.

        Both are concatenations over a text's pieces, so each piece's ids are written out, and decoded again, once.
        """
        pieces = self.split(texts)
        new = list(set().union(*pieces) - self.said.keys()) if pieces else []
        self.learn(new)
        self.said.update((p, " ".join(map(str, self.known[p].tolist()))) for p in new)
        self.back.update(zip(new, self.decode([self.known[p] for p in new]), strict=True))
        out = []
        for x in pieces:
            ids = " ".join(map(self.said.__getitem__, x))
            data = b"".join(map(self.back.__getitem__, x))
            out.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest()))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        pieces = self.split(texts)
        self.learn(set().union(*pieces) if pieces else ())
        none = np.zeros(0, dtype=np.uint32)
        return [np.concatenate([self.known[p] for p in x]) if x else none for x in pieces]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        out = [b""] * len(ids)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        block = np.cumsum(sizes) // DECODED
        for b in np.unique(block):
            docs = np.flatnonzero((block == b) & (sizes > 0))
            if not len(docs):
                continue
            self.load(
                "tokens_in",
                doc=pa.array(np.repeat(docs, sizes[docs])),
                pos=pa.array(np.arange(sizes[docs].sum()) - np.repeat(np.cumsum(sizes[docs]) - sizes[docs], sizes[docs])),
                token=pa.array(np.concatenate([ids[d] for d in docs]).astype(np.int32)),
            )
            for doc, shown in self.db.execute(DECODE).fetchall():
                out[doc] = _hidden(shown)
        return out


@functools.lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """The codec of this worker."""
    return Codec(ranks_path, pattern)


def slices(texts: list[str], characters: int = 4_000_000) -> Iterator[slice]:
    """Runs of texts of about so many characters together; a longer text stands alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > characters:
            yield slice(start, i)
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id and token_ids (array<int>) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(texts):
                ids = own.encode(texts[part])
                yield pa.record_batch([batch.column(0)[part], pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=[id_column, "token_ids"])

    pairs = docs.select(F.col(id_column), F.col(text).cast("string"))
    return pairs.mapInArrow(run, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, token_ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id") -> DataFrame:
    """id, token_ids and the decoded bytes of every row of encode()'s result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            ends = batch.column(1)
            ids = [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32) for x in ends]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own.decode(ids), pa.binary())], names=[id_column, "token_ids", "decoded"])

    kind = encoded.schema[id_column].dataType.simpleString()
    return encoded.select(id_column, "token_ids").mapInArrow(run, f"`{id_column}` {kind}, token_ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of every row: the digests are taken where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in slices(texts):
                n, said, back = zip(*own.digests(texts[part]), strict=True)
                yield pa.record_batch([batch.column(0)[part], pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column), F.col(text).cast("string")).mapInArrow(run, f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
