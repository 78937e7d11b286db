"""Jaccard join of word shingle sets by prefix trees.

1. Each document's set of hashed shingles gets a digest; equal sets are one class from here on.
2. Two sets with Jaccard similarity of `threshold` or more miss at most e = n - ceil(threshold n) members of each
   other, so among the e + s lowest hashes of each at least s are common. Only classes of whose low list enough members
   occur in another row's can have a partner; the others, most of a corpus, are done.
3. The whole sets of the rest are counted and ordered by frequency, rare shingles first, over all of them. Shingles of
   one class only join nothing. Among the others a pair has ceil(threshold n) in common for either n, so by the prefix
   filter it shares one of the first (shared - ceil(threshold n) + 1). Passages that many documents have come last and
   start a search only for documents that consist of them. A pair is looked for at its first common shingle only: a
   shingle is left out if all its lists have the same one before it, and so are pairs that share one of the BEFORE
   shingles before it.
4. Lists that share a prefix shingle meet there. First only neighbours in trie order are compared with their whole
   sets and linked; that joins large groups of copies with few comparisons. Then the lists of every shingle whose
   classes are not all linked yet are put into tries of bounded size, which share common beginnings; each list walks
   its own and those of later blocks, skipping subtrees whose members are all linked to it already, are too short or
   long, or can't reach the overlap with what remains, and members whose bitmaps show that too much is missing. This is
   done twice: at first a pair that its bitmaps make all but certain counts as linked inside the task, and of pairs in
   doubt each list gives only the likeliest few, so each trie gives at most 1 + DOUBTFUL pairs for each list that walks
   it, and mistaken links hide few true ones; they are compared, and the second pass gives every pair of classes that
   are then still apart.
5. Components of the links are found, and classes give their documents the smallest id in them.

Every pair of different sets over the threshold is either compared or known to be linked through others, so components
are exact. Sets are compared as 64-bit hashes of shingles. A trie holds TRIE_DEPTH shingles behind the shared one and
the number of the others, which count as possible overlap: whole paths would cost each class its prefix times its set.

Edge cases: a text with fewer words than a shingle is one shingle, a null or empty one has none and links with nothing;
rows that repeat, or share an id, are separate rows of the same class or of two; null ids never become a component id
unless no member has an id. Rows to keep are told apart by id and text together.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.graph import components
from barloom.llm.shared import discard, written

#: Fixed odd multipliers that mix the hashes of a shingle's words.
MIX = 0xBF58476D1CE4E5B9
#: Tokens of a list that the trie holds after the shared one; the rest counts as possible overlap.
TRIE_DEPTH = 32
#: A token of a list is 7 bits of its frequency's logarithm, then so many bits of its hash.
TOKEN_BITS = 56
#: Tokens before the shared one that a list is known by in a trie.
BEFORE = 8
#: Deviations that an expected pair must keep from the threshold to count as linked before it is compared.
SURE = 2
#: Pairs of one list in one trie that are compared though their bitmaps leave them in doubt, before every pair is.
DOUBTFUL = 4
#: What is done in turn; the last finds every pair that is left.
ROUNDS = ("neighbours", "linking tries", "tries")
#: Lists of one shared token that are expected in a block; a trie holds one block.
BLOCK = 2000
#: Blocks whose lists walk a trie in one task; more of them walk a copy of it elsewhere.
WALKERS = 4
#: Found pairs that a task holds before it hands them on.
HELD = 10_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct hashed shingles of a text as unsigned 64-bit numbers."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    wide = min(size, len(words))
    mixed = np.full(len(words) - wide + 1, wide, dtype=np.uint64)
    for k in range(wide):
        mixed = (mixed ^ h[k : len(words) - wide + 1 + k]) * np.uint64(MIX)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


class Bounds:
    """What a similarity of `threshold` means for sets of n members."""

    def __init__(self, threshold: float):
        self.t = Fraction(str(threshold))
        self.up, self.both = self.t.numerator, self.t.numerator + self.t.denominator

    def least(self, n: int) -> int:
        """Members of a set that a similar one must have; also the least size of that one."""
        return -(-n * self.t.numerator // self.t.denominator)

    def surplus(self, n: int) -> int:
        """Common members asked of low lists."""
        return min(self.least(n), max(12, n // 20))

    def low(self, n: int) -> int:
        """Length of the low list."""
        return min(n, n - self.least(n) + self.surplus(n))

    def need(self, n: int) -> int:
        """Common members of the low lists of a set of n and of any similar one."""
        return self.surplus(self.least(n))

    def may_be_similar(self, n_a: int, bits_a: bytes, n_b: int, bits_b: bytes) -> bool:
        """False if the bitmaps alone show that too many members of one set are not in the other."""
        return self.may_match(n_a, Bits(bits_a), n_b, Bits(bits_b))

    def may_match(self, n_a: int, a: Bits, n_b: int, b: Bits) -> bool:
        """may_be_similar() of bitmaps that are numbers already."""
        wide = min(a.width, b.width)
        x, y = a.folded(wide), b.folded(wide)
        # a bit that only one has is a member that the other lacks
        most = min(n_a - x.bit_count(), n_b - y.bit_count()) + (x & y).bit_count()
        return most * self.both >= self.up * (n_a + n_b)

    def excess(self, n_a: int, a: Bits, n_b: int, b: Bits) -> tuple[float, float]:
        """By how many more members than similar sets may the two are expected to differ by their bitmaps, and its deviation."""
        wide = min(a.width, b.width)
        x, y = a.folded(wide), b.folded(wide)
        n_x, n_y, both = x.bit_count(), y.bit_count(), (x & y).bit_count()
        may = (n_a + n_b) * float(1 - 2 * self.up / Fraction(self.both))
        if max(n_x, n_y) == wide:  # full bitmaps tell nothing
            return -may, 0.0
        # a member that the other set lacks is seen unless its bit is one of the other's; scaling by n / bits leans to doubt
        differ = (n_x - both) * n_a / n_x / (1 - n_y / wide) + (n_y - both) * n_b / n_y / (1 - n_x / wide)
        return differ - may, math.sqrt((differ + 1) * max(n_x, n_y) / wide)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= self.t * (len(a) + len(b) - both)


class Bits:
    """A bitmap as a whole number that can be folded to a smaller power of two."""

    __slots__ = ("width", "at")

    def __init__(self, data: bytes):
        self.width = 8 * len(data)
        self.at = {self.width: int.from_bytes(data, "little")}

    def folded(self, width: int) -> int:
        if width not in self.at:
            wider = self.folded(2 * width)
            self.at[width] = wider >> width | wider & (1 << width) - 1
        return self.at[width]


def bitmap(members: np.ndarray) -> bytes:
    """A set as a bitmap of eight to sixteen bits a member, at its hashes' low bits."""
    width = max(64, 1 << (8 * len(members) - 1).bit_length()) if len(members) else 64
    out = np.zeros(width, dtype=np.uint8)
    out[(members & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _arrays(sets: list[np.ndarray]) -> pa.Array:
    """Sets as an Arrow array of lists of signed numbers."""
    ends = np.cumsum([0, *map(len, sets)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _members(column: pa.Array) -> Iterator[np.ndarray]:
    """The sets of _arrays() again; their order stays that of unsigned numbers."""
    for x in column:
        yield x.values.to_numpy().view(np.uint64)


def _text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text).cast("string")).alias("text_hash")


def _sets(docs: DataFrame, size: int, bounds: Bounds, id_column: str, text: str, whole: bool) -> DataFrame:
    """id, text_hash, n, digest and low list (or digest, n, whole set and its bitmap) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, hashes = batch.slice(at, 512), _WordHashes()
                found = [shingles(t, size, hashes) for t in part.column(1).to_pylist()]
                digests = pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in found], pa.int64())
                n = pa.array([len(x) for x in found], pa.int64())
                if whole:
                    yield pa.record_batch([digests, n, _arrays(found), pa.array([bitmap(x) for x in found], pa.binary())], names=["digest", "n", "members", "bits"])
                else:
                    low = _arrays([x[: bounds.low(len(x))] for x in found])
                    yield pa.record_batch([part.column(0), part.column(2), n, digests, low], names=["id", "text_hash", "n", "digest", "low"])

    pairs = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string"), _text_hash(text))
    kind = docs.schema[id_column].dataType.simpleString()
    return pairs.mapInArrow(run, "digest bigint, n bigint, members array<bigint>, bits binary" if whole else f"id {kind}, text_hash bigint, n bigint, digest bigint, low array<bigint>")


def _whole_least(n: str, bounds: Bounds) -> Column:
    """Bounds.least() of column n, in whole numbers."""
    return F.expr(f"({n} * {bounds.t.numerator} + {bounds.t.denominator - 1}) div {bounds.t.denominator}")


def _candidates(rows: DataFrame, bounds: Bounds) -> DataFrame:
    """The digests of classes of whose low list enough members occur in another row's."""
    tokens = rows.select("digest", F.explode("low").alias("token"))
    shared = tokens.groupBy("token").count().where("count > 1").select("token")
    met = tokens.join(shared, "token", "left_semi").groupBy("digest").agg(F.count("*").alias("met"))
    sizes = rows.groupBy("digest").agg(F.first("n").alias("n")).withColumn("n_least", _whole_least("n", bounds))
    need = F.least(_whole_least("n_least", bounds), F.greatest(F.lit(12), F.expr("n_least div 20")))  # Bounds.need()
    return sizes.join(met, "digest").where(F.col("met") >= need).select("digest")


def _lists(members: DataFrame, bounds: Bounds) -> DataFrame:
    """digest, n, need and shared (the tokens of other classes too, rare first) of classes that may have a partner."""
    tokens = members.select("digest", F.explode("members").alias("token"))
    times = tokens.groupBy("token").count().where("count > 1")
    rank = F.shiftleft(F.floor(4 * F.log2("count")).cast("bigint"), TOKEN_BITS)
    times = times.select("token", rank.bitwiseOR(F.col("token").bitwiseAND(F.lit((1 << TOKEN_BITS) - 1))).alias("key"))
    listed = tokens.join(times, "token").groupBy("digest").agg(F.sort_array(F.collect_list("key")).alias("shared"))
    listed = listed.join(members.select("digest", "n", _whole_least("n", bounds).cast("int").alias("need")), "digest")
    return listed.where(F.size("shared") >= F.col("need")).select("digest", "n", "need", "shared")


def _compared(pairs: DataFrame, members: DataFrame, bounds: Bounds) -> DataFrame:
    """The similar ones of the pairs (a, b) of digests: by bitmaps first, then the survivors by their whole sets."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(*(batch.column(c).to_pylist() for c in ("n_a", "bits_a", "n_b", "bits_b")), strict=True)
            keep = pa.array([bounds.may_be_similar(*x) for x in both], pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    def certain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([bounds.similar(x, y) for x, y in zip(_members(batch.column("members_a")), _members(batch.column("members_b")), strict=True)], pa.bool_())
            yield pa.record_batch([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["u", "v"])

    def joined(table: DataFrame, *columns: str) -> DataFrame:
        for side in ("a", "b"):
            table = table.join(members.select(F.col("digest").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
        return table

    near = joined(pairs, "n", "bits").select("a", "b", "n_a", "bits_a", "n_b", "bits_b").mapInArrow(likely, "a bigint, b bigint")
    return joined(near, "members").select("a", "b", "members_a", "members_b").mapInArrow(certain, "u bigint, v bigint")


class Entry:
    """A list in a trie: the class, what it is linked to, the tokens before and behind the shared one, and its bitmap."""

    __slots__ = ("digest", "kind", "before", "n", "need", "rest", "path", "bits")

    def __init__(self, digest: int, kind: int, before: list[int], n: int, need: int, rest: int, path: list[int], bits: bytes):
        self.digest, self.kind, self.before, self.n, self.need, self.rest, self.path, self.bits = digest, kind, frozenset(before), n, need, rest, path, Bits(bits)


class _Node:
    __slots__ = ("children", "entries", "classes", "joined", "before", "fewest", "most", "rest", "need")

    def __init__(self, entry: Entry, depth: int):
        self.children, self.entries, self.classes, self.joined, self.before = {}, [entry], {entry.kind}, 0, entry.before
        self.fewest = self.most = entry.n
        self.rest, self.need = entry.rest - depth, entry.need


class Trie:
    """A prefix tree of lists; walk() gives candidates. With linking, classes of a found pair count as one from then on,
    if the bitmaps make it all but certain; of doubtful ones a list gives the DOUBTFUL likeliest, each of another class.

    A list that is alone in its subtree stands at the subtree's top, so there are fewer than two nodes for each list.
    """

    def __init__(self, bounds: Bounds, linking: bool):
        self.up, self.down, self.bounds, self.linking = bounds.t.numerator, bounds.t.denominator, bounds, linking
        self.root, self.parent, self.joined = None, {}, 0

    def find(self, kind: int) -> int:
        while (above := self.parent.get(kind, kind)) != kind:
            self.parent[kind] = kind = self.parent.get(above, above)
        return kind

    def insert(self, entry: Entry) -> None:
        if self.root is None:
            self.root = _Node(entry, 0)
            return
        node, depth, path = self.root, 0, entry.path
        while True:
            node.classes.add(entry.kind)
            node.before &= entry.before
            node.fewest, node.most = min(node.fewest, entry.n), max(node.most, entry.n)
            node.rest, node.need = max(node.rest, entry.rest - depth), min(node.need, entry.need)
            if node.entries and len(node.entries[0].path) > depth:  # it was alone here
                other = node.entries.pop()
                node.children[other.path[depth]] = _Node(other, depth + 1)
            if len(path) == depth:
                node.entries.append(entry)
                return
            if path[depth] not in node.children:
                node.children[path[depth]] = _Node(entry, depth + 1)
                return
            node, depth = node.children[path[depth]], depth + 1

    def walk(self, entry: Entry) -> Iterator[Entry]:
        """Lists that may be similar to entry, are of other classes and share none of the tokens before with it."""
        path, rest, before, n, need, up, down = entry.path, entry.rest, entry.before, entry.n, entry.need, self.up, self.down
        kind, size = self.find(entry.kind), len(path)
        # node, tokens of the path behind its token, common ones, tokens that may be among those of rest that path lacks
        stack, doubtful = [(self.root, 0, 0, 0)] if self.root else [], []
        while stack:
            node, i, common, unseen = stack.pop()
            most = 1 + common + min(rest - i, node.rest + unseen)
            if most < need or most < node.need or node.most * down < n * up or node.fewest * up > n * down:
                continue
            if node.before and not node.before.isdisjoint(before):
                continue
            if node.joined != self.joined:
                node.classes, node.joined = {self.find(k) for k in node.classes}, self.joined
            if len(node.classes) == 1 and kind in node.classes:
                continue
            for other in node.entries:
                if self.find(other.kind) == kind or not other.before.isdisjoint(before):
                    continue
                if other.n * down >= n * up and other.n * up <= n * down and self.bounds.may_match(n, entry.bits, other.n, other.bits):
                    if self.linking:
                        over, deviation = self.bounds.excess(n, entry.bits, other.n, other.bits)
                        if over + SURE * deviation > 0:
                            doubtful.append((over, other.digest, other))
                            continue
                        self.parent[self.find(other.kind)] = kind
                        self.joined += 1
                    yield other
            for token, child in node.children.items():
                k = i
                while k < size and path[k] < token:
                    k += 1
                hit = k < size and path[k] == token
                stack.append((child, k + hit, common + hit, unseen + (k == size < rest)))
        met = {kind}
        for _, _, other in sorted(doubtful):
            if len(met) <= DOUBTFUL and (its := self.find(other.kind)) not in met:
                met.add(its)
                yield other


def _pairs(group: Iterator[tuple[int, Entry]], bounds: Bounds, linking: bool) -> Iterator[tuple[int, int]]:
    """Pairs of one trie's lists and of those that only walk it, by their roles; the former come first."""
    trie = Trie(bounds, linking)
    for role, entry in group:
        if role != COPY:
            for other in trie.walk(entry):
                yield min(entry.digest, other.digest), max(entry.digest, other.digest)
        if role != WALKER:
            trie.insert(entry)


#: What a list does with a trie: it walks and joins it, joins a copy whose own lists have met elsewhere, or walks only.
OWN, COPY, WALKER = 0, 1, 2


def _blocked(prefixes: DataFrame) -> DataFrame:
    """prefixes with block, part and role, once for each trie that a list meets.

    A token's lists are dealt into blocks by their digests. A list is put into its own block's trie and walks those of
    the later blocks, so any two lists meet in one trie. A block with more than WALKERS earlier ones has its trie in several
    parts, each walked by the lists of WALKERS blocks, so no task gets more than 1 + WALKERS blocks of a token.
    """
    # tokens whose classes are all linked are done
    apart = prefixes.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("lists")).where("x <> y").select("token", "lists")
    blocks = F.ceil(F.col("lists") / BLOCK).cast("int")
    dealt = prefixes.join(apart, "token").withColumn("own", F.pmod(F.xxhash64("digest"), blocks).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence("own", blocks - 1)))
    mine = F.sequence(F.lit(0), F.greatest(F.expr(f"(block - 1) div {WALKERS}").cast("int"), F.lit(0)))
    dealt = dealt.withColumn("part", F.explode(F.when(F.col("block") == F.col("own"), mine).otherwise(F.array(F.expr(f"own div {WALKERS}").cast("int")))))
    return dealt.withColumn("role", F.when(F.col("block") > F.col("own"), WALKER).when(F.col("part") > 0, COPY).otherwise(OWN))


def _tried(prefixes: DataFrame, lists: DataFrame, bounds: Bounds, linking: bool) -> DataFrame:
    """Pairs (a, b) of classes not linked yet that may be similar, by one trie for each block of a shared token's lists.

    lists: (digest, shared, bits).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: set) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True)

        found = set()
        for _, group in itertools.groupby(rows(), key=lambda r: r[:3]):
            for pair in _pairs(((role, Entry(*entry)) for _, _, _, role, *entry in group), bounds, linking):
                found.add(pair)
                if len(found) >= HELD:
                    yield out(found)
                    found = set()
        yield out(found)

    before = F.slice("shared", F.greatest(F.lit(1), F.col("at") + 1 - BEFORE), F.least(F.col("at"), F.lit(BEFORE)))
    path = F.slice("shared", F.col("at") + 2, F.lit(TRIE_DEPTH))
    blocked = _blocked(prefixes).join(lists, "digest")
    blocked = blocked.select("token", "block", "part", "role", "digest", "component", before.alias("before"), "n", "need", (F.size("shared") - F.col("at") - 1).alias("rest"), path.alias("path"), "bits")
    # as many tasks as a shuffle may have: the work grows faster than the bytes
    tasks = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = blocked.repartition(tasks, "token", "block", "part").sortWithinPartitions("token", "block", "part", "role", "n", "digest")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def _neighbours(prefixes: DataFrame, bounds: Bounds) -> DataFrame:
    """Pairs (a, b) of classes not linked yet that stand side by side in trie order; one at most for each class."""
    fits = F.expr(f"n * {bounds.t.numerator} <= n_b * {bounds.t.denominator} AND n_b * {bounds.t.numerator} <= n * {bounds.t.denominator}")
    # a token with many lists has several windows
    lists = prefixes.groupBy("token").agg(F.count("*").alias("lists"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    known = prefixes.join(lists.select("token", "lists"), "token").withColumn("salt", F.pmod(F.xxhash64("digest"), F.ceil(F.col("lists") / BLOCK)))
    by = Window.partitionBy("token", "salt").orderBy("next", "n", "digest")
    pairs = known.withColumns({c: F.lead(x).over(by) for c, x in (("b", "digest"), ("n_b", "n"), ("component_b", "component"))})
    pairs = pairs.where("component <> component_b").where(fits)
    # one comparison for each class, at the first token that offers one
    pairs = pairs.groupBy("digest").agg(F.min(F.struct("at", "token", "b"))["b"].alias("b"))
    return pairs.select(F.least("digest", "b").alias("a"), F.greatest("digest", "b").alias("b")).distinct()


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (digest, component) after links (u, v) of digests."""
    of = lambda node: found.select(F.col("digest").alias(node), F.col("component").alias(f"c_{node}"))
    edges = links.join(of("u"), "u").join(of("v"), "v").select(F.col("c_u").alias("u"), F.col("c_v").alias("v"))
    merged = components(edges).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    return found.join(merged, "component", "left").select("digest", F.coalesce("merged", "component").alias("component"))


def _components(docs: DataFrame, size: int, threshold: float, id_column: str, text: str) -> DataFrame:
    """id, text_hash, n, digest (of the set), low list and component (a digest) of every row of docs."""
    bounds = Bounds(threshold)
    rows = written(_sets(docs, size, bounds, id_column, text, whole=False), "low-lists")
    candidates = written(_candidates(rows, bounds), "candidates")

    wanted = rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id"))["id"].alias("id"))
    # rows without an id are all looked through: theirs may be the only ones of a class
    texts = docs.join(wanted.select(F.col("id").alias(id_column)), id_column, "left_semi").union(docs.where(F.col(id_column).isNull()))
    members = _sets(texts, size, bounds, id_column, text, whole=True).join(candidates, "digest", "left_semi")
    members = written(members.dropDuplicates(["digest"]), "members")

    lists = written(_lists(members, bounds), "shared-lists")
    prefixes = lists.select("digest", "n", "need", "shared", F.posexplode(F.slice("shared", F.lit(1), F.size("shared") - F.col("need") + 1)).alias("at", "token"))
    prefixes = prefixes.select("token", "digest", "n", "need", "at", F.get("shared", F.col("at") - 1).alias("before"), F.slice("shared", F.col("at") + 2, F.lit(2)).alias("next"))
    # a token of one list brings nothing together, and one that always follows the same token nothing that this did not
    met = prefixes.groupBy("token").agg(F.count("*").alias("met"), F.count("before").alias("follow"), F.min("before").alias("x"), F.max("before").alias("y"))
    met = met.where("met > 1 AND (follow < met OR x <> y)").select("token")
    prefixes = written(prefixes.join(met, "token", "left_semi").drop("before"), "prefixes")

    found = written(prefixes.select("digest", F.col("digest").alias("component")).distinct(), "components")
    searched = lists.select("digest", "shared").join(members.select("digest", "bits"), "digest")
    for turn in ROUNDS:
        known = prefixes.join(found, "digest")
        pairs = _neighbours(known, bounds) if turn == "neighbours" else _tried(known, searched, bounds, turn == "linking tries")
        links = written(_compared(pairs, members, bounds), "links")
        if not links.isEmpty():
            before, found = found, written(_joined(found, links), "components")
            discard(before)
        discard(links)
    out = rows.join(found, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    discard(candidates, members, lists, prefixes)
    return out


def join(docs: DataFrame, size: int = 4, threshold: float = 0.85, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, digest (of the set) and component_id of every row of docs."""
    classes = _components(docs, size, threshold, id_column, text)
    smallest = classes.groupBy("component").agg(F.min("id").alias("component_id"))
    return classes.join(smallest, "component").select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "digest", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, threshold: float = 0.8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of docs: the first by id (null ids last), set, text and whole row; sets without members all stay."""
    found = _components(docs, size, threshold, id_column, text).where("n > 0")
    same = written(found.groupBy("component", "id", "text_hash").agg(F.min("digest").alias("digest"), F.count("*").alias("times")), "groups")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "text_hash")
    first = same.groupBy("component").agg(F.min(order).alias("first")).select("component", F.col("first.text_hash").alias("kept_hash"), F.col("first.id").alias("kept_id"))
    same = same.join(first, "component").withColumn("kept", (F.col("text_hash") == F.col("kept_hash")) & F.col("id").eqNullSafe(F.col("kept_id")))

    hashed = docs.withColumn("_text_hash", _text_hash(text))
    of = lambda keys: (hashed["_text_hash"] == keys["text_hash"]) & hashed[id_column].eqNullSafe(keys["id"])
    gone, repeated = same.where("NOT kept OR times > 1").select("id", "text_hash"), same.where("kept AND times > 1").select("id", "text_hash")
    out = hashed.join(gone, of(gone), "left_anti").drop("_text_hash")
    # of rows that repeat id and text, one; partial aggregates keep a single one in each task
    hashable = [c for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    again = hashed.join(repeated, of(repeated), "left_semi").groupBy(id_column, "_text_hash").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashable)).alias("row"))
    return out.union(again.select("row.*"))
