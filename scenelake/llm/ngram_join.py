"""Near duplicates by the Jaccard similarity of word n-grams: an exact join by vertical partitioning.

N-grams are ordered by a 64-bit hash, the same for all texts, and the order is cut into fragments, so a set of
n-grams becomes one segment a fragment.

Candidates. Two sets that reach the threshold differ in at most D n-grams, D known from their sizes, so at most D of
their F segments differ. With segments sorted by size, largest first, each set's first D + 1 must hold one in
common. Only these are shuffled. Large segments first means that a passage many texts share, which fills
segments of its own only by chance, rarely makes a candidate. F depends on a class of sizes; a set near the lower
end of its class stands in the class below too. Parity bitmaps bound the overlap of a candidate pair from above.

Counting. Overlaps of the pairs that are left are counted fragment by fragment and summed per pair.

Groups. What is asked for is which texts are connected, not every link. Equal sets are one node. Within each
candidate segment all nodes are first held against one of them, then what that leaves apart against another.
Nodes still apart are compared by size and bitmap, in blocks of bounded size, and of those that may link no more
edges are kept than connect them. Nodes so connected are verified in blocks, with their n-grams at hand; of the links
found there, again no more are given out than connect them.

Links. Both ends of a link are in one component. So all links are found by holding the nodes of each component
against each other, in blocks of bounded size, with exact overlaps. Those of equal sets are counted from the
number of copies.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.llm.common import small_batches, table, text_of
from scenelake.session import cut_lineage


@dataclass(frozen=True)
class JoinParameters:
    """`words` in an n-gram. `percent`: least similarity. `load`: n-grams a segment holds about, in the
    largest set of a class. `parts`: fragments in which overlaps are counted. `block`: most rows of one segment
    that meet at once, about; `block_grams`: most n-grams of one component that do. `filter_bits`: of the filter on ids before texts are moved; it may pass too many."""

    words: int = 4
    percent: int = 85
    load: float = 4.0
    parts: int = 8
    block: int = 256
    filter_bits: int = 1 << 23
    block_grams: int = 1 << 18

    def least_overlap(self, a: int, b: int) -> int:
        """Smallest i with 100 * i >= percent * (a + b - i)."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def most_difference(self, n: int, least: int = 1, most: int | None = None) -> int:
        """Most n-grams by which a set of n differs from a partner of `least` to `most` n-grams; -1: no partner."""
        low = max(least, -(-self.percent * n // 100))
        high = min(100 * n // self.percent, most if most is not None else 100 * n // self.percent)
        # It grows with the partner's size but for rounding, so the last few sizes hold the largest.
        sizes = {*range(max(low, high - 4), high + 1)}
        return max((n + m - 2 * self.least_overlap(n, m) for m in sizes), default=-1)


@lru_cache(maxsize=100_000)
def _classes(n: int, p: JoinParameters) -> tuple[tuple[int, int, int], ...]:
    """(class, its segments F, segments to send) of a set of n n-grams. Classes hold sizes from 2^c on; a pair
    meets in the class of its smaller set."""
    out = []
    own = n.bit_length() - 1
    lowest = (-(-p.percent * n // 100)).bit_length() - 1
    for c in range(lowest, own + 1):
        end = (2 << c) - 1
        # In a class below its own a set is the larger of a pair whose smaller one is in that class.
        differ = p.most_difference(n) if c == own else p.most_difference(n, 1, end)
        largest = p.most_difference(100 * end // p.percent)
        segments = max(largest + 2, math.ceil(100 * end / p.percent / p.load))
        if differ > 0:
            out.append((c, segments, min(differ + 1, segments)))
    return tuple(out)


BATCH_BYTES = 1 << 22
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngrams(text: str | None, words: int) -> np.ndarray:
    """The set of a text, sorted: 64-bit hashes of its n-grams; of fewer words one for all; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and the six blanks
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), len(found))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(found) - words + 1
    out = np.zeros(n, np.uint64)
    for i in range(words):
        out = _mixed(out + hashes[i : i + n] * _ODD[i % 4])
    return np.unique(out)


def _bitmap(grams: np.ndarray) -> bytes:
    """Parities of n-grams by their low bits; its width is a power of two of about 1.5 to 3 times their number."""
    width = max(64, 1 << math.ceil(math.log2(1.5 * max(1, len(grams)))))
    counts = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _segment_keys(grams: np.ndarray, p: JoinParameters) -> np.ndarray:
    """Keys of the segments to send."""
    keys = [np.zeros(0, np.uint64)]
    for c, segments, sent in _classes(len(grams), p):
        place = ((grams >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        sizes = np.bincount(place, minlength=segments)
        # Sums of mixed hashes: of equal segments equal, whatever their size.
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(grams + _ODD[0]), dtype=np.uint64)])
        ends = np.cumsum(sizes)
        sums = upto[ends] - upto[ends - sizes]
        hashes = _mixed(sums + _mixed(np.arange(segments, dtype=np.uint64) * _ODD[1] + np.uint64(c * int(_ODD[2]) % 2**64)))
        order = np.lexsort((hashes, -sizes))[:sent]
        keys.append(hashes[order])
    return np.unique(np.concatenate(keys))


def _mapped(df: DataFrame, schema: str, types: list[pa.DataType], work: Callable[[list, str | None], Iterator[tuple]]) -> DataFrame:
    """Rows that `work` makes of (key, text); batches of some thousand rows or a few MB at most, so memory stays
    bounded."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        out: list[tuple] = []

        def batch_of(rows):
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        size = 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for row in work(key, text.as_py()):
                    out.append(row)
                    size += sum(v.nbytes for v in row if isinstance(v, np.ndarray))
                if len(out) >= 1000 or size >= BATCH_BYTES:
                    yield batch_of(out)
                    out, size = [], 0
        yield batch_of(out)

    return df.mapInArrow(run, schema)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sizes_and_prints(texts: DataFrame, p: JoinParameters) -> DataFrame:
    """(k, n, print, bits) of (k, text): size of the set, a 128-bit fingerprint of it (null if empty), bitmap."""

    def work(key, text):
        grams = ngrams(text, p.words)
        if len(grams):
            yield key, len(grams), xxhash.xxh3_128_digest(grams.tobytes()), _bitmap(grams)
        else:
            yield key, 0, None, None

    return _mapped(
        texts, "k bigint, n bigint, print binary, bits binary", [pa.int64(), pa.int64(), pa.binary(), pa.binary()], work
    )


def segments_of_nodes(texts: DataFrame, p: JoinParameters) -> DataFrame:
    """(key, node): segments to send of each different set; a node is the smallest key with that set."""

    def work(key, text):
        grams = ngrams(text, p.words)
        if len(grams):
            yield xxhash.xxh3_128_digest(grams.tobytes()), key, _signed(_segment_keys(grams, p))

    sets = _mapped(
        texts, "print binary, k bigint, keys array<bigint>", [pa.binary(), pa.int64(), pa.list_(pa.int64())], work
    )
    # Copies are put together before the shuffle as well as after it.
    nodes = sets.groupBy("print").agg(F.min(F.struct("k", "keys")).alias("s"))
    return nodes.select(F.explode("s.keys").alias("key"), F.col("s.k").alias("node"))


def _distance(a: int, a_bits: int, b: int, b_bits: int) -> int:
    """Differing bits of two bitmaps, the wider one folded to the narrower."""
    while a_bits > b_bits:
        a_bits >>= 1
        a = (a >> a_bits) ^ (a & (1 << a_bits) - 1)
    while b_bits > a_bits:
        b_bits >>= 1
        b = (b >> b_bits) ^ (b & (1 << b_bits) - 1)
    return (a ^ b).bit_count()


def _may_link(a: tuple, b: tuple, p: JoinParameters) -> bool:
    """Of (n, bitmap as a number, its width) of two sets: whether sizes and bitmaps allow a link."""
    if 100 * min(a[0], b[0]) < p.percent * max(a[0], b[0]):
        return False
    return _distance(a[1], a[2], b[1], b[2]) <= a[0] + b[0] - 2 * p.least_overlap(a[0], b[0])


def _facts(n: int, bits: bytes) -> tuple[int, int, int]:
    return n, int.from_bytes(bits, "little"), 8 * len(bits)


def _possible(pairs: DataFrame, nodes: DataFrame, p: JoinParameters) -> DataFrame:
    """Of (a, b) those that sizes and bitmaps allow, with the sizes na and nb."""

    def run(batches):
        for batch in batches:
            keep = [
                _may_link(_facts(na, x), _facts(nb, y), p)
                for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "xa", "xb")))
            ]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b", "na", "nb"])

    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint")


def _filter_of(ids: DataFrame, p: JoinParameters):
    """A filter of fixed size on (id), as a broadcast: it only spares moving sets that aren't asked for."""
    ends = ids.select(F.pmod("id", F.lit(p.filter_bits)).alias("at"))
    words = ends.groupBy(F.expr("at div 8").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1, cast(at % 8 as int))")).alias("bits")
    )
    held = np.zeros(p.filter_bits // 8, np.uint8)
    for word, bits in words.collect():
        held[word] = bits
    return ids.sparkSession.sparkContext.broadcast(held.tobytes())


def _links(pairs: DataFrame, texts: DataFrame, p: JoinParameters) -> DataFrame:
    """Of the pairs (a, b, na, nb) those that are links: overlaps counted by fragment, summed by pair."""
    pairs = cut_lineage(pairs)
    shared = _filter_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), p)

    def work(key, text):
        at = key % p.filter_bits
        if shared.value[at >> 3] >> (at & 7) & 1:
            grams = ngrams(text, p.words)
            cuts = np.searchsorted(grams, [np.uint64(i * (2**64 // p.parts)) for i in range(1, p.parts)])
            for i, part in enumerate(np.split(grams, cuts)):
                if len(part):
                    yield key, len(grams), i, _signed(part)

    parts = _mapped(
        texts, "id bigint, n bigint, part int, grams array<bigint>",
        [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())], work,
    )
    one = parts.select(F.col("id").alias("a"), F.col("n").alias("na"), "part", F.col("grams").alias("of_a"))
    two = parts.select(F.col("id").alias("b"), F.col("n").alias("nb"), "part", F.col("grams").alias("of_b"))
    asked = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(p.parts - 1))))
    counted = asked.join(one, ["a", "na", "part"]).join(two, ["b", "nb", "part"]).select(
        "a", "b", "na", "nb", "part", F.size(F.array_intersect("of_a", "of_b")).alias("c")
    )
    # A row that is repeated has its parts twice.
    counted = counted.groupBy("a", "b", "na", "nb", "part").agg(F.max("c").alias("c"))
    sums = counted.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    return cut_lineage(
        sums.where(F.lit(100) * F.col("c") >= F.lit(p.percent) * (F.col("na") + F.col("nb") - F.col("c"))).select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in `links` (a, b): the smallest node that links lead to."""
    both = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("component")
    ))
    while True:
        told = both.join(state.select(F.col("node").alias("b"), "component"), "b").select(
            F.col("a").alias("node"), "component"
        )
        least = state.unionByName(told).groupBy("node").agg(F.min("component").alias("to"))
        # Every node then takes what the node it points at points at, which halves the way.
        ahead = state.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        jumped = least.join(ahead, "to", "left").select("node", F.least("to", "beyond").alias("component"))
        jumped = cut_lineage(jumped)
        before = state.withColumnRenamed("component", "was")
        changed = jumped.join(before, "node").where("component <> was").limit(1).count()
        state = jumped
        if not changed:
            return state


def _joined(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Components after more edges; what is connected already takes part as one edge a node."""
    edges = cut_lineage(edges)
    if edges.isEmpty():
        return state
    known = state.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    return components(known.unionByName(edges))


class _Sets:
    """Union-find over what a cell holds."""

    def __init__(self):
        self.above: dict = {}

    def root(self, x):
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def unite(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)
        return x != y


def _open_rows(multi: DataFrame, state: DataFrame) -> DataFrame:
    """(key, node, component, rows, last) of segments whose nodes are not all in one component."""
    placed = cut_lineage(
        multi.select("key", "node").join(state, "node", "left").withColumn("component", F.coalesce("component", "node"))
    )
    rows = cut_lineage(
        placed.groupBy("key").agg(
            F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("rows"),
            F.max("node").alias("last"),
        ).where("least <> most").select("key", "rows", "last")
    )
    return placed.join(rows, "key")


def _may_connect(open_rows: DataFrame, nodes: DataFrame, p: JoinParameters) -> DataFrame:
    """Edges (a, b) over nodes that share a segment, as few as keep together all that aren't connected yet and may
    link: of each cell less than it has rows."""
    blocks = F.ceil(F.col("rows") / p.block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # Each block of a segment's rows meets itself and every other block in a cell of its own.
    cells = (
        open_rows.join(nodes.select("node", "n", "bits"), "node").withColumn("blocks", blocks).withColumn("own", own)
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n",
            "component", "bits",
        )
    )

    def edges_of(cell: list[tuple]) -> Iterator[tuple]:
        sets = _Sets()
        rows = [(own_block, node, component, _facts(n, bits)) for own_block, node, n, component, bits in cell]
        alone = len({r[0] for r in rows}) == 1
        # In a cell of two blocks, what each connects by itself comes first and isn't given out again.
        for within in (True,) if alone else (True, False):
            for x, (block_a, a, of_a, fact_a) in enumerate(rows):
                for block_b, b, of_b, fact_b in rows[x + 1 :]:
                    # Nodes, not their components, are united: each pair that may link ends up connected by edges.
                    if (
                        of_a != of_b and (block_a == block_b) == within and sets.root(a) != sets.root(b)
                        and _may_link(fact_a, fact_b, p)
                    ):
                        sets.unite(a, b)
                        if alone or not within:
                            yield (a, b) if a < b else (b, a)

    def run(batches):
        # Rows come sorted by cell; one may go on in the next batch.
        at, cell, seen = None, [], set()

        def batch_of(rows):
            columns = list(zip(*rows)) or [()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

        def found(rows):
            # The same edge often comes from many segments; what a task has given out lately it doesn't repeat.
            fresh = [r for r in edges_of(rows) if r not in seen]
            if len(seen) > 200_000:
                seen.clear()
            seen.update(fresh)
            return fresh

        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "i", "j", "own", "node", "n", "component", "bits")]
            for key, i, j, *row in zip(*columns):
                if (key, i, j) != at:
                    out += found(cell)
                    at, cell = (key, i, j), []
                    if len(out) >= 10_000:
                        yield batch_of(out)
                        out = []
                # A cell of a block with itself holds each row once; of two blocks, one row per block.
                cell.append(tuple(row))
        yield batch_of(out + found(cell))

    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def _connected(named: DataFrame, p: JoinParameters) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (k, text): size and fingerprint of each row, the nodes, and the components of linked nodes."""
    prints = cut_lineage(sizes_and_prints(named, p))
    sets = cut_lineage(
        prints.where("print is not null").groupBy("print").agg(F.min(F.struct("k", "n", "bits")).alias("s"))
        .select("print", F.col("s.k").alias("node"), F.col("s.n").alias("n"), F.col("s.bits").alias("bits"))
    )
    segments = cut_lineage(segments_of_nodes(named, p))
    # One segment may be in a large share of all texts: summed before the shuffle, and joined as rows that can be split.
    hubs = cut_lineage(
        segments.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub")
    )
    multi = cut_lineage(segments.join(hubs, "key"))
    stars = multi.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = _links(_possible(stars, sets, p), named, p)
    state = components(links)
    # The first hub may be unlike all others, so what it leaves apart meets another one.
    left = _open_rows(multi, state)
    second = left.where("node <> last").select(F.col("node").alias("a"), F.col("last").alias("b")).distinct()
    state = _joined(state, _links(_possible(second, sets, p), named, p))
    open_pairs = cut_lineage(_may_connect(_open_rows(multi, state), sets, p))
    if open_pairs.isEmpty():
        return prints, sets, state
    coarse = components(open_pairs)
    state = _joined(state, _linked(named, prints, sets, coarse, p, "edges").select("a", "b"))
    # Blocks are held against each other last, and only in groups that are still apart.
    return prints, sets, _joined(state, _linked(named, prints, sets, coarse, p, "edges", state).select("a", "b"))


def _overlaps(sets: list[np.ndarray], split: int) -> np.ndarray:
    """Sizes of the intersections of the first `split` sets with the others; of all with all if there are no others."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width, other = 4096, slice(split, None) if split < len(sets) else slice(None)
    counts = np.zeros((split, len(sets[other])), np.int64)
    for low in range(0, int(place[-1]) + 1, width):
        begin, end = np.searchsorted(place, [low, low + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[begin:end], place[begin:end] - low] = 1
        counts += (has[:split] @ has[other].T).astype(np.int64)
    return counts


def _linked(named: DataFrame, prints: DataFrame, sets: DataFrame, state: DataFrame, p: JoinParameters, what: str, fine: DataFrame | None = None) -> DataFrame:
    """Links within the components of `state`, verified in cells that hold the n-grams of their nodes. `pairs`: all, as
    (a, b, overlap); `counts`: (node, links), the documents that hold the sets a node is linked to, in parts to be
    summed; `edges`: as many as connect what is linked, within blocks; or, if `fine` says what is connected by
    now, across blocks of components that aren't."""
    copies = prints.where("print is not null").groupBy("print").agg(F.count_distinct("k").alias("copies"))
    members = state.join(sets.select("print", "node", "n"), "node").join(copies, "print")
    if fine is None:
        members = cut_lineage(members.withColumn("fine", F.col("node")))
    else:
        now = fine.select("node", F.col("component").alias("fine"))
        members = cut_lineage(members.join(now, "node", "left").withColumn("fine", F.coalesce("fine", "node")))

    sizes = members.groupBy("component").agg(
        F.ceil(F.greatest(F.count("*") / p.block, F.sum("n") / p.block_grams)).cast("int").alias("blocks"),
        F.min("fine").alias("least"), F.max("fine").alias("most"),
    )
    if fine is not None:
        sizes = sizes.where("blocks > 1 and least <> most")
        members = cut_lineage(members.join(sizes.select("component"), "component", "left_semi"))
    sizes = sizes.select("component", "blocks")
    names = ["node", "links"] if what == "counts" else ["a", "b", "overlap"]
    schema = ", ".join(f"{n} bigint" for n in names)
    if members.isEmpty():
        return named.sparkSession.createDataFrame([], schema)
    asked = {"edges": "i = j" if fine is None else "i <> j"}.get(what, "true")
    shared = _filter_of(members.select(F.col("node").alias("id")), p)

    def work(key, text):
        at = key % p.filter_bits
        if shared.value[at >> 3] >> (at & 7) & 1:
            grams = ngrams(text, p.words)
            if len(grams):
                yield xxhash.xxh3_128_digest(grams.tobytes()), _signed(grams)

    texts = _mapped(named, "print binary, grams array<bigint>", [pa.binary(), pa.list_(pa.int64())], work)
    cells = (
        members.join(sizes, "component").join(texts.dropDuplicates(["print"]), "print")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(
            "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node",
            "copies", "fine", "grams",
        ).where(asked)
    )

    def of_cell(i: int, j: int, cell: list[tuple]) -> Iterator[tuple]:
        cell.sort(key=lambda r: r[0])
        split = sum(r[0] == i for r in cell)
        if len(cell) < 2 or not split or (i != j and split == len(cell)):
            return
        counts = _overlaps([r[4] for r in cell], split)
        one, two = cell[:split], cell if i == j else cell[split:]
        n_one, n_two = (np.array([len(r[4]) for r in x]) for x in (one, two))
        found = 100 * counts >= p.percent * (n_one[:, None] + n_two[None, :] - counts)
        if i == j:
            np.fill_diagonal(found, False)
        if what != "counts":
            joined = _Sets()
            for x, y in zip(*np.nonzero(np.triu(found) if i == j else found)):
                a, b = one[x][1], two[y][1]
                if what == "pairs" or joined.unite(one[x][3], two[y][3]):
                    yield min(a, b), max(a, b), int(counts[x, y])
            return
        yield from zip([r[1] for r in one], (found @ np.array([r[2] for r in two])).tolist())
        if i != j:
            yield from zip([r[1] for r in two], (found.T @ np.array([r[2] for r in one])).tolist())

    def run(batches):
        # Rows come sorted by cell; one may go on in the next batch.
        def batch_of(rows):
            columns = list(zip(*rows)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        at, cell, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("component", "i", "j", "own", "node", "copies", "fine")]
            for (component, i, j, *row), grams in zip(zip(*columns), batch.column("grams")):
                if (component, i, j) != at:
                    for made in of_cell(*at[1:], cell) if at else ():
                        out.append(made)
                        if len(out) >= 10_000:
                            yield batch_of(out)
                            out = []
                    at, cell = (component, i, j), []
                cell.append((*row, grams.values.to_numpy()))
        for made in of_cell(*at[1:], cell) if at else ():
            out.append(made)
        yield batch_of(out)

    dealt = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return dealt.mapInArrow(run, schema)


def _identified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(k, text) of the rows with a key and of those without; and, only if a key stands for several texts, (id, key, h):
    a number for each key and text hash, which then stand in place of the keys."""
    small_batches(docs.sparkSession)
    whole = docs.select(docs[key].cast("bigint").alias("k"), text_of(docs, text).alias("text"))
    named, nameless = whole.where("k is not null"), whole.where("k is null")
    hashed = named.withColumn("h", F.xxhash64("text"))
    clashes = hashed.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").limit(1).count()
    if not clashes:
        return named, nameless, None
    ids = cut_lineage(
        hashed.select("k", "h").distinct().select(F.monotonically_increasing_id().alias("id"), F.col("k").alias("key"), "h")
    )
    numbered = hashed.withColumnRenamed("k", "key").join(ids, ["key", "h"]).select(F.col("id").alias("k"), "text")
    return cut_lineage(numbered), nameless, ids


def near_duplicate_links(
    docs: DataFrame, key: str = "doc_id", text: str = "text", p: JoinParameters = JoinParameters()
) -> tuple[DataFrame, DataFrame]:
    """All links, as pairs (a, b, overlap; a < b) of representatives, and who they stand for: (key, node) of every row
    with a set, where a node is the smallest key with that set. Rows of one node are linked with each other. If a key
    stands for several texts, representatives are numbers of their own."""
    named, _, ids = _identified(docs, key, text)
    prints, sets, state = _connected(named, p)
    members = prints.where("print is not null").select("k", "print").join(sets.select("print", "node"), "print")
    if ids is not None:
        members = members.join(ids.select(F.col("id").alias("k"), "key"), "k").select(F.col("key").alias("k"), "node")
    return _linked(named, prints, sets, state, p, "pairs"), members.select(F.col("k").alias(key), "node")


def _grouped(named: DataFrame, ids: DataFrame | None, p: JoinParameters, links: bool) -> DataFrame:
    """(k, n_shingles, component_id) of each named row, with n_links if asked for; with `ids`, and h, of each id."""
    prints, sets, state = _connected(named, p)
    classes = sets.select("print", "node").join(state, "node", "left")
    columns = ["k", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "k").alias("component_id")]
    if links:
        counts = _linked(named, prints, sets, state, p, "counts").groupBy("node").agg(F.sum("links").alias("links"))
        copies = prints.where("print is not null").groupBy("print").agg(F.count_distinct("k").alias("copies"))
        classes = classes.join(counts, "node", "left").join(copies, "print")
        columns.append((F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"))
    found = prints.join(classes, "print", "left").select(*columns)
    if ids is None:
        return found
    # Numbers back to keys: a component is named by its smallest key.
    back = cut_lineage(found.join(ids.withColumnRenamed("id", "k"), "k"))
    named_by = back.groupBy("component_id").agg(F.min("key").alias("least"))
    rest = ["n_links"] if links else []
    return back.join(named_by, "component_id").select(
        F.col("key").alias("k"), "n_shingles", F.col("least").alias("component_id"), *rest, "h", F.col("component_id").alias("class")
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", p: JoinParameters = JoinParameters(), links: bool = False
) -> DataFrame:
    """A row per document: key, `n_shingles` (size of its set), `component_id` (smallest key it is linked to, over any
    number of links, itself included) and, with `links`, `n_links`: how many other documents it is linked with itself,
    those of equal sets among them.

    Keys are whole numbers. Null, empty and blank texts have empty sets and are linked with nothing. Rows with a
    null key keep their size; their component and links are null. Rows that repeat key and text are one document,
    each returned; other texts under the same key are documents of their own. An empty table gives an empty
    result. Only the two named columns are read.
    """
    named, nameless, ids = _identified(docs, key, text)
    found = _grouped(named, ids, p, links)
    columns = ["k", "n_shingles", "component_id", *(["n_links"] if links else [])]
    nothing = F.lit(None).cast("long")
    rest = sizes_and_prints(nameless, p).select(
        "k", F.col("n").alias("n_shingles"), F.col("k").alias("component_id"), nothing.alias("n_links")
    )
    return found.select(columns).unionByName(rest.select(columns)).withColumnRenamed("k", key)


def near_duplicate_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", p: JoinParameters = JoinParameters()
) -> DataFrame:
    return near_duplicates(docs, key, text, p, True)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", p: JoinParameters = JoinParameters()) -> DataFrame:
    """`docs` with one row of each group of near duplicates: the one of the smallest key, once if it is repeated, and of
    several texts under that key one. Other texts under a key are documents of their own. Rows with a null key can't be
    told apart and stay. Columns stay as they are."""
    named, _, ids = _identified(docs, key, text)
    found = _grouped(named, ids, p, False)
    if ids is None:
        first = cut_lineage(found.where("k = component_id").select(F.col("k").alias(key)).distinct())
        kept = docs.join(first, key, "left_semi").dropDuplicates([key])
    else:
        chosen = cut_lineage(found.groupBy("class").agg(F.min(F.struct("k", "h")).alias("s")))
        first = chosen.select(F.col("s.k").alias("_own_key"), F.col("s.h").alias("_own_hash"))
        hashed = docs.withColumns({"_own_key": F.col(key).cast("bigint"), "_own_hash": F.xxhash64(text_of(docs, text))})
        names = ["_own_key", "_own_hash"]
        kept = hashed.join(first, names, "left_semi").dropDuplicates(names).drop(*names)
    return kept.unionByName(docs.where(F.col(key).isNull()))


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), links=True)


def op9_ngram_jaccard_links(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_counts(table(spark, sf_dir, "documents"))
