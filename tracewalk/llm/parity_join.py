"""N-gram Jaccard self join by parity sketches.

A text's shingle hashes are split by value into m parts; XOR over a part's hashes
is the part's parity sketch. Two sets whose symmetric difference has at most D
shingles differ in at most D parts, so with m = D + 1 + E parts at least E + 1
parts agree: the pigeonhole. Pairs with Jaccard >= t fall into one size band, or
straddle one band boundary; D is the largest difference that a linked pair of the
band (or straddle) can have, so equal part keys find every link. E leaves room for
empty parts: only texts with more than E of them emit the empty ones.

Buckets with the same nodes are one. A bucket's nodes are first compared with its least node
alone, and then only nodes that are still apart are compared with each other, by parity
sketches (each shingle flips one bit), whose Hamming distance never exceeds the symmetric
difference. Their width is a power of two of at least the set's size and 1024 bits, so
long texts do not saturate them; a wider one is folded, by XOR of its halves, to meet a narrower.
What passes spans candidate components, which hold every link.

Whole shingle sets are dealt once by component and decide the links there; a component of more rows
than a block is dealt in pairs of blocks, after its rows have been held to its least node:
pairs of blocks all of whose rows are linked to that node meet only if links are counted.
What leaves a task is a spanning forest of its links and, if they are counted, a number a node,
weighted by exact copies, and never the pairs.

Nodes are 64-bit digests of shingle sets. A second 64-bit digest shows where two different sets
share one; such sets get digests made of both. Keys that a sample shows to be frequent are
dealt by key and node, so that no task gathers all rows of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import connected_components, forest
from .scratch import discard, materialize, release, trim

U64 = np.uint64
#: Bits of the narrowest sketch.
SKETCH_BITS = 1024
#: Rows of one bucket that meet in one task; a larger bucket is compared in pairs of blocks.
BLOCK = 2048
BATCH_ROWS = 10_000
#: Rows of one component, and shingles of theirs, that meet in one task when links are decided; a larger one is decided in pairs of blocks.
LINK_BLOCK = 1024
LINK_SHINGLES = 1 << 19
#: Frequent keys are those of so large a share of so many sampled texts. They are only dealt otherwise, so the sample decides nothing.
HOT_SAMPLE, HOT_SHARE, HOT_KEYS = 4000, 0.02, 20_000
#: Rows of a batch that goes to Python with whole shingle sets.
WIDE_ROWS = 500
#: Rows of a batch of keys.
NARROW_ROWS = 50_000
#: Rows of one bucket that a task holds at a time.
RUN_ROWS = 1 << 20
#: Sets that share a 64-bit digest with another are this few at most, or the corpus is too large for it.
MOST_TWINS = 100_000


def bands(percent: int, upto: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the size bands; each is over (100/percent)**3 times the one before."""
    at = [1]
    while at[-1] < upto:
        at.append(max(at[-1] + 1, -(-at[-1] * 100**3 // percent**3)))
    return np.array(at, np.int64)


def _parts(most: int, fewest: int, percent: int, least_sum: int) -> tuple[int, int]:
    """(parts m, spare parts E) for linked pairs whose sizes add up to at most ``least_sum``."""
    d = (100 - percent) * least_sum // (100 + percent)
    if d == 0:
        return 1, 0
    empty = (d + 1) * np.exp(-fewest / (d + 1))
    spare = int(np.ceil(empty + 2.5 * np.sqrt(empty)))
    return d + 1 + spare, spare


def _memberships(sizes: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For the band and the straddle of each set: (rows, interval code, parts, spare parts)."""
    at = bands(percent)
    band = np.searchsorted(at, sizes, "right") - 1
    table: dict[int, tuple[int, int]] = {}

    def of(code: int) -> tuple[int, int]:
        if code not in table:
            k = code >> 1
            if code & 1:  # straddles at[k]: the smaller set is below it, the larger from it on
                below = int(at[k]) - 1
                table[code] = _parts(0, -(-int(at[k]) * percent // 100), percent, below + below * 100 // percent)
            else:
                table[code] = _parts(0, int(at[k]), percent, 2 * (int(at[k + 1]) - 1))
        return table[code]

    out = []
    rows = np.flatnonzero(sizes > 0)
    up, low = at[np.minimum(band + 1, len(at) - 1)], at[np.maximum(band, 0)]
    for mask, codes in (
        (sizes > 0, band * 2),
        ((sizes > 0) & (sizes * 100 // percent >= up), (band + 1) * 2 + 1),
        ((sizes > 0) & (band > 0) & (sizes * percent <= (low - 1) * 100), band * 2 + 1),
    ):
        rows = np.flatnonzero(mask)
        if len(rows):
            codes = codes[rows]
            kinds, inv = np.unique(codes, return_inverse=True)
            both = np.array([of(int(c)) for c in kinds], np.int64)
            out.append((rows, codes, both[inv, 0], both[inv, 1]))
    return out


def digests(found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set; 0 for an empty one."""
    ends = np.cumsum(sizes)
    out = np.zeros((2, len(sizes)), np.uint64)
    full = sizes > 0
    if full.any():
        begins, n = (ends - sizes)[full], sizes[full].astype(np.uint64)
        for x, seed in zip(out, (0x5851F42D4C957F2D, 0x14057B7EF767814F), strict=True):
            h = tk.mix(found ^ U64(seed))
            x[full] = tk.mix(np.add.reduceat(h, begins) ^ tk.mix(np.bitwise_xor.reduceat(h, begins)) + n)
    return out[0], out[1]


def nodes_of(found: np.ndarray, sizes: np.ndarray, twins: np.ndarray) -> np.ndarray:
    """The node of each set: its digest, or one made of both digests where it is among ``twins`` (ascending)."""
    node, check = digests(found, sizes)
    if len(twins):
        at = np.minimum(np.searchsorted(twins, node), len(twins) - 1)
        twin = twins[at] == node
        node[twin] = tk.mix(node[twin] ^ tk.mix(check[twin] + U64(len(twins))))
    return node


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """Width of each set's sketch: the power of two not below its size, at least SKETCH_BITS."""
    return np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))


def sketches(found: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The sketch of each set; each shingle flips one bit, whose place modulo a narrower width is its place there."""
    width = sketch_bits(sizes)
    ends = np.cumsum(width)
    bit = (tk.mix(found + U64(0x2545F4914F6CDD1D)) & np.repeat(width - 1, sizes).astype(np.uint64)).astype(np.int64)
    flips = np.bincount(np.repeat(ends - width, sizes) + bit, minlength=int(width.sum()))
    raw = np.packbits((flips & 1).astype(np.uint8)).tobytes()
    return [raw[(e - w) // 8 : e // 8] for e, w in zip(ends.tolist(), width.tolist(), strict=True)]


class SketchTable:
    """Sketches of different widths, for distances of many pairs at a time."""

    def __init__(self, raw: list[bytes]):
        lengths = np.array([len(x) for x in raw], np.int64)
        self.kinds, self.kind = np.unique(lengths, return_inverse=True)
        self.place = np.zeros(len(raw), np.int64)
        self.rows = []
        for k, n in enumerate(self.kinds):
            own = np.flatnonzero(self.kind == k)
            self.place[own] = np.arange(len(own))
            self.rows.append(np.frombuffer(b"".join(raw[i] for i in own), np.uint64).reshape(len(own), -1))

    def _at(self, i: np.ndarray, k: int, bytes_: int) -> np.ndarray:
        out = self.rows[k][self.place[i]]
        while out.shape[1] * 8 > bytes_:
            half = out.shape[1] // 2
            out = out[:, :half] ^ out[:, half:]
        return out

    def distances(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        both = self.kind[i] * len(self.kinds) + self.kind[j]
        for c in np.unique(both):
            a, b = divmod(int(c), len(self.kinds))
            narrow = int(min(self.kinds[a], self.kinds[b]))
            pick = np.flatnonzero(both == c)
            step = max(1, (16 << 20) // narrow)
            for lo in range(0, len(pick), step):
                p = pick[lo : lo + step]
                out[p] = np.bitwise_count(self._at(i[p], a, narrow) ^ self._at(j[p], b, narrow)).sum(1, dtype=np.int64)
        return out


def part_keys(found: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of every part that may witness a link."""
    ends = np.cumsum(sizes)
    for rows, codes, m, spare in _memberships(sizes, percent):
        n = sizes[rows]
        own = np.repeat(np.arange(len(rows)), n)
        at = np.repeat((ends - sizes)[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        h = found[at]
        part = ((h >> U64(32)) * m[own].astype(np.uint64)) >> U64(32)
        # Hashes ascend within a set, so a part's shingles stand together.
        fresh = np.ones(len(h), bool)
        fresh[1:] = (part[1:] != part[:-1]) | (own[1:] != own[:-1])
        begins = np.flatnonzero(fresh)
        parity = np.bitwise_xor.reduceat(tk.mix(h + U64(0x9FB21C651E98DF25)), begins)
        row, part = own[begins], part[begins]
        code = codes[row].astype(np.uint64)
        yield rows[row], tk.mix(parity ^ tk.mix(part + code * U64(0x100000001B3)))
        empties = m - np.bincount(row, minlength=len(rows))
        for i in np.flatnonzero(empties > spare):
            has = part[row == i]
            gone = np.setdiff1d(np.arange(int(m[i]), dtype=np.uint64), has)
            yield np.full(len(gone), rows[i]), tk.mix(tk.mix(gone + U64(int(codes[i])) * U64(0x100000001B3)) ^ U64(0xE5CA1ADE))


def _sets(batch: pa.RecordBatch, k: int):
    for first, end, data, offsets in tk.chunks(batch.column("text")):
        _, _, hashes, per_text = tk.words(data, offsets, tk.NON_SPACE)
        yield (first, end, *tk.shingle_sets(hashes, per_text, k))


def _describe(batches, k: int, twins: np.ndarray):
    for batch in batches:
        for first, end, found, sizes in _sets(batch, k):
            bits = sketches(found, sizes)
            columns = [pa.array(sizes, pa.int64()), pa.array(tk.as_signed(nodes_of(found, sizes, twins))), pa.array(tk.as_signed(digests(found, sizes)[1])), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[first:end], *columns], names=["doc_id", "n_shingles", "node", "check", "sketch"])
    trim()


def _keys(batches, k: int, percent: int, twins: np.ndarray, hot: np.ndarray, salts: int):
    for batch in batches:
        seen: set[int] = set()  # exact copies within a batch emit once
        for _, _, found, sizes in _sets(batch, k):
            nodes = nodes_of(found, sizes, twins)
            once = np.zeros(len(nodes), bool)
            once[np.unique(nodes, return_index=True)[1]] = True
            once &= np.array([x not in seen for x in nodes.tolist()], bool)
            seen.update(nodes.tolist())
            kept = np.where(once, sizes, 0)
            chosen = found[np.repeat(once, sizes)]
            for rows, key in part_keys(chosen, kept, percent):
                own = nodes[rows]
                salt = np.zeros(len(key), np.int32)
                if len(hot):
                    often = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                    salt[often] = 1 + (tk.mix(own[often]) % U64(salts)).astype(np.int32)
                for i in range(0, len(rows), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(tk.as_signed(key[i : i + 200_000])), pa.array(salt[i : i + 200_000]), pa.array(tk.as_signed(own[i : i + 200_000]))], names=["key", "salt", "node"])
    trim()


def _buckets(batches):
    """From rows ordered by key, salt and node: (bucket, node) of keys with two nodes or more, and of all salted ones.

    A bucket is named by its nodes, so that keys with the same nodes are one bucket, but by its key where
    a task does not hold all of its rows. Two buckets under one name would only be compared together.
    """
    key, salt, node = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    open_key: int | None = None  # of which rows have gone out already

    def out(key, salt, node, last: bool):
        nonlocal open_key
        if not len(key):
            return None
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        once = fresh.copy()
        once[1:] |= node[1:] != node[:-1]
        key, salt, node, fresh = key[once], salt[once], node[once], fresh[once]
        begins = np.flatnonzero(fresh)
        n = np.diff(np.append(begins, len(key)))
        name = tk.mix(np.add.reduceat(tk.mix(node + U64(0x632BE59BD9B4E019)), begins) + n.astype(np.uint64))
        by_key = salt[begins] > 0
        if open_key is not None:
            by_key[0] |= int(key[0]) == open_key
        if not last:  # the one run of a key that more rows belong to
            by_key[:] = True
            open_key = int(key[0])
        name[by_key] = tk.mix(key[begins][by_key] ^ U64(0x7FB5D329728EA185))
        keep = np.repeat((n > 1) | by_key, n)
        return pa.RecordBatch.from_arrays([pa.array(tk.as_signed(np.repeat(name, n)[keep])), pa.array(tk.as_signed(node[keep]))], names=["bucket", "node"])

    for batch in batches:
        key = np.concatenate([key, batch.column("key").to_numpy().view(np.uint64)])
        salt = np.concatenate([salt, batch.column("salt").to_numpy()])
        node = np.concatenate([node, batch.column("node").to_numpy().view(np.uint64)])
        if not len(key):
            continue
        other = np.flatnonzero((key != key[-1]) | (salt != salt[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield out(key[:cut], salt[:cut], node[:cut], True)
            open_key = None
        elif len(key) >= RUN_ROWS:
            yield out(key, salt, node, False)
            cut = len(key)
        key, salt, node = key[cut:], salt[cut:], node[cut:]
    if len(key):
        yield out(key, salt, node, True)


def _close(batches, percent: int):
    """The pairs whose sketches allow a link."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 5000):
            part = batch.slice(lo, 5000)
            n, m = part.column("na").to_numpy(), part.column("nb").to_numpy()
            table = SketchTable(part.column("sa").to_pylist() + part.column("sb").to_pylist())
            far = table.distances(np.arange(len(n)), np.arange(len(n)) + len(n))
            ok = (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & ((100 - percent) * (n + m) // (100 + percent) >= far)
            yield part.select(["a", "b"]).filter(pa.array(ok))


def _compare(part: dict[str, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate links (i, j) among rows sorted by bucket: apart, of linkable sizes, Hamming distance within bounds."""
    g1, g2, size, root, block = (part[x] for x in ("bucket", "pair", "n", "root", "block"))
    bits = part["bits"]
    left, right = [], []
    at = np.arange(len(g1))
    d = 0
    while True:
        d += 1
        at = at[at + d < len(g1)]
        at = at[(g1[at] == g1[at + d]) & (g2[at] == g2[at + d])]
        if not len(at):
            break
        i, j = at, at + d
        # In a pair of different blocks, pairs within a block are another task's.
        pick = (root[i] != root[j]) & ((block[i] != block[j]) | part["same"][i])
        i, j = i[pick], j[pick]
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        pick = small * 100 >= large * percent
        i, j = i[pick], j[pick]
        for k in range(0, len(i), 100_000):
            x, y = i[k : k + 100_000], j[k : k + 100_000]
            far = bits.distances(x, y)
            room = (100 - percent) * (size[x] + size[y]) // (100 + percent) - far
            ok = room >= 0
            left.append(x[ok])
            right.append(y[ok])
    if not left:
        none = np.zeros(0, np.int64)
        return none, none
    return np.concatenate(left), np.concatenate(right)


def _whole_buckets(batches, least: int, least_bytes: int = 8 << 20) -> Iterator[pa.Table]:
    """Buckets arrive whole and in order; runs of whole buckets, of ``least`` rows or ``least_bytes`` or more but for the last."""
    held: list[pa.RecordBatch] = []
    rows, size = 0, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, least):
            held.append(batch.slice(lo, least))
            rows, size = rows + held[-1].num_rows, size + held[-1].nbytes
            if rows >= least or size >= least_bytes:
                table = pa.Table.from_batches(held).combine_chunks()
                g1, g2 = table.column("bucket").to_numpy(), table.column("pair").to_numpy()
                whole = np.flatnonzero((g1 != g1[-1]) | (g2 != g2[-1]))
                cut = int(whole[-1]) + 1 if len(whole) else 0
                if cut:
                    yield table.slice(0, cut)
                rest = table.slice(cut)
                held = rest.to_batches()
                rows, size = (rest.num_rows, rest.nbytes) if cut else (0, 0)  # one bucket so far: look again after as much more
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _candidates(batches, percent: int):
    """A spanning forest of the candidates of each run of buckets."""
    for table in _whole_buckets(batches, BATCH_ROWS):
        part = {x: table.column(x).to_numpy() for x in ("bucket", "pair", "n", "root", "block", "node")}
        part["same"] = (part["pair"] >> 32) == (part["pair"] & 0xFFFFFFFF)
        part["bits"] = SketchTable(table.column("sketch").to_pylist())
        i, j = _compare(part, percent)
        if len(i):
            keep = forest(part["root"][i], part["root"][j])
            yield pa.RecordBatch.from_arrays([pa.array(part["root"][i][keep]), pa.array(part["root"][j][keep])], names=["a", "b"])


def links_of(found: np.ndarray, sizes: np.ndarray, copies: np.ndarray, first: int, percent: int, count: bool = True) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(each set's links, weighted by the other's copies; a spanning forest of the links): set i meets every j > i with j >= first, on whole sets.

    A set is held as its difference from what more than half of the sets hold, which is short for near copies.
    Without ``count`` a set that is joined already with all that it would meet is passed over, and links are not numbers.
    """
    rows = len(sizes)
    kinds, ids = np.unique(found, return_inverse=True)
    own = np.repeat(np.arange(rows), sizes)
    core = np.bincount(ids, minlength=len(kinds)) * 2 > rows
    common = core[ids]
    lacks = np.ones((rows, int(core.sum())), bool)
    lacks[own[common], (np.cumsum(core) - 1)[ids[common]]] = False
    lack_row, lack_id = np.nonzero(lacks)
    row = np.concatenate([own[~common], lack_row])
    apart = np.concatenate([ids[~common], np.flatnonzero(core)[lack_id]])[np.argsort(row, kind="stable")]
    n = np.bincount(row, minlength=rows)
    cuts = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(len(kinds), np.uint8)
    out = np.zeros(rows, np.int64)
    tree = np.arange(rows)
    edges = []
    for i in range(rows if first == 0 else first):
        j = max(i + 1, first)
        if not count and (tree[j:] == tree[i]).all():
            continue
        mine = apart[cuts[i] : cuts[i + 1]]
        mark[mine] = 1
        hits = np.concatenate([[0], np.cumsum(mark[apart[cuts[j] :]], dtype=np.int64)])
        mark[mine] = 0
        shared = np.diff(hits[cuts[j:] - cuts[j]])
        total = sizes[i] + sizes[j:]
        both = (total - (n[i] + n[j:] - 2 * shared)) // 2
        linked = both * 100 >= (total - both) * percent
        out[i] += copies[j:][linked].sum()
        out[j:][linked] += copies[i]
        fresh = np.flatnonzero(linked & (tree[j:] != tree[i]))
        if len(fresh):
            others, at = np.unique(tree[j:][fresh], return_index=True)
            edges += [(i, j + int(x)) for x in fresh[at]]
            tree[np.isin(tree, others)] = tree[i]
    return out, edges


def _decide(batches, percent: int, count: bool):
    """(a, b, null) for a spanning forest of the links of each pair of blocks, and (node, null, its links in it) if they are counted."""
    for table in _whole_buckets(batches, LINK_BLOCK):
        bucket, pair, block, node, copies = (table.column(x).to_numpy() for x in ("bucket", "pair", "block", "node", "copies"))
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        found = lists.flatten().to_numpy()
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        fresh = np.flatnonzero((bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])) + 1
        links, ends = np.zeros(len(node), np.int64), []
        for lo, hi in zip([0, *fresh.tolist()], [*fresh.tolist(), len(node)], strict=True):
            # In a pair of different blocks, which arrive one after the other, pairs within a block are another task's.
            first = 0 if pair[lo] >> 32 == pair[lo] & 0xFFFFFFFF else int((block[lo:hi] == block[lo]).sum())
            links[lo:hi], edges = links_of(found[cuts[lo] : cuts[hi]], sizes[lo:hi], copies[lo:hi], first, percent, count)
            ends += [(lo + i, lo + j) for i, j in edges]
        if ends:
            at = np.array(ends)
            yield pa.RecordBatch.from_arrays([pa.array(node[at[:, 0]]), pa.array(node[at[:, 1]]), pa.nulls(len(at), pa.int64())], names=["a", "b", "links"])
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(links)], names=["a", "b", "links"])
    trim()


def _pair(x, y):
    return F.shiftleft(F.least(x, y).cast("long"), 32) + F.greatest(x, y)


def _verified(roots: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, twins: np.ndarray, count: bool) -> DataFrame:
    """(a, b, links) as ``_decide`` gives them, for candidate components ``roots(node, root)``."""
    known = nodes.select("node", "doc", "n", "copies")
    rows = roots.join(known, "node")
    blocks = F.greatest(F.ceil(F.col("c") / LINK_BLOCK), F.ceil(F.col("s") / LINK_SHINGLES)).cast("int")
    sizes = rows.groupBy("root").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("root", blocks.alias("blocks"))
    rows = materialize(rows.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "members")

    few = rows.select(F.col("doc").alias("wanted_id")).distinct()
    few = F.broadcast(few) if rows.count() <= 1_000_000 else few  # at most 8 MB to broadcast; beyond, a shuffled join
    # Nodes are computed anew: rows that share an id, or have none, may differ in text.
    found = docs.join(few, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    sets = found.mapInArrow(partial(_shingles, k=k, twins=twins), "node long, shingles array<long>").dropDuplicates(["node"])

    def decided(dealt: DataFrame) -> DataFrame:
        dealt = dealt.join(sets, "node").repartition("bucket", "pair").sortWithinPartitions("bucket", "pair", "block")
        return materialize(dealt.mapInArrow(partial(_decide, percent=percent, count=count), "a long, b long, links long"), "decided", WIDE_ROWS)

    here = (F.col("root").alias("bucket"), "node", F.col("block").cast("long").alias("block"), "copies")
    if count:
        dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(_pair("block", "other").alias("pair"), *here)
        return decided(dealt)
    out = decided(rows.where("blocks = 1").select(F.lit(0).cast("long").alias("pair"), *here))
    big = rows.where("blocks > 1")
    if big.isEmpty():
        return out
    # Every row of a large component meets its least node; then only what that did not link meets all the rest.
    led = big.where("node = root").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).withColumn("block", F.lit(-1))
    star = led.unionByName(big.where("node <> root").withColumn("other", F.col("block")))
    star = decided(star.select((F.lit(1 << 62) + F.col("other")).alias("pair"), *here))
    near = star.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("main", F.lit(1))
    big = big.drop("block", "blocks").join(near, "node", "left").withColumn("main", F.coalesce("main", F.lit(0)))
    sums = [F.greatest(F.ceil(F.sum(F.when(F.col("main") == m, 1)) / LINK_BLOCK), F.ceil(F.sum(F.when(F.col("main") == m, F.col("n"))) / LINK_SHINGLES)).cast("int") for m in (0, 1)]
    shape = big.groupBy("root").agg(F.coalesce(sums[0], F.lit(0)).alias("rest"), F.coalesce(sums[1], F.lit(0)).alias("mains")).where("rest > 0")
    dealt = big.join(shape, "root").withColumn("block", F.when(F.col("main") == 0, F.pmod(F.xxhash64("node"), "rest")).otherwise(F.col("rest") + F.pmod(F.xxhash64("node"), "mains")).cast("int"))
    meets = F.when(F.col("main") == 0, F.col("rest") + F.col("mains")).otherwise(F.col("rest")) - 1
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), meets)).alias("other")).select(_pair("block", "other").alias("pair"), *here)
    return out.unionByName(star).unionByName(decided(dealt))


def _shingles(batches, k: int, twins: np.ndarray):
    for batch in batches:
        for first, end, found, sizes in _sets(batch, k):
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            nodes = pa.array(tk.as_signed(nodes_of(found, sizes, twins)))
            step = 500
            for i in range(0, end - first, step):
                j = min(i + step, end - first)
                lists = pa.ListArray.from_arrays(pa.array((offsets[i : j + 1] - offsets[i]).astype(np.int32)), pa.array(tk.as_signed(found[offsets[i] : offsets[j]])))
                yield pa.RecordBatch.from_arrays([nodes[i:j], lists], names=["node", "shingles"])
    trim()


def _described(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(each row's node, the distinct nodes, the digests that two sets share)."""
    twins = np.zeros(0, np.uint64)
    while True:
        rows = materialize(docs.mapInArrow(partial(_describe, k=k, twins=twins), "doc_id long, n_shingles long, node long, check long, sketch binary"), "sets", 5 * WIDE_ROWS)
        nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"), (F.min("check") != F.max("check")).alias("mixed"))
        nodes = materialize(nodes, "nodes")
        mixed = nodes.where("mixed").select("node").limit(MOST_TWINS + 1).collect()
        if not mixed:
            return rows, nodes, twins
        if len(mixed) + len(twins) > MOST_TWINS:
            raise ValueError("too many different texts share a 64-bit digest")
        twins = np.union1d(twins, np.array([r.node for r in mixed], np.int64).view(np.uint64))
        discard(rows)
        discard(nodes)


def _frequent(docs: DataFrame, rows: int, k: int, percent: int, twins: np.ndarray) -> np.ndarray:
    """Keys of HOT_SHARE or more of a sample of texts, at most HOT_KEYS; a small table needs none."""
    none = np.zeros(0, np.uint64)
    if rows <= HOT_SAMPLE:
        return none
    drawn = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * HOT_SAMPLE / rows)
    keys = docs.where(drawn).select("text").mapInArrow(partial(_keys, k=k, percent=percent, twins=twins, hot=none, salts=1), "key long, salt int, node long")
    often = keys.distinct().groupBy("key").count().where(F.col("count") >= int(HOT_SHARE * HOT_SAMPLE)).orderBy(F.desc("count"), "key").limit(HOT_KEYS).collect()
    return np.sort(np.array([r.key for r in often], np.int64).view(np.uint64))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): texts linked when Jaccard of their distinct k-word shingles >= percent/100, and what links reach.

    With ``count_links`` there is also n_links, the number of other rows that the row is
    itself linked to, exact copies among them; every pair of a group is decided for it.

    Words are runs of bytes other than space and TAB..CR, with A-Z lower-cased.
    Null and empty texts, and texts without words, have no shingles and no links; a
    text of fewer than k words has one shingle. component_id is the smallest doc_id
    reachable. A repeated row is a copy of itself; a null doc_id keeps its row,
    never leads a group that has another id, and is null where alone. An empty table gives
    an empty one. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described, nodes, twins = _described(docs, k)
    hot = _frequent(docs, described.count(), k, percent, twins)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    keys = docs.select("text").mapInArrow(partial(_keys, k=k, percent=percent, twins=twins, hot=hot, salts=salts), "key long, salt int, node long")
    met = keys.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").mapInArrow(_buckets, "bucket long, node long")
    buckets = materialize(met.distinct(), "buckets", NARROW_ROWS)
    release(spark)

    sketched = nodes.select("node", "n", "sketch")
    leads = buckets.groupBy("bucket").agg(F.min("node").alias("a"))
    pairs = buckets.withColumnRenamed("node", "b").join(leads, "bucket").where("a <> b").select("a", "b").distinct()
    a, b = (sketched.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    pairs = materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(partial(_close, percent=percent), "a long, b long"), "pairs")
    roots = materialize(connected_components(pairs), "roots")
    discard(pairs)

    rows = buckets.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    mixed = rows.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("c")).where("r0 < r1").select("bucket", blocks.alias("blocks"))
    rows = rows.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("bucket", _pair("block", "other").alias("pair"), "node", "root", F.col("block").cast("long").alias("block"))
    rows = rows.join(sketched, "node").repartition("bucket", "pair").sortWithinPartitions("bucket", "pair")
    more = materialize(rows.mapInArrow(partial(_candidates, percent=percent), "a long, b long").distinct(), "more")
    if not more.isEmpty():
        wider = materialize(connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
        discard(roots)
        roots = wider
    discard(more)
    discard(buckets)
    release(spark)

    decided = materialize(_verified(roots, nodes, docs, k, percent, twins, count_links), "links")
    discard(roots)
    roots = materialize(connected_components(decided.where("links is null").select("a", "b")), "roots")
    led = roots.join(nodes.select("node", "doc"), "node")
    lead = led.groupBy("root").agg(F.min("doc").alias("component"))
    lone = nodes.select("node", "doc").join(roots, "node", "left_anti").select("node", F.col("doc").alias("component"))
    leads = led.select("node", "root").join(lead, "root").select("node", "component").unionByName(lone)
    if count_links:
        counted = decided.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        leads = leads.join(nodes.select("node", "copies"), "node").join(counted, "node", "left")
        leads = leads.select("node", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    leads = materialize(leads, "leads")
    for x in (nodes, decided, roots):
        discard(x)
    release(spark)
    out = described.select("doc_id", "n_shingles", "node").join(leads.withColumnRenamed("node", "led_node"), (F.col("node") == F.col("led_node")) & (F.col("n_shingles") > 0), "left")
    columns = ["doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")]
    return out.select(*columns, *([F.coalesce("links", F.lit(0)).alias("n_links")] if count_links else []))
