"""SimHash near-duplicates: exact comparison of fingerprints in tiles.

Fingerprints are made per document in Arrow batches. Documents with the same fingerprint are
one class; classes are dealt into tiles by the population counts of their halves, and only
tiles whose counts differ by no more than the radius are made at all. Within a tile rows are
sorted by population count, so that stripes beyond the radius are skipped as well; the rest
is compared with exclusive-or and bit counts. A tile returns a forest, never its pairs.

The pipeline only takes pairs of close fingerprints as candidates: sets of shingles are compared
exactly where their fingerprints are close and nothing has joined them yet, and only what is
similar indeed is ever linked. Candidates are not closed into groups beyond a tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import map_batches, utf8
from tracemill.llm.links import components, roots, tiled
from tracemill.session import cut_lineage

SEED = 42
STRIPE = 128
#: From so many shingles on, the chance that a bit differs hardly depends on their number.
SETTLED = 128
#: Shingles of a block of documents that are compared exactly, with a charge for each document.
BLOCK, CHARGE = 1 << 20, 256


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of `words` words, A-Z lower-cased, words split at ASCII white space."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    take = min(words, len(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - take + 1].tolist()
    digest = xxhash.xxh64_intdigest
    found = [digest(joined[s:e], seed) for s, e in zip(starts, ends[take - 1 :].tolist(), strict=True)]
    return np.array(found, np.uint64)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits from a hash (the finaliser of splitmix64); word 0 is the hash itself."""
    if word == 0:
        return h
    z = h + np.uint64((0x9E3779B97F4A7C15 * word) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes."""
    if not len(h):
        return 0
    bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    twice = bits.sum(axis=0, dtype=np.int64) * 2
    return int.from_bytes(np.packbits(twice > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, n_words: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shingles, w0, w1, ...): `n_words` times 64 bits as longs, one row per row of `docs`.

    Fewer words than a shingle make one shingle of all; no words (or a null) make zero bits.
    """

    def make(batch: pa.RecordBatch) -> dict:
        sizes, out = [], [[] for _ in range(n_words)]
        for raw in utf8(batch.column(1)):
            h = shingle_hashes(raw, words)
            sizes.append(len(h))
            for i, column in enumerate(out):
                column.append(majority(_mixed(h, i)))
        found = {key: batch.column(0), "shingles": pa.array(sizes, pa.int64())}
        return found | {f"w{i}": pa.array(c, pa.int64()) for i, c in enumerate(out)}

    kind = docs.schema[key].dataType.simpleString()
    columns = "".join(f", w{i} long" for i in range(n_words))
    return map_batches(docs.select(key, text), make, f"`{key}` {kind}, shingles long{columns}")


def _node(shingles: np.ndarray) -> int:
    """The 64-bit hash of a set of shingle hashes (sorted)."""
    digest = xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED)
    return digest - (1 << 64) if digest >> 63 else digest


def sketches(docs: DataFrame, words: int, n_words: int, key: str, text: str) -> DataFrame:
    """(key, node, shingles, w0, w1, ...) of the sets of shingles, one row per row of `docs`.

    Other bits of the least hash settle ties: its own ones depend on the count.
    """

    def make(batch: pa.RecordBatch) -> dict:
        nodes, sizes, out = [], [], [[] for _ in range(n_words)]
        for raw in utf8(batch.column(1)):
            h = np.unique(shingle_hashes(raw, words))
            nodes.append(_node(h))
            sizes.append(len(h))
            tie = h[: (len(h) + 1) % 2]
            for i, column in enumerate(out):
                column.append(majority(np.concatenate([_mixed(h, i), _mixed(tie, n_words + i)])))
        found = {key: batch.column(0), "node": pa.array(nodes, pa.int64()), "shingles": pa.array(sizes, pa.int64())}
        return found | {f"w{i}": pa.array(c, pa.int64()) for i, c in enumerate(out)}

    kind = docs.schema[key].dataType.simpleString()
    columns = "".join(f", w{i} long" for i in range(n_words))
    return map_batches(docs.select(key, text), make, f"`{key}` {kind}, node long, shingles long{columns}")


def _forest(rows: np.ndarray, one: np.ndarray, two: np.ndarray, radius: int) -> np.ndarray:
    """The smallest row joined to each of `rows` by links between `one` and `two` (indices).

    Links are pairs that differ in `radius` bits or fewer; those of one stripe are folded
    into the forest before the next stripe is looked at. If `one` and `two` are the same, every
    pair is looked at once.
    """
    count = np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
    same = np.array_equal(one, two)
    one, two = (x[np.argsort(count[x], kind="stable")] for x in (one, two))
    pl, pr, sr = count[one], count[two], rows[two]
    parent = np.arange(len(rows))
    for at in range(0, len(one), STRIPE):
        stripe = rows[one[at : at + STRIPE]]
        last = min(at + STRIPE, len(one)) - 1
        lo, hi = np.searchsorted(pr, pl[at] - radius), np.searchsorted(pr, pl[last] + radius, "right")
        if same:
            lo = max(lo, at)
        if lo >= hi:
            continue
        differ = np.bitwise_count(stripe[:, 0, None] ^ sr[None, lo:hi, 0])
        for w in range(1, stripe.shape[1]):
            differ = differ + np.bitwise_count(stripe[:, w, None] ^ sr[None, lo:hi, w]).astype(np.uint16)
        i, j = np.nonzero(differ <= radius)
        if same:
            later = lo + j > at + i
            i, j = i[later], j[later]
        parent = roots(len(rows), one[at + i], two[lo + j], parent)
    return parent


def links(classes: DataFrame, n_words: int, radius: int, cell: str, reach: Sequence[int], block: int = 4096) -> DataFrame:
    """Links (a, b) between nodes that join the same classes as all pairs within the radius."""
    names = [f"w{i}" for i in range(n_words)]

    def forest(tile: pa.Table) -> pa.Table:
        nodes = tile["node"].to_numpy()
        rows = np.stack([tile[n].to_numpy() for n in names], axis=1).view(np.uint64)
        side = tile["side"].to_numpy()
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        root = _forest(rows, one, two, radius)
        joined = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": nodes[joined], "b": nodes[root[joined]]})

    dealt = tiled(classes.select("node", *names, cell), cell, reach, block, ["node"])
    return dealt.groupBy("tile").applyInArrow(forest, "a long, b long")


def by_population(radius: int) -> tuple[F.Column, list[int]]:
    """The cell of a 64-bit fingerprint (population counts of its halves), and what must meet."""
    if radius > 20:
        raise ValueError("cells by population count are for a radius of 20 bits at most")
    low = F.bit_count(F.col("w0").bitwiseAND(F.lit(0xFFFFFFFF)))
    cell = F.bit_count(F.shiftrightunsigned(F.col("w0"), 32)) * 128 + low
    near = [a * 128 + b for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if abs(a) + abs(b) <= radius]
    return cell.cast("long"), near


def by_size(similarity: float) -> tuple[F.Column, list[int]]:
    """Cells of documents whose numbers of shingles allow a Jaccard similarity as high."""
    step = F.floor(F.log(F.greatest(F.col("shingles"), F.lit(1))) / F.lit(-np.log(similarity)))
    return step.cast("long"), [-1, 0, 1]


def groups(prints: DataFrame, n_words: int, radius: int, key: str = "doc_id") -> DataFrame:
    """`prints` with component_id, the smallest key reachable by links of `radius` bits or fewer.

    Equal fingerprints are always linked. Null keys never become a component's id.
    """
    names = [f"w{i}" for i in range(n_words)]
    cell, reach = by_population(radius)
    node = F.xxhash64(*names) if n_words > 1 else F.col("w0")
    held = cut_lineage(prints.withColumns({"node": node}))
    classes = cut_lineage(held.groupBy("node", *names).agg(F.min(key).alias("_first")).withColumn("_cell", cell))
    return _named(held, classes, links(classes, n_words, radius, "_cell", reach), key)


def _named(held: DataFrame, classes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """`held` with component_id: the smallest `_first` of the classes that `found` joins."""
    rooted = classes.join(components(found), "node", "left").select("node", "_first", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = cut_lineage(rooted.join(smallest, "root").select("node", "component_id"))
    return held.join(named, "node").drop("node")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id): one row per row of `docs`; other columns are not used."""
    prints = fingerprints(docs, words, key=key, text=text)
    digits = F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint")
    return groups(prints, 1, radius, key=key).select(key, digits, "component_id")


def _coins(n: int) -> np.ndarray:
    """The chances of 0 to n heads among n fair coins."""
    return np.array([math.comb(n, k) / 2**n for k in range(n + 1)])


def _differ(common: int, one: int, two: int) -> float:
    """The chance that a majority bit differs between sets of so many common and own hashes."""
    ones = np.arange(common + 1)

    def set_bit(own: int) -> np.ndarray:
        twice = 2 * (ones[:, None] + np.arange(own + 1)) - common - own
        return ((twice > 0) + (twice == 0) / 2) @ _coins(own)

    a, b = set_bit(one), set_bit(two)
    return float(_coins(common) @ (a * (1 - b) + b * (1 - a)))


@lru_cache(maxsize=8)
def radii(similarity: float, bits: int) -> np.ndarray:
    """By the size of the smaller set, up to SETTLED: bits that sets as similar may differ in.

    That is what is expected of the worst sets that reach the similarity, and five standard
    deviations more. Never grows with the size.
    """
    share = np.zeros(SETTLED + 1)
    for size in range(1, SETTLED + 1):
        for one in range(size):
            most = int((size - one) / similarity + 1e-9) - size
            if most < one:
                break
            share[size] = max(share[size], *(_differ(size - one, one, two) for two in {most, max(one, most - 1)}))
    share = np.maximum.accumulate(share[::-1])[::-1]
    return np.floor(bits * share + 5 * np.sqrt(bits * share * (1 - share))).astype(np.int64)


def close_pairs(
    rows: np.ndarray, sizes: np.ndarray, one: np.ndarray, two: np.ndarray, similarity: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs between `one` and `two` (indices) whose sizes and fingerprints allow the similarity.

    Stripe by stripe; if `one` and `two` are the same, every pair comes once. The first 64 bits
    choose the pairs whose other bits are looked at.
    """
    whole, first = radii(similarity, 64 * rows.shape[1]), radii(similarity, 64)
    same = np.array_equal(one, two)
    one, two = (x[np.argsort(sizes[x], kind="stable")] for x in (one, two))
    sr, sz = np.ascontiguousarray(rows[two, 0]), sizes[two]
    for at in range(0, len(one), STRIPE):
        mine = one[at : at + STRIPE]
        least, most = sizes[mine[0]], sizes[mine[-1]]
        lo, hi = np.searchsorted(sz, similarity * least - 1e-9), np.searchsorted(sz, most / similarity + 1e-9, "right")
        if same:
            lo = max(lo, at)
        if lo >= hi:
            continue
        limit = first[min(least, sz[lo], SETTLED)]
        i, j = np.nonzero(np.bitwise_count(rows[mine, 0][:, None] ^ sr[None, lo:hi]) <= limit)
        if same:
            later = lo + j > at + i
            i, j = i[later], j[later]
        a, b = mine[i], two[lo + j]
        small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        differ = np.bitwise_count(rows[a] ^ rows[b]).sum(axis=1, dtype=np.int64)
        fine = (small >= similarity * large - 1e-9) & (differ <= whole[np.minimum(small, SETTLED)])
        yield a[fine], b[fine]


def candidates(classes: DataFrame, n_words: int, similarity: float, block: int = 16_384) -> DataFrame:
    """Classes with a close one in a tile: one row per tile and class, with all of its columns.

    `group` holds what close pairs join within the tile, `half` is the side of the tile (2: both)
    and `least` is the smallest node that is close to this one there.
    """
    names = [f"w{i}" for i in range(n_words)]
    cell, reach = by_size(similarity)
    kept = ["node", "shingles", *names, "_first"]

    def near(tile: pa.Table) -> pa.Table:
        nodes, sizes, side = (tile[c].to_numpy() for c in ("node", "shingles", "side"))
        rows = np.stack([tile[n].to_numpy() for n in names], axis=1).view(np.uint64)
        parent, least = np.arange(len(nodes)), np.full(len(nodes), np.iinfo(np.int64).max)
        for a, b in close_pairs(rows, sizes, np.flatnonzero(side != 1), np.flatnonzero(side != 0), similarity):
            parent = roots(len(nodes), a, b, parent)
            np.minimum.at(least, a, nodes[b])
            np.minimum.at(least, b, nodes[a])
        met = np.flatnonzero(least < np.iinfo(np.int64).max)
        group = _mixed(tile["tile"].to_numpy()[met].view(np.uint64) + parent[met].astype(np.uint64), 1).view(np.int64)
        found = {c: tile[c].take(pa.array(met)) for c in kept}
        return pa.table(found | {"group": group, "half": pa.array(side[met], pa.int32()), "least": least[met]})

    # cells of sizes are few and full: larger tiles repeat fewer rows
    dealt = tiled(classes.select(*kept).withColumn("_cell", cell), "_cell", reach, block, ["node"])
    fields = ", ".join(f"{c} {classes.schema[c].dataType.simpleString()}" for c in kept)
    return dealt.groupBy("tile").applyInArrow(near, f"{fields}, group long, half int, least long")


def similar_sets(tile: pa.Table, similarity: float, n_words: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Links between rows of a tile that join all its similar sets, and the number of pairs compared.

    `ids` are sorted hashes as bytes. Rows of the same `label` are joined already, rows of the
    same `side` or `half` (unless 2) meet elsewhere; of the others those with fitting sizes and
    close fingerprints are compared exactly.
    """
    sets = [np.frombuffer(b.as_py(), np.int64) for b in tile["ids"]]
    order = np.argsort([len(x) for x in sets], kind="stable")
    sets = [sets[i] for i in order]
    side, half = (tile[c].to_numpy()[order] for c in ("side", "half"))
    rows = np.stack([tile[f"w{i}"].to_numpy()[order] for i in range(n_words)], axis=1).view(np.uint64)
    label = np.unique(tile["label"].to_numpy()[order], return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets], np.int64)
    whole = radii(similarity, 64 * n_words)
    known, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(sizes) - sizes
    mark, found, compared = np.zeros(len(known), bool), ([], []), 0
    for i in range(len(sets)):
        # pairs are met from their smaller set, so that a larger one need only look ahead
        last = np.searchsorted(sizes, sizes[i] / similarity + 1e-9, "right")
        j = np.arange(i + 1, last)
        j = j[(label[j] != label[i]) & ((side[j] == 2) | (side[j] != side[i])) & ((half[j] == 2) | (half[j] != half[i]))]
        j = j[np.bitwise_count(rows[j] ^ rows[i]).sum(axis=1, dtype=np.int64) <= whole[min(sizes[i], SETTLED)]]
        if not len(j):
            continue
        compared += len(j)
        mark[ids[start[i] : start[i] + sizes[i]]] = True
        ends = np.cumsum(sizes[j])
        at = np.arange(ends[-1]) + np.repeat(start[j] - ends + sizes[j], sizes[j])
        both = np.add.reduceat(mark[ids[at]], ends - sizes[j], dtype=np.int64)
        mark[ids[start[i] : start[i] + sizes[i]]] = False
        for k in j[both / (sizes[i] + sizes[j] - both) >= similarity]:
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                found[0].append(order[i])
                found[1].append(order[k])
    return np.array(found[0], np.int64), np.array(found[1], np.int64), compared


def exact_links(docs: DataFrame, members: DataFrame, words: int, similarity: float, n_words: int, key: str, text: str) -> DataFrame:
    """Links (a, b) that join the same nodes as all close pairs of a group that are similar indeed.

    `members`: (group, node, half, label, shingles, _first, w0, ...). Sets are made anew from
    the texts of one key per node, and dealt out in blocks.
    """

    def make(batch: pa.RecordBatch) -> dict:
        sets = [np.unique(shingle_hashes(raw, words)) for raw in utf8(batch.column(0))]
        return {"node": pa.array([_node(h) for h in sets], pa.int64()), "ids": pa.array([h.tobytes() for h in sets], pa.binary())}

    def verify(tile: pa.Table) -> pa.Table:
        nodes = tile["node"].to_numpy()
        a, b, _ = similar_sets(tile, similarity, n_words)
        return pa.table({"a": nodes[a], "b": nodes[b]})

    keys = members.filter(F.col("_first").isNotNull()).select(F.col("_first").alias(key)).distinct()
    texts = docs.select(key, text)
    chosen = texts.join(keys, key, "left_semi").union(texts.filter(F.col(key).isNull())).select(text)
    sets = map_batches(chosen, make, "node long, ids binary").dropDuplicates(["node"])
    dealt = tiled(members.drop("_first"), "group", [0], BLOCK, ["node"], F.col("shingles") + CHARGE)
    return dealt.join(sets, "node").groupBy("tile").applyInArrow(verify, "a long, b long")


def similar_links(docs: DataFrame, near: DataFrame, words: int, similarity: float, n_words: int, key: str, text: str) -> DataFrame:
    """Links (a, b) that join the same nodes as all close pairs that are similar indeed.

    First every node is compared around the smallest node close to it, which joins copies of one
    text in as many steps as there are copies; then only tiles whose groups hold nodes that are
    still apart are looked at again.
    """
    columns = ["shingles", "_first", *(f"w{i}" for i in range(n_words))]
    once = near.groupBy("node").agg(F.min("least").alias("group"), *(F.first(c).alias(c) for c in columns))
    once = cut_lineage(once.withColumns({"half": F.lit(2), "label": F.col("node")}))
    hubs = once.join(once.select(F.col("group").alias("node")).distinct(), "node", "left_semi").withColumn("group", F.col("node"))
    star = once.unionByName(hubs)
    joined = cut_lineage(components(exact_links(docs, star, words, similarity, n_words, key, text)))
    labelled = near.drop("least").join(joined, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    apart = labelled.groupBy("group").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low < _high")
    left = cut_lineage(labelled.join(apart.select("group"), "group", "left_semi"))
    more = exact_links(docs, left, words, similarity, n_words, key, text)
    return more.union(joined.select(F.col("node").alias("a"), F.col("root").alias("b")))


def representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8, n_words: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without all but the smallest key of every group of near-duplicates.

    Two documents are linked if the Jaccard similarity of their sets of shingles (as 64-bit
    hashes) is `similarity` or more; fingerprints only say which ones are compared. Rows with
    the same key are one document and share its fate; rows with a null key stay.
    """
    names = [f"w{i}" for i in range(n_words)]
    prints = cut_lineage(sketches(docs, words, n_words, key, text))
    classes = cut_lineage(prints.groupBy("node", "shingles", *names).agg(F.min(key).alias("_first")))
    near = cut_lineage(candidates(classes, n_words, similarity))
    linked = similar_links(docs, near, words, similarity, n_words, key, text)
    grouped = _named(prints.select(key, "node"), classes, linked, key)
    gone = grouped.filter(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(gone, key, "left_anti")
