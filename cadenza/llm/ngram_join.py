"""N-gram Jaccard self-join with count-vector R-trees, exact at any size.

A document's set is its distinct 5-word shingles (64-bit hashes). Each shingle
belongs to one of the set's groups (as many as shingles, in powers of two; finer
counts fold to coarser ones by sums); a document is the point of its group counts. The
overlap of two sets is at most the sum of the coordinate minima of their points,
and for two tree nodes at most that sum over their boxes' upper corners, so an
R-tree over points drops pairs and whole subtrees that cannot reach the threshold.
Trees hold coarse counts; pairs that pass meet the bound of the fine counts before
they leave the task.

One tree over all documents would grow quadratic work (in many dimensions the
boxes of a large corpus overlap), so trees are built in cells: two sets with
Jaccard >= 0.8 must share one of their first n - ceil(0.8 n) + 1 shingles in any
common order. The order puts common shingles last; which ones are common is
estimated in one pass and changes the work, never the result. A cell is all sets
that have a shingle among their first, cut into bands of sizes that can be similar.
Cells beyond BLOCK sets are dealt to tasks as pairs of blocks.

Steps: equal sets collapse to one node, cells with the same members to one cell;
every node is verified against the leader it shares most cells with (leaders are
the nodes that share most, such as the text that copies were made from), which joins
the large groups of near copies; nodes that are then in one component need no
more pairs, all other pairs of a cell go through its R-tree; what survives is
verified on the whole sets. No link between different sets is missed, and no
group's pairs are listed.

Defined results: null and empty texts have no shingles and are linked with
nothing; fewer than 5 words make one shingle; equal sets are linked; repeated
rows are each returned; a null id is ignored as a component's smallest id; an
empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_broadcast, components, stage
from cadenza.llm.url_filter import Level
from cadenza.llm.wordhash import mix, shingle_hashes, text_batches

WORDS = 5
NUM, DEN = 4, 5                    # similarity 0.8
LEAST_GROUPS = 64                     # groups: a power of two, at least one for each shingle
COARSE = 4                            # in cells, groups of the counts are added up by so many
BAND = 1.2501                         # sizes of similar sets differ by less
BUCKET_BITS = 20
COMMON_BUCKETS = 1 << 16           # buckets that count as common, at most; affects only the order
BLOCK = 1024
LEAF, FANOUT = 32, 8
MAX_BROADCAST_IDS = 500_000
MAX_BLOOM_CELLS = 30_000_000        # a Bloom filter of 45 MB


def needed_overlap(a, b):
    """Smallest intersection with which sets of sizes a and b are similar enough."""
    return -(-(a + b) * NUM // (NUM + DEN))


def prefix_length(n: int) -> int:
    return n - -(-n * NUM // DEN) + 1


def group_counts(s: np.ndarray) -> bytes:
    """Counts by group in four bits each where all fit, else in 32; the groups are low bits of the hash."""
    n = LEAST_GROUPS
    while n < len(s):
        n *= 2
    return packed(np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n))


def packed(counts: np.ndarray) -> bytes:
    """A kind byte and the counts: half bytes where all fit, coded by their frequencies if that is shorter, else 32 bits."""
    if counts.max() >= 16:
        return b"\x20" + zlib.compress(counts.astype("<u4").tobytes(), 1)
    halves = (counts[0::2] | counts[1::2] << 4).astype("u1").tobytes()
    coder = zlib.compressobj(6, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    coded = coder.compress(halves) + coder.flush()
    return b"\4" + coded if len(coded) < len(halves) else b"\1" + halves


def unpacked(counts: bytes) -> np.ndarray:
    kind, rest = counts[0], counts[1:]
    if kind == 0x20:
        return np.frombuffer(zlib.decompress(rest), dtype="<u4").astype(np.int32)
    two = np.frombuffer(zlib.decompress(rest, -15) if kind == 4 else rest, dtype="u1")
    return np.stack([two & 15, two >> 4], axis=1).ravel()          # a byte each, since cells hold many


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points in as many groups as the coarsest has."""
    n = min(map(len, points))
    return np.stack([p if len(p) == n else p.reshape(-1, n).sum(axis=0, dtype=np.int32) for p in points]).astype(np.int32)


def added_up(counts: np.ndarray) -> np.ndarray:
    """Counts of fewer groups: the bound is weaker, holds all the same, and takes less to compute."""
    n = max(LEAST_GROUPS, len(counts) // COARSE)
    return counts.reshape(-1, n).sum(axis=0, dtype=np.int32)


def fine_bound(fine: list[np.ndarray], sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs (a[i], b[i]) of points reach their needed overlap in all the groups that both have."""
    groups = np.array([len(f) for f in fine])
    common, keep = np.minimum(groups[a], groups[b]), np.zeros(len(a), dtype=bool)
    for n in np.unique(common):
        for at in np.array_split(np.flatnonzero(common == n), max(1, int((common == n).sum()) * int(n) >> 22)):
            rows, inverse = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
            points = np.stack([fine[r].reshape(-1, n).sum(axis=0, dtype=np.int32) for r in rows])
            bound = np.minimum(points[inverse[:len(at)]], points[inverse[len(at):]]).sum(axis=1)
            keep[at] = bound >= needed_overlap(sizes[a[at]], sizes[b[at]])
    return keep


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Weight per bucket: 0, or the count of a bucket that stands out in some task (at most COMMON_BUCKETS)."""
    n = 1 << BUCKET_BITS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n, dtype=np.int64)
        for b in batches:
            for part in text_batches(b.column(0).to_pylist()):
                members = np.concatenate(list(shingle_hashes(part, WORDS)))
                counts += np.bincount((members >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=n)
        mean = counts.mean()
        out = np.flatnonzero(counts > mean + 4 * np.sqrt(mean) + 8)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(counts[out], pa.int64())], ["bucket", "n"])

    top = (texts.select("text").mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "bucket").limit(COMMON_BUCKETS).collect())
    weights = np.zeros(n, dtype=np.int64)
    for r in top:
        weights[r["bucket"]] = r["n"]
    return weights


def signatures(texts: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, node, counts, prefix) for (doc_id, th, text); node is the set's 64-bit hash."""
    weights = common_shingles(texts)
    common = np.flatnonzero(weights).astype(np.int64)
    weight_of = weights[common]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
        order[common] = weight_of
        for b in batches:
            done = 0
            for part in text_batches(b.column(2).to_pylist()):
                sizes, keys, points, firsts = [], [], [], []
                for s in shingle_hashes(part, WORDS):
                    sizes.append(len(s))
                    keys.append(int(mix(np.array([mix(s ^ np.uint64(len(s))).sum(dtype=np.uint64)]))[0].view(np.int64)))
                    points.append(group_counts(s))
                    if len(s):
                        p = prefix_length(len(s))
                        rank = order[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
                        firsts.append(s[np.lexsort((s, rank))[:p]].view(np.int64))
                    else:
                        firsts.append(s.view(np.int64))
                ends = np.cumsum([0] + [len(f) for f in firsts]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                  pa.array(np.concatenate(firsts) if firsts else [], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(done, len(part)), b.column(1).slice(done, len(part)), pa.array(sizes, pa.int64()),
                     pa.array(keys, pa.int64()), pa.array(points, pa.binary()), prefix],
                    ["doc_id", "th", "n_shingles", "node", "counts", "prefix"])
                done += len(part)

    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "th", "text").mapInArrow(
        signed, f"doc_id {id_type}, th long, n_shingles long, node long, counts binary, prefix array<long>")


def within_bound(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose summed coordinate minima reach the needed overlap."""
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for m, n, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                need = needed_overlap(m, n)
                keep.append(need <= min(m, n) and int(np.minimum(*folded([unpacked(x), unpacked(y)])).sum()) >= need)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sizes = points.select("node", "n_shingles")
    small, large = F.least("m", "n"), F.greatest("m", "n")
    pairs = (pairs.join(sizes.toDF("a", "m"), "a").join(sizes.toDF("b", "n"), "b").where(small * DEN >= large * NUM))
    left, right = (points.select(F.col("node").alias(k), F.col("counts").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(bounded, "a long, b long")


def verified(pairs: DataFrame, places: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough; ``places`` has a row (doc_id, th) of each node."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    where = stage(places.join(nodes, "node").select("node", F.col("doc_id").alias("p_id"), F.col("th").alias("p_th")))
    known = (texts.join(bounded_broadcast(where, MAX_BROADCAST_IDS),
                        F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("th") == F.col("p_th")))
             .select("node", "text").dropDuplicates(["node"]))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                b, keep = batch.slice(at, 64), []
                sets = [[s for part in text_batches(b.column(c).to_pylist()) for s in shingle_hashes(part, WORDS)] for c in (2, 3)]
                for x, y in zip(*sets):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and both * DEN >= NUM * (len(x) + len(y) - both))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b").select("a", "b", "x", "y")
            .mapInArrow(similar, "a long, b long"))


class Tree:
    """A packed R-tree over count vectors, each node with its box's upper corner and smallest set size."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, groups: np.ndarray):
        order = np.lexsort((*points[:, :2].T, sizes, groups))      # components, then sizes, lie together
        self.points, self.sizes, self.groups, self.rows = points[order], sizes[order], groups[order], order
        self.levels = [self._level(np.arange(0, len(order), LEAF), LEAF, len(order), self.points, self.sizes, self.groups, self.groups)]
        while len(self.levels[-1][0]) > 1:
            low = self.levels[-1]
            self.levels.append(self._level(np.arange(0, len(low[0]), FANOUT), FANOUT, len(low[0]), *low[1:]))

    @staticmethod
    def _level(starts, width, n, upper, least, first, last):
        most = np.maximum.reduceat(upper, starts, axis=0)
        return (starts, most, np.minimum.reduceat(least, starts), np.minimum.reduceat(first, starts), np.maximum.reduceat(last, starts))

    def children(self, level: int, node: int) -> range:
        n = len(self.rows) if level == 0 else len(self.levels[level - 1][0])
        width = LEAF if level == 0 else FANOUT
        return range(node * width, min(n, (node + 1) * width))


def tree_join(a: Tree, b: Tree, same: bool) -> list[tuple[int, int]]:
    """Row pairs of different groups whose bound reaches the needed overlap; with ``same`` each pair once."""
    out = []
    todo = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while todo:
        la, na, lb, nb = todo.pop()
        xa, xb = a.levels[la], b.levels[lb]
        if same and (la, na) > (lb, nb) and la == lb:
            continue
        if xa[3][na] == xa[4][na] == xb[3][nb] == xb[4][nb]:       # one component on both sides
            continue
        if np.minimum(xa[1][na], xb[1][nb]).sum() < needed_overlap(xa[2][na], xb[2][nb]):
            continue
        if la == 0 and lb == 0:
            ra, rb = a.children(0, na), b.children(0, nb)
            pa_, pb_ = a.points[ra.start:ra.stop], b.points[rb.start:rb.stop]
            bound = np.minimum(pa_[:, None, :], pb_[None, :, :]).sum(axis=2)
            fits = bound >= needed_overlap(a.sizes[ra.start:ra.stop, None], b.sizes[None, rb.start:rb.stop])
            fits &= a.groups[ra.start:ra.stop, None] != b.groups[None, rb.start:rb.stop]
            for i, j in zip(*np.nonzero(fits)):
                i, j = ra.start + i, rb.start + j
                if not same or i < j:
                    out.append((a.rows[i], b.rows[j]))
        elif la >= lb:
            todo += [(la - 1, c, lb, nb) for c in a.children(la, na)] if not (same and la == lb) else \
                [(la - 1, c, lb - 1, d) for c in a.children(la, na) for d in b.children(lb, nb)]
        else:
            todo += [(la, na, lb - 1, d) for d in b.children(lb, nb)]
    return out


def cell_pairs(cells: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the cells' rows (cell, part, side, node, component, n_shingles, counts).

    Rows arrive sorted by (cell, part); side 0 joins itself, sides 1 and 2 join each other. The trees bound with
    counts of few groups; what passes must pass the bound of all groups before it leaves the task.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key = None

        def flush() -> pa.RecordBatch | None:
            side = np.array([r[0] for r in held])
            ids = [r[1] for r in held]
            groups = np.unique(np.array([r[2] for r in held]), return_inverse=True)[1]
            sizes = np.array([r[3] for r in held], dtype=np.int64)
            fine = [unpacked(r[4]) for r in held]
            points = folded([added_up(f) for f in fine])
            if side.max() == 0:
                tree = Tree(points, sizes, groups)
                found = tree_join(tree, tree, True)
            else:
                one, two = (np.flatnonzero(side == s) for s in (1, 2))
                if not len(one) or not len(two):
                    return None
                found = [(one[i], two[j]) for i, j in tree_join(
                    *(Tree(points[w], sizes[w], groups[w]) for w in (one, two)), False)]
            if not found:
                return None
            i, j = (np.array(x) for x in zip(*found))
            fits = fine_bound(fine, sizes, i, j)
            pairs = [(ids[x], ids[y]) for x, y in zip(i[fits], j[fits])]
            if not pairs:
                return None
            a, b = zip(*((min(p), max(p)) for p in pairs))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for cell, part, side, *row in zip(*columns):
                if (cell, part) != key:
                    if held and (out := flush()) is not None:
                        yield out
                    held, key = [], (cell, part)
                held.append((side, *row))
        if held and (out := flush()) is not None:
            yield out

    return (cells.repartition("cell", "part").sortWithinPartitions("cell", "part")
            .select("cell", "part", "side", "node", "component", "n_shingles", "counts")
            .mapInArrow(joined, "a long, b long").distinct())


def shared_cells(signed: DataFrame) -> DataFrame:
    """(cell, node, n, weight): cells with several nodes; of cells with the same members one, weight times."""
    cells = signed.where("n_shingles > 0").select("node", F.explode("prefix").alias("cell"))
    several = stage(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cell").alias("key")))
    n = several.count()
    if 0 < n <= MAX_BLOOM_CELLS:      # most cells have one node; their rows go before the join's shuffle
        bloom = Level(several, 0, n)
        cells = cells.where(bloom.holds(F.col("cell"), bloom.array(signed.sparkSession)))
    shared = stage(cells.join(several, F.col("cell") == F.col("key")).select("cell", "node").distinct())
    alike = ["n", "first", "last", "x", "y"]
    members = shared.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("y")).where("n > 1")
    one = members.groupBy(*alike).agg(F.min("cell").alias("cell"), F.count("*").alias("weight")).select("cell", "n", "weight")
    return stage(shared.join(bounded_broadcast(stage(one), MAX_BROADCAST_IDS), "cell"))


def blocked(cells: DataFrame) -> DataFrame:
    """``cells`` (cell, node, component, n_shingles) by band of sizes, dealt out as pairs of blocks: part and side.

    A set is in its own band and the next, so similar sets meet. Bands of a cell with one component go.
    """
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(BAND))).cast("int")
    cells = cells.select("cell", "node", "component", F.explode(F.array(band, band + 1)).alias("band"))
    alike = ["band", "n", "x", "y", "p", "q"]
    bands = (cells.groupBy("cell", "band").agg(
        F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("p"), F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("q")).where("x < y")
        .groupBy(*alike).agg(F.min("cell").alias("cell")).select("cell", "band", "n"))          # of bands with the same members one
    cells = cells.join(bands, ["cell", "band"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    cells = cells.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = cells.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    return cells.select("cell", "node", "component", F.xxhash64("band", low, high).alias("part"), side.alias("side"))


def _pairs(stars: DataFrame) -> DataFrame:
    return stars.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))


def linked_nodes(signed: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, component) of all nodes that are linked to another."""
    shared = shared_cells(signed)
    places = signed.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("p")).select("node", "p.*")
    points = stage(signed.select("node", "n_shingles", "counts")
                   .join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    # leaders: nodes that share most with others, such as the text that many copies were made from
    degrees = shared.groupBy("node").agg(F.sum(F.col("weight") * (F.col("n") - 1)).alias("degree"))
    leaders = shared.join(degrees, "node").groupBy("cell").agg(F.max(F.struct("degree", "node"))["node"].alias("leader"))
    shared = stage(shared.join(leaders, "cell"))
    stars = shared.where("node <> leader").groupBy("node", "leader").agg(F.sum("weight").alias("votes"))
    best = stars.groupBy("node").agg(F.max_by("leader", "votes").alias("leader"))
    links = stage(verified(stage(within_bound(_pairs(best), points)), places, texts))
    first = components(links)
    placed = shared.join(first, "node", "left").select("cell", "node", F.coalesce("component", "node").alias("component"))
    placed = stage(placed.join(points.select("node", "n_shingles"), "node"))
    candidates = stage(cell_pairs(blocked(placed).join(points.select("node", "n_shingles", "counts"), "node")))
    return components(stage(links.unionByName(verified(candidates, places, texts))))


def linked_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, component, component_id) for every row of ``docs``; th is the text's hash, component
    the linked sets' own number (null without shingles), which tells apart texts that share an id."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    signed = stage(signatures(texts))
    linked = bounded_broadcast(linked_nodes(signed, texts), MAX_BROADCAST_IDS)
    rows = signed.select("doc_id", "th", "n_shingles", "node").join(linked, "node", "left").select(
        "doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).alias("component"))
    rows = stage(rows)
    groups = stage(rows.groupBy("component").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
                   .where("n > 1 AND component IS NOT NULL").drop("n"))
    return (rows.join(bounded_broadcast(groups, MAX_BROADCAST_IDS), "component", "left")
            .select("doc_id", "th", "n_shingles", "component", F.coalesce("first", "doc_id").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``; component_id is the smallest linked id."""
    return linked_rows(docs, id_col, text_col).drop("th", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that with the smallest id (of its texts and repeats, one).

    Rows without an id stay; a row without shingles is a component of its own with its repeats; texts that share an id
    but not a component stay both.
    """
    alone = F.when(F.col("component").isNull(), F.struct("doc_id", "th"))
    found = stage(linked_rows(docs, id_col, text_col).where("doc_id IS NOT NULL")
                  .select("doc_id", "th", F.struct("component", alone.alias("alone")).alias("g")))
    stays = (found.groupBy("g").agg(F.min(F.struct("doc_id", "th")).alias("s"), F.count("*").alias("n"))
             .where("n > 1").select("g", F.col("s.doc_id").alias("s_id"), F.col("s.th").alias("s_th")))
    grouped = stage(found.join(bounded_broadcast(stage(stays.withColumnRenamed("g", "s_g")), MAX_BROADCAST_IDS), F.col("g").eqNullSafe(F.col("s_g"))))
    stayed = (F.col("doc_id") == F.col("s_id")) & (F.col("th") == F.col("s_th"))
    gone = grouped.where(~stayed).select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th")).distinct()
    gone = bounded_broadcast(stage(gone), MAX_BROADCAST_IDS)
    kept = (docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"))
            .join(gone, (F.col("_id") == F.col("g_id")) & (F.col("_th") == F.col("g_th")), "left_anti"))
    # rows repeated as a whole are few; only they are shuffled
    twice = (grouped.where(stayed).groupBy("doc_id", "th").count().where("count > 1")
             .select(F.col("doc_id").alias("t_id"), F.col("th").alias("t_th")))
    twice = bounded_broadcast(stage(twice), MAX_BROADCAST_IDS)
    repeated = (F.col("_id") == F.col("t_id")) & (F.col("_th") == F.col("t_th"))
    once = kept.join(twice, repeated, "left_anti")
    firsts = kept.join(twice, repeated, "left_semi").dropDuplicates(["_id", "_th"])
    return once.unionByName(firsts).select("_row.*")
