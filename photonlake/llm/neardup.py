"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles. One permutation of hashes, cut into ``COORDS`` ranges, gives its minwise
tokens. In each of ``TREES`` independent trees a node selects coordinates and sends a document down the branches
that its minwise tokens there name, so documents go together with probability equal to their similarity at
every step. A small node is compared exhaustively; a large one is branched again, in Spark while it is too
large for a task and in numpy below that. A pair at the threshold meets in a given tree with probability of
about 0.84, so eight trees miss it with one of some 4e-7.

Nodes compare minwise tokens, with a wide margin, and hand out stars (a few rows per document, never pairs).
The components of these stars are clusters, and in each cluster the links are confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import arrow_map, flat_utf8, materialise, mix64, side, span_hashes, split_words, unused

COORDS = 64
TREES = 8
#: Coordinates that a node selects below the root; documents that are compared exhaustively; deepest level.
BRANCHES = 3
SMALL = 48
DEPTH = 5
#: Documents of a node that one task takes; larger nodes are branched by Spark.
LARGE = 50_000
#: Stars that a comparing task gathers before it hands them out.
HELD_LINKS = 2_000_000
#: Shingles that one side of a confirming task holds at most (8 bytes each); larger clusters are cut into blocks.
BLOCK_SHINGLES = 1_000_000
#: Rounds in which a cluster of several blocks is compared with a leader each, before its blocks meet.
LEADERS = 4
#: How far below the threshold the share of equal minwise tokens may be (over four deviations).
MARGIN = 0.35
#: Of a node's leader: documents at CORE or more leave the node, as all that could link to them are at REACH or more.
CORE, REACH = 0.85, 0.30

_PROBES = (mix64(np.arange(1, COORDS * 256 + 1, dtype=np.uint64)) % np.uint64(COORDS)).astype(np.int64).reshape(COORDS, 256)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: the hash of each word (A-Z lower-cased) and the number of its text."""
    apart, begin, end, owner = split_words(data, at)
    return span_hashes(apart, begin, end), owner


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, laid end to end, and their n+1 offsets."""
    n = len(at) - 1
    word, owner = words_of(data, at)
    count = np.bincount(owner, minlength=n)
    ends = np.cumsum(count)
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(word) - k + 1), np.uint64)
        for j in range(k):
            total += word[j : len(word) - k + 1 + j] * np.uint64(2 * j + 3)
        total = mix64(total)
        whole = owner[: len(total)] == owner[k - 1 :] if len(total) else np.zeros(0, bool)
        flat, who = total[whole], owner[: len(total)][whole]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            extra = np.array([mix64(np.array([(word[ends[i] - count[i] : ends[i]] * (np.arange(count[i], dtype=np.uint64) * np.uint64(2) + np.uint64(3))).sum() + np.uint64(count[i])]))[0] for i in short], np.uint64)
            flat, who = np.concatenate([flat, extra]), np.concatenate([who, short])
            order = np.argsort(who, kind="stable")
            flat, who = flat[order], who[order]
    bounds = np.searchsorted(who, np.arange(n + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            flat[a:b].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = (flat[1:] != flat[:-1]) | (who[1:] != who[:-1])
    flat, who = flat[fresh], who[fresh]
    return flat, np.searchsorted(who, np.arange(n + 1))


def set_keys(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set: equal sets, and for all purposes only those, have equal keys."""
    out = np.zeros((2, len(at) - 1), np.uint64)
    live = np.diff(at) > 0
    if live.any():
        with np.errstate(over="ignore"):
            for k, salt in enumerate((0x51ED27, 0xA3F1C9)):
                out[k, live] = np.add.reduceat(mix64(flat + np.uint64(salt)), at[:-1][live])
    return out[0].view(np.int64), out[1].view(np.int64)


def minwise(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The minwise token of each coordinate (texts, COORDS); an empty range takes that of a range it hashes to."""
    n = len(at) - 1
    out = np.zeros((n, COORDS), np.uint64)
    have = np.zeros((n, COORDS), bool)
    if len(flat):
        cell = np.repeat(np.arange(n), np.diff(at)) * COORDS + (flat >> np.uint64(58)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        out.ravel()[cell[first]] = flat[first]
        have.ravel()[cell[first]] = True
    rows, cols = np.nonzero(~have & have.any(axis=1)[:, None])
    for t in range(_PROBES.shape[1]):
        if not len(rows):
            break
        source = _PROBES[cols, t]
        hit = have[rows, source]
        out[rows[hit], cols[hit]] = out[rows[hit], source[hit]]
        rows, cols = rows[~hit], cols[~hit]
    return out


def _sketch(docs: DataFrame, k: int) -> DataFrame:
    """Of each document (doc_id, text, tk): size and keys of its set, 16 bits of each minwise token, and its node in each tree's first level."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = shingle_sets(*flat_utf8(batch.column(1)), k)
        k1, k2 = set_keys(flat, at)
        tokens = minwise(flat, at)
        n = len(at) - 1
        sig = np.ascontiguousarray((mix64(tokens) & np.uint64(0xFFFF)).astype("<u2"))
        coords = (np.arange(TREES) * 37 + 5) % COORDS
        with np.errstate(over="ignore"):
            roots = mix64(tokens[:, coords] + np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 2 * COORDS).astype(np.int32)), pa.py_buffer(sig)])
        lists = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * TREES).astype(np.int32)), pa.array(roots.ravel()))
        cols = [batch.column(0), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(k1), pa.array(k2), binary, lists]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "tk", "n_shingles", "k1", "k2", "sig", "roots"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text", "tk"), run, f"doc_id {id_type}, tk bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary, roots array<bigint>", "text")


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least one that links (a, b) reach."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def _stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between ids as stars: each id once at most, with the least id that it reaches."""
    names, place = np.unique(np.concatenate([ids[a], ids[b]]), return_inverse=True)
    label = least_labels(len(names), place[: len(a)], place[len(a) :])
    on = np.flatnonzero(label != np.arange(len(names)))
    return names[on], names[label[on]]


class _Nodes:
    """Compares the documents of nodes; gathers stars as pairs of places in the arrays it is given."""

    def __init__(self, ids: np.ndarray, sigs: np.ndarray, cut: float, large: int):
        self.ids, self.sigs, self.least, self.large = ids, sigs, int(np.ceil(cut * COORDS)), large
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def small(self, groups: np.ndarray) -> None:
        """groups: (nodes, size) places. All pairs of each node are compared; its components become stars."""
        g, s = groups.shape
        step = max(1, (1 << 21) // (s * s * COORDS) + 1)
        for a in range(0, g, step):
            part = groups[a : a + step]
            sig = self.sigs[part]
            near = np.zeros((len(part), s, s), bool)
            for i in range(s):
                near[:, i] = (sig == sig[:, i : i + 1]).sum(axis=2) >= self.least
            label = np.tile(np.arange(s), (len(part), 1))
            while True:
                less = np.where(near, label[:, None, :], s).min(axis=2)
                less = np.minimum(less, label)
                if (less == label).all():
                    break
                label = less
            r, c = np.nonzero(label != np.arange(s))
            self.found.append((part[r, c], part[r, label[r, c]]))

    def exhaustive(self, places: np.ndarray) -> None:
        """Components of one node: a search that compares a document with those not yet reached only."""
        left = places
        while len(left) > 1:
            queue, left = [left[0]], left[1:]
            head = queue[0]
            while queue and len(left):
                near = (self.sigs[left] == self.sigs[queue.pop()]).sum(axis=1) >= self.least
                if near.any():
                    new = left[near]
                    self.found.append((new, np.full(len(new), head)))
                    queue.extend(new)
                    left = left[~near]

    def large_node(self, places: np.ndarray, seed: int, depth: int) -> None:
        """Leaders first: what is close to one leaves. The rest is branched, or compared where it is small."""
        for _ in range(6):
            if len(places) <= SMALL:
                break
            equal = (self.sigs[places] == self.sigs[places[0]]).sum(axis=1)
            core = equal >= CORE * COORDS
            many = core.sum() * 5 >= len(places)
            near = places[equal >= (REACH * COORDS if many else self.least)]
            self.found.append((near, np.full(len(near), places[0])))
            core[0] = True  # the leader itself has met all others
            places = places[~core] if many else places[1:]
            if not many:
                break
        if len(places) <= SMALL:
            if len(places) > 1:
                self.small(places[None, :])
        elif depth >= DEPTH:
            self.exhaustive(places)
        else:
            for c, value in self.branches(places, seed):
                order = np.argsort(value, kind="stable")
                cuts = np.flatnonzero(np.diff(value[order])) + 1
                for child in np.split(order, cuts):
                    if len(child) > SMALL:
                        self.large_node(places[child], _child_seed(seed, c, int(value[child[0]])), depth + 1)
                    elif len(child) > 1:
                        self.small(places[child][None, :])

    def branches(self, places: np.ndarray, seed: int):
        for c in _selected(seed):
            yield c, self.sigs[places, c]


def _child_seed(seed: int, coord: int, value: int) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([seed], np.int64).view(np.uint64) + np.uint64(coord * 65536 + value + 1)).view(np.int64)[0])


def _selected(seed: int) -> list[int]:
    """The coordinates that a node selects, by its own seed."""
    with np.errstate(over="ignore"):
        rank = mix64(np.array([seed], np.int64).view(np.uint64) + np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return np.argsort(rank)[:BRANCHES].tolist()


def _compare_nodes(nodes: DataFrame, cut: float) -> DataFrame:
    """Stars (a, b) from nodes (key, depth, id, sig), each of a size that a task can hold.

    A task joins the stars of its nodes up (of ``HELD_LINKS`` at a time), so it hands out a row for each of its ids at most.
    """
    dealt = nodes.repartition("key").sortWithinPartitions("key", "id")

    def solve(key, depth, ids, sigs):
        work = _Nodes(ids, sigs, cut, 0)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        for s in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
            work.small(starts[sizes == s][:, None] + np.arange(s))
        for i in np.flatnonzero(sizes > SMALL):
            work.large_node(np.arange(starts[i], starts[i] + sizes[i]), int(key[starts[i]]), int(depth[starts[i]]))
        a = np.concatenate([x[0] for x in work.found] + [np.zeros(0, int)]).astype(int)
        b = np.concatenate([x[1] for x in work.found] + [np.zeros(0, int)]).astype(int)
        return _stars(ids, a, b)

    def joined(stars):
        a, b = (np.concatenate([x[k] for x in stars]) for k in range(2))
        return _stars(np.concatenate([a, b]), np.arange(len(a)), np.arange(len(a), 2 * len(a)))

    def run(batches):
        held: list[tuple] = []
        stars: list[tuple] = []
        whole = lambda: solve(*(np.concatenate([h[k] for h in held]) for k in range(4)))
        for batch in batches:
            if not batch.num_rows:
                continue
            key, depth, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            sig, at = flat_utf8(batch.column(3))
            sigs = sig.view("<u2").reshape(-1, COORDS)
            last = int(np.searchsorted(key, key[-1]))  # the last node may go on in the next batch
            if last == 0 and (not held or held[-1][0][0] == key[-1]):
                held.append((key, depth, ids, sigs))
                continue
            held.append((key[:last], depth[:last], ids[:last], sigs[:last]))
            stars.append(whole())
            held = [(key[last:], depth[last:], ids[last:], sigs[last:])]
            if sum(len(x[0]) for x in stars) > HELD_LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(stars)], names=["a", "b"])
                stars = []
        if held:
            stars.append(whole())
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in joined(stars)], names=["a", "b"])

    return dealt.select("key", "depth", "id", "sig").mapInArrow(run, "a bigint, b bigint")


def _equal_tokens(one: str, other: str):
    """The number of coordinates at which two signatures agree, in SQL."""
    return F.expr(f"size(filter(sequence(0, {COORDS - 1}), i -> substring({one}, 2 * i + 1, 2) = substring({other}, 2 * i + 1, 2)))")


def _split_large(nodes: DataFrame, cut: float, large: int) -> tuple[DataFrame, list[DataFrame]]:
    """Branch nodes of over ``large`` documents, level by level, until none is left but at the deepest level.

    A level takes each large node's least document as its leader: stars go to it, documents close to it leave
    (see :class:`_Nodes`), the rest goes down the selected branches. Only sizes and leaders are gathered by node;
    documents meet them by joins on the node's key, which adaptive execution can split.
    """
    stars, small = [], []
    for depth in range(1, 2 * DEPTH + 1):
        sizes = nodes.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("leader")).where(F.col("n") > large)
        sizes = materialise(sizes)
        if sizes.isEmpty():
            break
        marked = nodes.join(sizes.withColumnRenamed("key", "big"), F.col("key") == F.col("big"), "left")
        small.append(marked.where("big is null").select("key", "depth", "id", "sig"))
        lead = nodes.join(sizes.select(F.col("key").alias("big"), "leader"), (F.col("key") == F.col("big")) & (F.col("id") == F.col("leader")))
        lead = lead.select(F.col("key").alias("big"), F.col("id").alias("leader"), F.col("sig").alias("leader_sig")).dropDuplicates(["big"])
        big = nodes.join(lead, F.col("key") == F.col("big")).withColumn("equal", _equal_tokens("sig", "leader_sig"))
        big = materialise(big.select("key", "depth", "id", "sig", "leader", "equal"))
        share = big.groupBy("key").agg((F.sum(F.when(F.col("equal") >= CORE * COORDS, 1).otherwise(0)) * 5 >= F.count("*")).alias("many"))
        big = big.join(share.withColumnRenamed("key", "k"), F.col("key") == F.col("k"))
        stars.append(big.where(F.col("equal") >= F.when(F.col("many"), REACH * COORDS).otherwise(float(int(np.ceil(cut * COORDS))))).where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")))
        rest = big.where((F.col("id") != F.col("leader")) & ~(F.col("many") & (F.col("equal") >= CORE * COORDS)))
        # An end to branching: documents that agree this often are left to their leaders' rounds.
        coords = F.sort_array(F.transform(F.sequence(F.lit(0), F.lit(COORDS - 1)), lambda c: F.struct(F.xxhash64(F.col("key"), c).alias("r"), c.alias("c"))))
        down = rest.select("depth", "id", "sig", "key", F.explode(F.slice(coords, 1, BRANCHES)).alias("s"))
        nodes = down.select(F.xxhash64("key", "s.c", F.expr("substring(sig, 2 * s.c + 1, 2)")).alias("key"), (F.col("depth") + 1).alias("depth"), "id", "sig")
        nodes = materialise(nodes)
    small.append(nodes)
    out = small[0]
    for x in small[1:]:
        out = out.union(x)
    return out, stars


def _common(codes: np.ndarray, starts: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mark[codes], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)


def link_components(flat: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """For each set (none empty), the least place that can be reached by links ``100 * common >= percent * union``.

    Shingles are ordered from rare to frequent. Two sets that link share one among the first ``size - need + 1`` of
    each, need being the least that they must share, so only sets that meet in a list of those are compared. Sets
    that are reached leave the lists, so a group of near copies costs little more than its size.
    """
    n, size = len(at) - 1, np.diff(at)
    label = np.arange(n)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))
    alone = int((times == 1).sum())  # codes below are of one set only
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(owner * np.int64(len(times)) + rank[code])
    code = rank[code][order].astype(np.int32)
    del rank, order
    prefix = size - -(-percent * size // 100) + 1
    early = (np.arange(len(code)) - np.repeat(at[:-1], size) < np.repeat(prefix, size)) & (code >= alone)
    place = np.flatnonzero(early)
    listed, who = code[place], owner[place]
    by = np.argsort(listed, kind="stable")
    listed, who = listed[by], who[by]
    cuts = np.flatnonzero(np.diff(listed)) + 1
    lists = dict(zip(listed[np.concatenate([[0], cuts])].tolist() if len(listed) else [], np.split(who, cuts), strict=True)) if len(listed) else {}
    own = [listed[:0]] * n
    if len(place):
        ends = np.searchsorted(owner[place], np.arange(n + 1))
        own = [code[place[x:y]] for x, y in zip(ends[:-1], ends[1:], strict=True)]
    mark, alive = np.zeros(len(times), bool), np.ones(n, bool)
    for head in range(n):
        if not alive[head]:
            continue
        alive[head] = False
        queue = [head]
        while queue:
            x = queue.pop()
            met = []
            for c in own[x].tolist():
                left = lists[c]
                left = left[alive[left]]
                lists[c] = left
                met.append(left)
            rows = np.unique(np.concatenate(met)) if met else np.zeros(0, np.int64)
            rows = rows[100 * np.minimum(size[rows], size[x]) >= percent * np.maximum(size[rows], size[x])]
            if not len(rows):
                continue
            mark[code[at[x] : at[x + 1]]] = True
            for part in np.split(rows, np.flatnonzero(np.diff(np.cumsum(size[rows]) // GATHERED)) + 1):
                lens = size[part]
                starts = np.cumsum(lens) - lens
                common = _common(code[np.repeat(at[part] - starts, lens) + np.arange(int(lens.sum()))], starts, mark)
                new = part[100 * common >= percent * (lens + size[x] - common)]
                label[new] = head
                alive[new] = False
                queue.extend(new.tolist())
            mark[code[at[x] : at[x + 1]]] = False
    return label


#: Shingles that are gathered at a time when a set is compared with others.
GATHERED = 1 << 18


def _shingles_of(texts: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(id, cluster, n, shingles) of the members: their sets, 8 bytes a shingle, in order. Repeated rows stay repeated."""
    joined = texts.join(side(members), (F.col("doc_id") == F.col("of")) & (F.col("tk") == F.col("text_key")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat, at = shingle_sets(*flat_utf8(batch.column(0)), k)
        body = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((at * 8).astype(np.int32)), pa.py_buffer(flat)])
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(np.diff(at)), body], names=["id", "cluster", "n", "shingles"])

    return arrow_map(joined.select("text", "id", "cluster"), run, "id bigint, cluster bigint, n bigint, shingles binary", "text")


def _led(sets: DataFrame) -> DataFrame:
    """(id, cluster, n, shingles, leader, common): each set of a large cluster beside the cluster's leader."""
    lead = sets.groupBy("cluster").agg(F.min(F.struct("linked", "id")).alias("x")).select(F.col("cluster").alias("c"), F.col("x.id").alias("leader"))
    lead = sets.join(side(materialise(lead)), (F.col("cluster") == F.col("c")) & (F.col("id") == F.col("leader")))
    lead = materialise(lead.dropDuplicates(["c"]).select("c", "leader", F.col("shingles").alias("first")))
    joined = sets.drop("linked").join(side(lead), F.col("cluster") == F.col("c"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cluster = batch.column(1).to_numpy()
        body, at = flat_utf8(batch.column(3))
        flat, at = body.view(np.uint64), at // 8
        common = np.zeros(batch.num_rows, np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(cluster)) + 1, [batch.num_rows]])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            first = np.frombuffer(batch.column(5)[x].as_buffer(), np.uint64)
            own = flat[at[x] : at[y]]
            where = np.minimum(np.searchsorted(first, own), len(first) - 1)
            common[x:y] = np.add.reduceat(first[where] == own, at[x:y] - at[x], dtype=np.int64)
        size = np.array([len(batch.column(5)[int(x)].as_buffer()) // 8 for x in cuts[:-1]], np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.repeat(size, np.diff(cuts))), pa.array(common)], names=["id", "cluster", "n", "shingles", "leader", "size", "common"])

    return arrow_map(joined.select("id", "cluster", "n", "shingles", "leader", "first"), run, "id bigint, cluster bigint, n bigint, shingles binary, leader bigint, size bigint, common bigint", "shingles")


def _confirm(docs: DataFrame, members: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Stars (a, b) of true links between the members of a cluster, by their full sets.

    members: id, of and text_key (whose row has the set), n_shingles, cluster. A cluster of at most ``block`` shingles
    is a task's. In a larger one all meet a leader first, a join that adaptive execution can split. One minus the
    similarity is a metric, so those that are closer to the leader than all that don't link with it, by more than a
    link is long, can have no link but into the leader's component, and leave. What is left after ``LEADERS`` rounds
    is dealt into blocks by id, and each two blocks meet in one task.
    """
    sets = materialise(_shingles_of(docs, members, k).withColumn("linked", F.lit(False)))
    stars, done = [], []
    for _ in range(LEADERS):
        large = materialise(sets.groupBy("cluster").agg(F.sum("n").alias("w")).where(F.col("w") > block).select(F.col("cluster").alias("big")))
        if large.isEmpty():
            break
        marked = sets.join(side(large), F.col("cluster") == F.col("big"), "left")
        done.append(marked.where("big is null").drop("big"))
        led = materialise(_led(marked.where("big is not null").drop("big")))
        led = led.withColumn("link", 100 * F.col("common") >= percent * (F.col("n") + F.col("size") - F.col("common")))
        led = led.withColumn("far", 1 - F.col("common") / (F.col("n") + F.col("size") - F.col("common")))
        stars.append(led.where("link and id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")))
        rest = materialise(led.where("not link").groupBy("cluster").agg(F.min("far").alias("least")).withColumnRenamed("cluster", "c"))
        led = led.where("id <> leader").join(side(rest), F.col("cluster") == F.col("c"))
        led = led.where(~F.col("link") | (F.col("far") >= F.col("least") - (1 - percent / 100) - 1e-9))
        sets = materialise(led.select("id", "cluster", "n", "shingles", F.col("link").alias("linked")))
    for x in done:
        sets = sets.union(x)
    weight = sets.groupBy("cluster").agg(F.sum("n").alias("w")).where(F.col("w") > block)
    weight = materialise(weight.select(F.col("cluster").alias("c"), F.ceil(F.col("w") / block).cast("int").alias("parts")))
    placed = sets.join(side(weight), F.col("cluster") == F.col("c"), "left").withColumn("blocks", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "id", "shingles")
    met = met.repartition("task").sortWithinPartitions("task", "id")

    def solve(held):
        ids, flat, size = (np.concatenate([h[k] for h in held]) for k in range(3))
        label = link_components(flat, np.concatenate([[0], np.cumsum(size)]), percent)
        on = np.flatnonzero(label != np.arange(len(label)))
        return ids[on], ids[label[on]]

    def run(batches):
        held, now, a, b = [], None, [], []
        for batch in batches:
            task, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            body, at = flat_utf8(batch.column(2))
            flat, at = body.view(np.uint64), at // 8
            cuts = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if held and task[x] != now:
                    got = solve(held)
                    a.append(got[0]), b.append(got[1])
                    held = []
                now = task[x]
                fresh = np.ones(y - x, bool)  # of repeated rows one
                fresh[1:] = ids[x + 1 : y] != ids[x : y - 1]
                if held and held[-1][0][-1] == ids[x]:
                    fresh &= ids[x:y] != ids[x]
                size = np.diff(at[x : y + 1])
                held.append((ids[x:y][fresh], flat[at[x] : at[y]][np.repeat(fresh, size)], size[fresh]))
                if not fresh.any():
                    held.pop()
        if held:
            got = solve(held)
            a.append(got[0]), b.append(got[1])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    out = met.mapInArrow(run, "a bigint, b bigint")
    for x in stars:
        out = out.union(x)
    return out


def _grouped(docs: DataFrame, k: int, percent: int, large: int, block: int) -> DataFrame:
    """Per row: doc_id, tk (the text's hash), n_shingles, component_id, and whether the row's text is its component's first.

    Texts with equal sets form a class, a node of its own in whatever rows it occurs; classes link, not ids. A
    component's first text is that of its least (doc_id, keys).
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tk"))
    sketch = materialise(_sketch(docs, k))
    able = sketch.where("doc_id is not null and n_shingles > 0")
    reps = able.groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("doc_id", "tk", "sig", "roots")).alias("x"), F.count("*").alias("copies"))
    # Numbers that hold because they are written down.
    reps = reps.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "n_shingles", "copies", F.col("x.doc_id").alias("of"), F.col("x.tk").alias("text_key"), F.col("x.sig").alias("sig"), F.col("x.roots").alias("roots"))
    reps = materialise(reps)
    nodes = reps.select(F.explode("roots").alias("key"), F.lit(1).alias("depth"), "id", "sig")
    cut = percent / 100 - MARGIN
    nodes, stars = _split_large(nodes, cut, large)
    found = _compare_nodes(nodes, cut)
    for s in stars:
        found = found.union(s)
    clusters = materialise(connected_components(found))
    named = reps.select("id", "of", "text_key", "n_shingles", "k1", "k2", "copies")
    members = materialise(named.join(side(clusters), F.col("id") == F.col("node")).select("id", "of", "text_key", F.col("component").alias("cluster")))
    components = materialise(connected_components(_confirm(docs, members, k, percent, block)))
    linked = named.join(side(components), F.col("id") == F.col("node"), "left")
    linked = materialise(linked.where("component is not null or copies > 1").select(F.coalesce("component", "id").alias("component"), "of", "k1", "k2", "n_shingles"))
    firsts = materialise(linked.groupBy("component").agg(F.min(F.struct("of", "k1", "k2")).alias("x")).select(F.col("component").alias("c"), "x"))
    classes = linked.join(side(firsts), F.col("component") == F.col("c"))
    first = (F.col("k1") == F.col("x.k1")) & (F.col("k2") == F.col("x.k2"))
    classes = materialise(classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("n_shingles").alias("cn"), F.col("x.of").alias("least"), first.alias("first")))
    own = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n_shingles") == F.col("cn")) & F.col("doc_id").isNotNull()
    out = sketch.select("doc_id", "tk", "n_shingles", "k1", "k2").join(side(classes), own, "left")
    return out.select("doc_id", "tk", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, large: int = LARGE, block: int = BLOCK_SHINGLES) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Takes ``doc_id`` (of an integer type) and ``text``; other columns are not read. Words are runs of bytes other than
    ASCII white space, A-Z lower-cased; a text of fewer than ``k`` words, but not none, has one shingle, the whole.
    Returns per row: ``doc_id``, ``n_shingles``, ``component_id`` (the least doc_id that links reach) and ``kept``
    (doc_id = component_id). Texts that are null, empty or without words have no shingles and link with nothing,
    and so do rows whose doc_id is null: these have a null component and are kept. Repeated rows give repeated
    results; rows that repeat a doc_id with another text are documents of their own, each in its text's component.
    An empty table gives an empty result.

    Documents with equal sets form a class; one of them alone goes through the join.
    """
    out = _grouped(docs, k, percent, large, block)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, without all but one row of each group of :func:`near_duplicates`.

    Of a group the row with the least doc_id stays; where several texts or rows have that id, the text with the least
    keys, and of rows that are equal in doc_id and text one. Other rows that repeat a doc_id stay if their own
    group keeps them. Rows with a null doc_id stay, and so do texts without words, but for all but one of those
    that are equal in doc_id and text.
    """
    found = materialise(_grouped(docs, k, percent, LARGE, BLOCK_SHINGLES).where("doc_id is not null"))
    stays = F.col("first") & (F.col("doc_id") == F.col("component_id"))
    gone_id, gone_key = unused(docs, "gone_id", "gone_key")
    gone = materialise(found.where(~stays).select(F.col("doc_id").alias(gone_id), F.col("tk").alias(gone_key)).distinct())
    key = F.coalesce(F.xxhash64(docs["text"]), F.lit(0))
    out = docs.join(side(gone), (docs["doc_id"] == F.col(gone_id)) & (key == F.col(gone_key)), "left_anti")
    twice = found.where(stays).groupBy("doc_id", "tk").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        out = out.where(out["doc_id"].isNotNull()).dropDuplicates(["doc_id", "text"]).union(out.where(out["doc_id"].isNull()))
    return out
