"""Links between similar texts that share a key of an index, whatever the index: each group is first linked to one of its members, what that leaves apart is looked at within tasks.

Nodes are sets of shingles. The head of a key is the node of it that shares the most keys; every node is compared with the head that it
shares the most keys with, so a family of near copies takes as many comparisons as it has members. Where the nodes of a key are in more than one group after
that, the rest of their pairs is looked at in blocks of a bounded size, each pair under the first key that it shares; only links come out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import mix, partitions, run_hashes, slices, stage, utf8, word_hashes, word_spans
from caseweave.llm.simhash import components

#: Nodes and bytes of shingles in a block.
BLOCK, BLOCK_BYTES = 1024, 32 << 20
#: Rows that are posted, or unpacked, at a time.
POSTED = 512
#: Seeds the names of shingles of fewer words (fixed value).
SHORT_STEP = 0xC2B2AE3D27D4EB4F


class Index:
    """What an index says of nodes by their marks (rows of a matrix of `kind`); sets have shingles of `size` words, links `percent` in a hundred in common."""

    kind: type = np.uint8

    def __init__(self, size: int, percent: int) -> None:
        self.size, self.percent = size, percent

    def matrix(self, marks: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(marks), self.kind).reshape(len(marks), -1)

    def keys(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of each node, 64 bits, at their numbers, and which of them there are."""
        raise NotImplementedError

    def first(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of the first key that pairs of marks share."""
        raise NotImplementedError

    def likely(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether pairs of marks, of sets of n and m shingles, may be links; and a number that is higher for closer ones."""
        raise NotImplementedError

    def sizes_fit(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of each text (A-Z in lower case; all words where there are fewer), ascending, and where each text's begin (with one more entry for the end)."""
    lower = data.copy()
    lower[(data >= 65) & (data <= 90)] += 32
    starts, ends, first = word_spans(lower, offsets)
    words = word_hashes(lower, starts, ends)[0]
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(words))
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    head = np.zeros(len(words), bool)
    head[first[:-1][np.diff(first) > 0]] = True
    held, whose = [], []
    for width in range(1, size + 1):
        at = np.flatnonzero(left >= size) if width == size else np.flatnonzero(head & (left == width))
        if len(at):
            found = run_hashes(words, width, 0)[at]
            held.append(found if width == size else mix(found ^ np.uint64(SHORT_STEP * width & ((1 << 64) - 1))))
            whose.append(owner[at])
    if not held:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    hashes, whose = np.concatenate(held), np.concatenate(whose)
    order = np.lexsort((hashes, whose))
    hashes, whose = hashes[order], whose[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (whose[1:] != whose[:-1])]
    hashes, whose = hashes[new], whose[new]
    return hashes, np.searchsorted(whose, np.arange(len(offsets)))


def hashed_texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def posted(nodes: DataFrame, index: Index) -> DataFrame:
    """key and node of every key of nodes (node, marks)."""

    def post(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, POSTED):
                part = batch.slice(at, POSTED)
                keys, some = index.keys(index.matrix(part.column("marks").to_pylist()))
                ids = np.broadcast_to(part.column("node").to_numpy()[:, None], keys.shape)
                yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(ids[some])], names=["key", "node"])

    return nodes.select("node", "marks").mapInArrow(post, "key long, node long")


def shared_postings(nodes: DataFrame, index: Index) -> DataFrame:
    """key, node and _n (the nodes of the key) of the keys that more than one node has. Common keys are counted by tasks first."""
    keyed = posted(nodes, index)
    counted = stage(keyed.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > 1), "keys")
    return stage(keyed.join(counted, "key"), "postings")


def met_postings(nodes: DataFrame, index: Index) -> DataFrame:
    """The same in one shuffle, for many keys of which few are shared: a posting stays if it has the key of the one before or behind it."""

    def met(batches):
        import pyarrow as pa

        key, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        again = False  # whether the first that is held has the key of the one before it
        for batch in batches:
            key, node = np.append(key, batch.column("key").to_numpy()), np.append(node, batch.column("node").to_numpy())
            if len(key) > 1:
                same = key[1:] == key[:-1]
                good = np.append(again, same[:-1]) | same
                yield pa.RecordBatch.from_arrays([pa.array(key[:-1][good]), pa.array(node[:-1][good])], names=["key", "node"])
                again, key, node = bool(same[-1]), key[-1:], node[-1:]
        if again:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node)], names=["key", "node"])

    n = partitions(nodes.sparkSession)
    found = stage(posted(nodes, index).repartition(n, "key").sortWithinPartitions("key").mapInArrow(met, "key long, node long"), "met")
    return stage(found.join(found.groupBy("key").agg(F.count("*").alias("_n")), "key"), "postings")


def _needed(table: DataFrame, ids: DataFrame, most_broadcast: int) -> DataFrame:
    """The rows of table whose node is in ids (node), picked by a broadcast if these are at most `most_broadcast`."""
    return table.join(F.broadcast(ids) if ids.count() <= most_broadcast else ids, "node", "left_semi")


def _both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) with columns of both nodes, as a_x and b_x."""
    for end in ("a", "b"):
        pairs = pairs.join(table.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns)), end)
    return pairs


def estimated(pairs: DataFrame, nodes: DataFrame, index: Index, most_broadcast: int = 1_000_000) -> DataFrame:
    """The pairs (a, b) that their marks do not rule out."""

    def estimate(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y = (index.matrix(batch.column(c).to_pylist()) for c in ("a_marks", "b_marks"))
                n, m = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
                good = index.likely(x, y, n, m)[0] & index.sizes_fit(n, m)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))

    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    return _both(pairs, _needed(nodes.select("node", "n", "marks"), ids, most_broadcast), "n", "marks").mapInArrow(estimate, "a long, b long")


def shingle_sets(docs: DataFrame, nodes: DataFrame, ids: DataFrame, size: int, most_broadcast: int = 1_000_000) -> DataFrame:
    """node and hashes (its shingles, ascending, eight bytes each) of the nodes in ids (node), from one of their texts each."""
    wanted = stage(_needed(nodes.select("node", "t1", "t2"), ids, most_broadcast), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= most_broadcast else wanted
    texts = hashed_texts(docs).join(wanted, ["t1", "t2"]).dropDuplicates(["node"]).select("node", "text")

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in slices(offsets, 1 << 20):
                hashes, bounds = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
                sets = [hashes[x:y].tobytes() for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(sets, pa.binary())], names=["node", "hashes"])

    return stage(texts.mapInArrow(hashed, "node long, hashes binary"), "sets")


def linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 times the shingles that `one` shares with each of the others is `percent` times those of either and more."""
    sizes = np.array([len(x) for x in others])
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, every), len(one) - 1)
    common = np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * common >= percent * (len(one) + sizes - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            sets = (map(lambda x: np.frombuffer(x.as_buffer(), np.uint64), batch.column(c)) for c in ("a_hashes", "b_hashes"))  # no copies
            good = [bool(linked(x, [y], percent)[0]) for x, y in zip(*sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return _both(pairs, sets, "hashes").mapInArrow(verify, "a long, b long")


UNIT = ["key", "low", "high", "block", "node", "label", "n", "marks"]


def units(shared: DataFrame, labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """The postings of the keys whose nodes are in more than one group, once for each pair of blocks (low, high) of the key that they are in."""
    named = shared.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").withColumn("label", F.coalesce("label", "node"))
    named = stage(named.select("key", "node", "label").join(nodes.select("node", "n"), "node"), "named")
    load = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES))
    open_keys = stage(named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), load.alias("blocks")).where(F.col("x") < F.col("y")).select("key", "blocks"), "open")
    dealt = named.join(open_keys, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).join(nodes.select("node", "marks"), "node").select(*UNIT)


#: Pairs of nodes that are looked at together.
PAIRS = 1 << 14


def by_unit(dealt: DataFrame, work, schema: str, *more: str) -> DataFrame:
    """What `work` (a function of rows of whole units in their order, and where each unit begins) gives, as batches; small units go together."""
    names = [*UNIT, *more]

    def every(batches):
        held, starts, pairs, unit = [], [], 0, None
        for batch in batches:
            for row in (r for a in range(0, batch.num_rows, POSTED) for r in batch.slice(a, POSTED).to_pylist()):
                own = row["key"], row["low"], row["high"]
                if own != unit:
                    if pairs > PAIRS:
                        yield from work(held, starts)
                        held, starts, pairs = [], [], 0
                    unit = own
                    starts.append(len(held))
                pairs += len(held) - starts[-1]
                held.append(row)
        if held:
            yield from work(held, starts)

    spark = dealt.sparkSession
    return dealt.select(*names).repartition(partitions(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high", "node").mapInArrow(every, schema)


def _pairs(starts: np.ndarray, ends: np.ndarray):
    """Numbers (x, y), x < y, of all pairs of rows of each unit, about PAIRS at a time."""
    first = np.repeat(starts, ends - starts)
    row = np.arange(len(first)) + (starts[0] if len(starts) else 0)
    before = row - first  # a row meets those before it
    ahead = np.cumsum(before)
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(ahead, (ahead[at - 1] if at else 0) + PAIRS, side="right")))
        n = before[at:to]
        y = np.repeat(row[at:to], n)
        yield np.arange(len(y)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n), y
        at = to


def open_pairs(rows: list[dict], starts: list[int], index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of rows of one unit, of two groups, that meet first under its key and that the marks do not rule out; and how close they are."""
    marks, n = index.matrix([r["marks"] for r in rows]), np.array([r["n"] for r in rows])
    get = lambda c: np.array([r[c] for r in rows])
    label, block, apart = get("label"), get("block"), get("low") != get("high")
    begin, end = np.array(starts), np.array([*starts[1:], len(rows)])
    keys, some = index.keys(marks[begin])
    number = np.repeat((some & (keys.view(np.int64) == get("key")[begin, None])).argmax(axis=1), end - begin)
    found = [np.zeros((3, 0), np.int64)]
    for x, y in _pairs(begin, end):
        good = (label[x] != label[y]) & ((block[x] != block[y]) | ~apart[x]) & index.sizes_fit(n[x], n[y])
        x, y = x[good], y[good]
        if not len(x):
            continue
        good, close = index.likely(marks[x], marks[y], n[x], n[y])
        x, y, close = x[good], y[good], close[good]
        good = index.first(marks[x], marks[y]) == number[x] if len(x) else np.zeros(0, bool)
        found.append(np.stack([x[good], y[good], close[good]]))
    return tuple(np.concatenate(found, axis=1))


def later_links(dealt: DataFrame, docs: DataFrame, nodes: DataFrame, index: Index) -> DataFrame:
    """Links (a, b) that join the groups of all nodes which the pairs of the units do."""
    def needing(rows: list[dict], starts: list[int]):
        import pyarrow as pa

        x, y, _ = open_pairs(rows, starts, index)
        if len(x):
            yield pa.RecordBatch.from_pylist([{c: rows[k][c] for c in UNIT} for k in np.union1d(x, y).tolist()], pa.schema([(c, pa.binary() if c == "marks" else pa.int64()) for c in UNIT]))

    def joining(rows: list[dict], starts: list[int]):
        import pyarrow as pa

        x, y, same = open_pairs(rows, starts, index)
        sets, found = [np.frombuffer(r["hashes"], np.uint64) for r in rows], []
        # groups of one label in two units are apart here: they are joined where all links are
        unit = np.repeat(np.arange(len(starts)), np.diff([*starts, len(rows)]))
        group = np.unique(np.stack([unit, [r["label"] for r in rows]]), axis=1, return_inverse=True)[1].ravel()
        root = np.arange(group.max() + 1)
        order = np.argsort(-same, kind="stable")  # the likeliest first
        x, y = x[order], y[order]
        while len(x):
            for p, q in zip(x[:256].tolist(), y[:256].tolist(), strict=True):
                one, two = root[group[p]], root[group[q]]
                if one != two and linked(sets[p], [sets[q]], index.percent)[0]:
                    root[root == two] = one
                    found.append((rows[p]["node"], rows[q]["node"]))
            left = root[group[x[256:]]] != root[group[y[256:]]]
            x, y = x[256:][left], y[256:][left]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    need = stage(by_unit(dealt, needing, ", ".join(f"{c} {'binary' if c == 'marks' else 'long'}" for c in UNIT)), "needing")
    ids = stage(need.select("node").distinct(), "needed")
    return by_unit(need.join(shingle_sets(docs, nodes, ids, index.size), "node"), joining, "a long, b long", "hashes")


def groups(docs: DataFrame, nodes: DataFrame, shared: DataFrame, index: Index) -> DataFrame:
    """node and label (one of the nodes) of the nodes that links connect; others have no row.

    docs: doc_id, text; nodes: node, n (its shingles), marks, t1 and t2 (the hashes of one of its texts); shared: their postings.
    """
    weight = shared.groupBy("node").agg(F.sum("_n").alias("weight"))
    heads = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("head")).select("key", (-F.col("head.minus")).alias("head"))
    tally = shared.join(heads, "key").where(F.col("node") != F.col("head")).groupBy("node", "head").agg(F.count("*").alias("tally"))
    best = tally.groupBy("node").agg(F.max(F.struct("tally", (-F.col("head")).alias("minus"))).alias("_b")).select("node", (-F.col("_b.minus")).alias("head"))
    stars = best.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    near = stage(estimated(stage(stars, "pairs"), nodes, index), "near")
    ids = stage(near.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
    links = stage(verified(near, shingle_sets(docs, nodes, ids, index.size), index.percent), "links")
    labels = stage(components(links), "labels")
    more = stage(later_links(units(shared, labels, nodes), docs, nodes, index), "links")
    if more.isEmpty():
        return labels
    return stage(components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))), "labels")
