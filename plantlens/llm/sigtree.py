"""Exact n-gram Jaccard join of documents with signature trees.

Documents with equal shingle sets form a class, and one of each class goes on. Which classes may meet is narrowed down
without loss by prefixes: in any fixed order of all shingles, two linked sets share one among the first
n - ceil(t * n) + 1 of each. The order here puts the frequent shingles last, then a quarter of all others (by hash) first,
by how many documents have them. So a class whose prefix has no shared shingle leaves early. Classes that share prefix
shingles, directly or through others, form a block.

Inside a block a signature tree does the join: its nodes hold OR-combined bitmaps of the shingles and ranges of the set
sizes, and a dual traversal drops pairs of nodes whose largest possible overlap is too small; what remains is compared
exactly. A small block is one task. A large one is cut into nodes by size and least shingle, and by the set's hash where
many sets have the same least shingle; a node is bounded in sets and in shingles. Each node is joined with itself first,
then with the next one of its block, and at last with the nodes that it shares a prefix shingle with, except where both are
already in one component. Links inside a component that is known already aren't looked for, so groups of copies stay cheap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plantlens.llm.common import fresh, slices, stage_table
from plantlens.llm.components import components
from plantlens.llm.shingles import mix, shingle_sets

#: Documents, and about so many shingles, in a node of a block that is too large for one task.
NODE, NODE_SHINGLES = 1024, 1 << 23
#: Children of a tree node, and the most bits of a bitmap.
FAN, WIDEST = 8, 1 << 16
#: Shingles that so large a part of a slice of documents has come last in the order (it never changes the result).
FREQUENT = 1 / 128
#: The part of the hash range whose shingles are counted.
COUNTED = 1 / 4
#: Up to this many 64-bit keys are broadcast to pick documents by; more are joined by a shuffle.
BROADCAST_KEYS = 2_000_000
BOUND = int(COUNTED * 2**63)


def _prefix(n: np.ndarray | int, percent: int):
    return n - -(-percent * n // 100) + 1


class SignatureTree:
    """Sets in order of size, FAN nodes in each node above; level 0 are the sets themselves."""

    def __init__(self, sets: list[np.ndarray]):
        n = np.array([len(s) for s in sets])
        self.order = np.lexsort(([s[0] for s in sets], n))
        n = n[self.order]
        bits = min(WIDEST, max(256, 1 << int(16 * n[-1] - 1).bit_length()))
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, i in enumerate(self.order):
            flat = np.zeros(bits, np.uint8)
            flat[sets[i] & (bits - 1)] = 1
            maps[row] = np.packbits(flat).view(np.uint64)
        excess = n - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, n, n, excess)]
        while len(self.levels[-1][0]) > FAN:
            maps, low, high, excess = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(excess, at)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether the largest possible overlap of two nodes is enough for sets of their least sizes."""
        maps, low, high, excess = self.levels[level]
        out = (100 * high[i] >= percent * low[j]) & (100 * high[j] >= percent * low[i])
        step = max(1, (1 << 21) // maps.shape[1])
        at = np.flatnonzero(out)
        for k in range(0, len(at), step):
            p = at[k : k + step]
            a, b = i[p], j[p]
            overlap = np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64) + np.minimum(excess[a], excess[b])
            overlap = np.minimum(overlap, np.minimum(high[a], high[b]))
            out[p] = (100 + percent) * overlap >= percent * (low[a] + low[b])
        return out

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets that the dual traversal leaves, as indices into the sets given."""
        top = len(self.levels) - 1
        i, j = np.triu_indices(len(self.levels[top][0]))
        todo = [(top, i, j)]
        while todo:
            level, i, j = todo.pop()
            if len(i) > 4096:
                todo += [(level, i[k : k + 4096], j[k : k + 4096]) for k in range(0, len(i), 4096)]
                continue
            if level == 0:
                i, j = i[i < j], j[i < j]
            good = self.may_link(level, i, j, percent)
            i, j = i[good], j[good]
            if level == 0:
                if len(i):
                    yield self.order[i], self.order[j]
                continue
            size, c = len(self.levels[level - 1][0]), np.arange(FAN)
            a = np.broadcast_to((i[:, None, None] * FAN + c[:, None]), (len(i), FAN, FAN)).ravel()
            b = np.broadcast_to((j[:, None, None] * FAN + c[None, :]), (len(i), FAN, FAN)).ravel()
            good = (a <= b) & (b < size) & (a < size)
            if good.any():
                todo.append((level - 1, a[good], b[good]))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: percent of the union's size is reached by the intersection's."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return (100 + percent) * common >= percent * (len(a) + len(b))


def links(sets: list[np.ndarray], label: np.ndarray, percent: int, side: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links that join sets of different labels, as few as connect what is connected. side: only between its values."""
    label = np.unique(label, return_inverse=True)[1]
    if len(sets) == 2:
        found = [(np.array([0]), np.array([1]))]
    elif label.max(initial=0) == 0:
        return
    else:
        found = SignatureTree(sets).pairs(percent)
    for i, j in found:
        if side is not None:
            i, j = i[side[i] != side[j]], j[side[i] != side[j]]
        while len(i):
            differ = label[i] != label[j]
            i, j = i[differ], j[differ]
            for k in range(len(i)):
                if label[i[k]] != label[j[k]] and linked(sets[i[k]], sets[j[k]], percent):
                    yield int(i[k]), int(j[k])
                    label = np.where(label == label[j[k]], label[i[k]], label)
                    break
            else:
                k = len(i)
            i, j = i[k + 1 :], j[k + 1 :]


def _stars(pairs: list[tuple[int, int]], label: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges from labels to the least one of those that the pairs connect."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            above[x], x = above.get(above[x], above[x]), above[x]
        return x

    for i, j in pairs:
        low, high = sorted((top(int(label[i])), top(int(label[j]))))
        if low < high:
            above[high] = low
    return list(above), [top(x) for x in list(above)]


def _class_ids(offsets: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """64 bits that depend on the whole set (of 128 bits of sums, mixed)."""
    sums = []
    for salt in (np.uint64(1), np.uint64(0x5DEECE66D)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashed * np.uint64(2) + salt), dtype=np.uint64)])
        sums.append(total[offsets[1:]] - total[offsets[:-1]])
    return mix(mix(sums[0]) ^ sums[1] * np.uint64(3) ^ np.diff(offsets).astype(np.uint64)).view(np.int64)


def _pick(docs: DataFrame, keys: DataFrame, how: str, on: str = "uid") -> DataFrame:
    """Rows of docs with (left_semi) or without (left_anti) a value among the keys' uid; a broadcast if its size was checked."""
    keys = keys.select(F.col("uid").alias(on))
    return docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, how)


def _join_tasks(rows: DataFrame, percent: int) -> DataFrame:
    """(task, side, label, shingles) to edges (a, b) between the labels that links join in a task.

    Side -1: all pairs of the task, else pairs of different sides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held = None, []

        def done() -> pa.RecordBatch:
            label, side = (np.array([h[k] for h in held], np.int64) for k in range(2))
            pairs = list(links([h[2] for h in held], label, percent, side if side.min() >= 0 and side.max() > 0 else None)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _stars(pairs, label)], ["a", "b"])

        for batch in batches:
            tasks, label, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("task", "label", "side"))
            column = batch.column("shingles")
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(zero_copy_only=False)
            for r in range(len(tasks)):
                if tasks[r] != task:
                    if len(held) > 1:
                        yield done()
                    task, held = tasks[r], []
                held.append((label[r], side[r], flat[ends[r] : ends[r + 1]].copy()))
        if len(held) > 1:
            yield done()

    return rows.select("task", "side", "label", "shingles").repartition("task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _frequent(found: DataFrame) -> DataFrame:
    """(cid) of the shingles that a share FREQUENT of all documents has, by the counts of the slices where they are frequent.

    There are at most 1 / FREQUENT of them for each shingle that an average document has, however many slices there are.
    """
    rows = found.where("uid is not null").count()
    return found.where("uid is null").groupBy("cid").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT * rows).select("cid")


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """As duplicate_classes, with the hash of the row; that is null for rows without a shingle."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("uid"), "text")

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and one without uid, with the count, for each frequent shingle of the slice."""
        for batch in batches:
            for part in slices(batch):
                offsets, hashed = shingle_sets(part.column("text"), width)
                shingle, many = np.unique(hashed, return_counts=True)
                high = many >= max(8, FREQUENT * part.num_rows)
                often = shingle[high].view(np.int64)
                ids = pa.concat_arrays([part.column("doc_id"), pa.nulls(len(often), pa.int64())])
                uids = pa.concat_arrays([part.column("uid"), pa.nulls(len(often), pa.int64())])
                n = np.concatenate([np.diff(offsets), many[high]])
                yield pa.RecordBatch.from_arrays([ids, uids, pa.array(n), pa.array(np.concatenate([_class_ids(offsets, hashed), often]))], ["doc_id", "uid", "n", "cid"])

    found = stage_table(base.mapInArrow(summaries, "doc_id long, uid long, n long, cid long"), "sigtree-sets")
    sets = found.where("uid is not null")
    frequent = np.sort(_frequent(found).toPandas()["cid"].to_numpy(np.int64))
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    classes = sets.where("n > 0").groupBy("cid").agg(F.min("uid").alias("rep"))
    copies = sets.where("n > 0").join(classes, "cid").where("uid <> rep").select("uid").distinct()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles that are counted, and further ones up to the prefix length: rare ones before frequent ones."""
        often = sent.value
        for batch in batches:
            for part in slices(batch):
                offsets, hashed = shingle_sets(part.column("text"), width)
                n, token = np.diff(offsets), hashed.view(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                at = np.minimum(np.searchsorted(often, token), max(0, len(often) - 1))
                late = (often[at] == token).astype(np.int64) * 2 if len(often) else np.zeros(len(token), np.int64)
                late += (late == 0) & (token >= BOUND)
                order = np.lexsort((token, late, row))
                token, late = token[order], late[order]
                kept = np.maximum(np.bincount(row[late == 0], minlength=len(n)), np.minimum(n, _prefix(n, percent)))
                keep = np.arange(len(row)) - offsets[row] < kept[row]
                of = row[keep]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token[keep], _class_ids(offsets, hashed)[of], n[of], kept[of], late[keep])], ["token", "cid", "n", "kept", "late"])

    tokens = _pick(base, copies, "left_anti").select("text").mapInArrow(prefixes, "token long, cid long, n long, kept long, late long")
    same = Window.partitionBy("token")
    counted = tokens.withColumns({"low": F.min("cid").over(same), "high": F.max("cid").over(same), "df": F.count("*").over(same)})
    shared = counted.where("low <> high")
    listed = shared.groupBy("cid", "n", "kept").agg(F.array_sort(F.collect_set(F.struct("late", "df", "token"))).alias("shared"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    open_ = F.greatest(length - (F.col("kept") - F.size("shared")), F.lit(0)).cast("int")
    prefix = stage_table(listed.select("cid", F.explode(F.slice("shared", F.lit(1), open_)).alias("s")).select("cid", F.col("s.token").alias("token")), "sigtree-prefix")

    met = prefix.groupBy("token").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low <> high")
    blocks = stage_table(components(prefix.join(met, "token").select(F.col("cid").alias("a"), F.col("low").alias("b"))), "sigtree-blocks")

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                offsets, hashed = shingle_sets(part.column("text"), width)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(hashed.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(_class_ids(offsets, hashed)), lists], ["cid", "shingles"])

    wanted = blocks.join(classes, blocks["node"] == classes["cid"]).select(F.col("rep").alias("uid"))
    texts = _pick(base, wanted, "left_semi").select("text").mapInArrow(whole_sets, "cid long, shingles array<long>").dropDuplicates(["cid"])
    band = F.floor(F.log(F.size("shingles").cast("double")) / float(np.log(100 / percent) * (1 + 1e-9))).cast("int")  # linked sets are in bands side by side
    members = stage_table(texts.join(blocks, texts["cid"] == blocks["node"]).select("cid", F.col("root").alias("block"), band.alias("band"), F.col("shingles")[0].alias("least"), "shingles"), "sigtree-members")

    narrow = members.select("cid", "block", "band", "least")
    by_band = narrow.groupBy("block", "band").agg(F.count("*").alias("in_band")).withColumn("room", _room(percent))
    by_block = by_band.groupBy("block").agg((F.sum(F.col("in_band") / F.col("room")) > 1).alias("large"))
    sizes = by_band.join(by_block, "block")
    # sets that share their least shingle with more than a node of others, as near copies do
    hot = narrow.groupBy("block", "band", "least").agg(F.count("*").alias("in_least")).join(sizes, ["block", "band"])
    hot = stage_table(hot.where(F.col("large") & (F.col("in_least") > F.col("room"))).select("block", "band", "least", "in_least"), "sigtree-hot")
    part = F.when(~F.col("large"), F.col("block")).when(F.col("in_least").isNull(), F.xxhash64("block", "band", F.pmod("least", F.ceil(F.col("in_band") / F.col("room")))))
    part = part.otherwise(F.xxhash64("block", "band", "least", F.pmod(F.xxhash64("cid"), F.ceil(F.col("in_least") / F.col("room")))))
    first = members.join(sizes, ["block", "band"]).join(hot, ["block", "band", "least"], "left").select(part.alias("task"), F.lit(-1).cast("long").alias("side"), "cid", F.col("cid").alias("label"), "shingles")
    roots = components(_join_tasks(first, percent))

    large = stage_table(narrow.join(by_block.where("large"), "block"), "sigtree-large")
    if large.limit(1).count():
        roots = _between_nodes(large, hot, members, prefix, roots, percent)
    least = sets.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least_id")).join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    of_root = least.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = least.join(of_root, "root").select("cid", "component_id")
    own = sets.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return sets.where("n > 0").join(of_class, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "uid").union(own.select("*", F.lit(None).cast("long").alias("uid")))


def duplicate_classes(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """Of each row of docs (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    A-Z is lower-cased and words are runs without ASCII white space. Null or empty texts, or such without words, have no
    shingle and are linked with nothing: component_id is their own id. Rows that repeat an id are rows of their own; null
    ids don't count for the smallest. No rows give no rows; columns other than doc_id (a number) and text aren't read, so
    they may have any name. Shingles and classes go by 64-bit hashes.
    """
    return _classes(docs, width, percent).drop("uid")


def keep_one(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """docs with one row of each component: that of the smallest id, or any where the ids are null or repeat.

    Rows without a shingle all stay. Columns stay as they are, whatever their names.
    """
    members = stage_table(_classes(docs, width, percent).where("uid is not null").select("doc_id", "component_id", "uid"), "sigtree-members")
    # without any id, a component's rows can't be told apart from those of another such one, so all stay
    first = members.where("component_id is not null").groupBy("component_id").agg(F.min_by("uid", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "uid")).alias("kept"))
    gone = members.join(first, "component_id").where("uid <> kept").select("uid").distinct()
    twice = members.join(first, "component_id").where("uid = kept").groupBy("uid").agg(F.count("*").alias("n")).where("n > 1").select("uid")
    key = fresh("sigtree_uid", docs.columns)
    kept = _pick(docs.withColumn(key, F.xxhash64(docs["doc_id"], docs["text"])), gone, "left_anti", key)
    if twice.limit(1).count():
        kept = _pick(kept, twice, "left_anti", key).union(_pick(kept, twice, "left_semi", key).dropDuplicates([key]))
    return kept.select(docs.columns)


def _room(percent: int):
    """Sets in a node of a band, by the largest size in the band."""
    largest = F.pow(F.lit(100 / percent), F.col("band") + 1)
    return F.greatest(F.lit(1), F.least(F.lit(NODE), F.floor(F.lit(NODE_SHINGLES) / largest)))


def _node_table(placed: DataFrame) -> DataFrame:
    """(node, block, band, low, high): low and high are the least and the largest label in the node."""
    return placed.groupBy("node").agg(F.first("block").alias("block"), F.first("band").alias("band"), F.min("label").alias("low"), F.max("label").alias("high"))


def _pair_links(pairs: DataFrame, placed: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Edges between the labels that links between the pairs (i, j) of nodes join."""
    task = F.xxhash64("i", "j").alias("task")
    sides = pairs.select(F.col("i").alias("node"), task, F.when(F.col("i") == F.col("j"), -1).otherwise(0).cast("long").alias("side"))
    sides = sides.union(pairs.where("i <> j").select(F.col("j").alias("node"), task, F.lit(1).cast("long").alias("side")))
    rows = members.select("cid", "shingles").join(placed.join(sides, "node"), "cid")
    return _join_tasks(rows, percent)


def _relabel(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """placed with the least label of those that the edges connect as the label."""
    roots = components(edges).select(F.col("node").alias("label"), "root")
    joined = placed.join(roots, "label", "left").withColumn("label", F.coalesce("root", "label"))
    return stage_table(joined.select(placed.columns), "sigtree-nodes")


def _between_nodes(large: DataFrame, hot: DataFrame, members: DataFrame, prefix: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Components (node, root) with the links between the nodes of large blocks, from those known without them.

    Sets of a component that fills nodes get nodes of their own. Links join labels, that is known components, so that each
    search for components has only the new edges.
    """
    labelled = large.join(known, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("root", "cid")).drop("node", "root")
    count = labelled.groupBy("block", "band", "label").agg(F.count("*").alias("in_label"))
    count = count.withColumn("own", F.when(F.col("in_label") >= F.ceil(_room(percent) / 4), F.col("label")))
    rest = count.where("own is null").groupBy("block", "band").agg(F.sum("in_label").alias("in_rest"))
    placed = labelled.join(count, ["block", "band", "label"]).join(rest, ["block", "band"], "left").join(hot, ["block", "band", "least"], "left")
    many = F.ceil(F.coalesce(F.when(F.col("own").isNull(), F.col("in_rest")), F.col("in_label")) / _room(percent))
    by = F.when(F.col("own").isNull() & F.col("in_least").isNull(), F.col("least")).otherwise(F.xxhash64("cid"))
    placed = stage_table(placed.select("cid", "label", "block", "band", F.xxhash64("block", "band", F.coalesce("own", F.lit(0)), F.pmod(by, many)).alias("node")), "sigtree-nodes")

    # neighbours first: where near copies fill many nodes, these few pairs make one component of them
    after = Window.partitionBy("block").orderBy("band", "node")
    ahead = _node_table(placed).withColumns({f"next_{c}": F.lead(c).over(after) for c in ("node", "band", "low", "high")})
    ahead = ahead.where("next_band - band <= 1 and not (low = high and next_low = next_high and low = next_low)").select(F.col("node").alias("i"), F.col("next_node").alias("j"))
    placed = _relabel(placed, _pair_links(stage_table(ahead, "sigtree-pairs"), placed, members, percent))

    nodes = _node_table(placed)
    of_token = prefix.join(placed, "cid").select("token", "node", "label")
    # a shingle of one component only can't link anything new
    mixed = of_token.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token")
    of_token = stage_table(of_token.join(mixed, "token").select("token", "node").distinct(), "sigtree-tokens")
    pairs = of_token.alias("x").join(of_token.alias("y"), F.col("x.token") == F.col("y.token")).where("x.node <= y.node").select(F.col("x.node").alias("i"), F.col("y.node").alias("j")).distinct()
    x, y = nodes.select(*[F.col(c).alias(f"{c}_i") for c in nodes.columns]), nodes.select(*[F.col(c).alias(f"{c}_j") for c in nodes.columns])
    pairs = pairs.join(x, F.col("i") == F.col("node_i")).join(y, F.col("j") == F.col("node_j"))
    pairs = stage_table(pairs.where("abs(band_i - band_j) <= 1 and not (low_i = high_i and low_j = high_j and low_i = low_j)").select("i", "j"), "sigtree-pairs")
    found = _relabel(placed, _pair_links(pairs, placed, members, percent)).select(F.col("cid").alias("node"), F.col("label").alias("root"))
    return found.union(known.join(found, "node", "left_anti").select("node", "root"))
