"""Prefix trie of conversations from balanced parentheses.

Conversations are sequences of turns. Sorted by these, they stand in the order of a walk through their trie:
from one to the next, the turns that end close and the turns that begin open. Each shard of neighbours writes
its walk as balanced parentheses (a one opens, a zero closes) with a few numbers for each node in the
order of opening. Everything about a subtree is read from that: ``findclose`` finds its end over blocks
with the least and greatest excess, the nodes between are neighbours, so sums are differences of cumulative
arrays, and leaves are the pairs ``10`` between, counted by rank.

Nodes that a shard shares with the shard beside it, on the paths to its first and last sequence, are known in
part only: these spines are put together from all shards, and the rest is final.

A turn that no other conversation has at its depth, and all that follow it, belong to that conversation alone.
Their nodes need no trie: the sequences end with the first such turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm.ordering import positioned, runs, sorted_parts
from pricewell.llm.tables import whole_text
from pricewell.session import materialized

#: Fixed value: what words are made of.
WORD = r"[^\x20\x09-\x0D]+"
#: Nodes of a shard; its last sequence may add its own.
SHARD_NODES = 1 << 17
#: Positions in a block of the excess.
BLOCK = 64
#: Turns of a sequence by which ranges are cut; sequences that share more are in one range.
SPLIT_TURNS = 24
#: Ids joined into one text before a list of ids is hashed.
CHUNK = 4_096
NONE = hashlib.sha256(b"").hexdigest()
SHARD = "shard long, first array<string>, last array<string>, nodes int, bits binary, words binary, ending binary, least binary, tails binary, ends array<string>"
NODE = "shared boolean, key string, parent_key string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string"
KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def _typed(ddl: str) -> list[tuple[str, pa.DataType]]:
    return [(x.split()[0], KINDS[x.split()[1]]) for x in ddl.split(", ")]


def _batch(ddl: str, columns: list[list]) -> pa.RecordBatch:
    typed = _typed(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, typed, strict=True)], names=[n for n, _ in typed])


class Parentheses:
    """Balanced parentheses with the close of every open one, and what is between."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK) -> None:
        self.bits, self.block = bits, block
        self.excess = np.cumsum(bits.astype(np.int64) * 2 - 1)
        self.opens = np.flatnonzero(bits)
        # the least and greatest excess of each block, and upwards of each pair of blocks
        blocks = -(-len(bits) // block)
        padded = np.full(blocks * block, self.excess[-1] if len(bits) else 0)
        padded[: len(bits)] = self.excess
        by_block = padded.reshape(blocks, block)
        self.size = 1 << max(blocks - 1, 0).bit_length()
        self.low = np.full(2 * self.size, np.iinfo(np.int64).max)
        self.high = np.full(2 * self.size, np.iinfo(np.int64).min)
        self.low[self.size : self.size + blocks], self.high[self.size : self.size + blocks] = by_block.min(axis=1), by_block.max(axis=1)
        at = self.size
        while at > 1:
            self.low[at // 2 : at] = np.minimum(self.low[at : 2 * at : 2], self.low[at + 1 : 2 * at : 2])
            self.high[at // 2 : at] = np.maximum(self.high[at : 2 * at : 2], self.high[at + 1 : 2 * at : 2])
            at //= 2
        pairs = np.zeros(len(bits) + 1, np.int64)
        pairs[1:-1] = np.cumsum(bits[:-1] & ~bits[1:] & 1)
        pairs[-1:] = pairs[-2:-1]
        self.leaf_rank = pairs  # pairs "10" that begin before a position and end at or before it

    def _inside(self, start: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first position from ``start`` to its block's end with the target's excess, or -1."""
        found = np.full(len(start), -1)
        ends = np.minimum((start // self.block + 1) * self.block, len(self.bits))
        waiting, at = np.arange(len(start)), start.copy()
        while True:
            inside = at < ends[waiting]
            waiting, at = waiting[inside], at[inside]
            if not len(waiting):
                return found
            hit = self.excess[at] == target[waiting]
            found[waiting[hit]] = at[hit]
            waiting, at = waiting[~hit], at[~hit] + 1

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The close of each open parenthesis: in its own block, else in the next block that gets as low."""
        target = self.excess[opens] - 1
        found = self._inside(opens + 1, target)
        far = np.flatnonzero(found < 0)
        if not len(far):
            return found
        # an open one at its block's end has nothing left there: its search begins in the next block as well
        node, goal = self.size + opens[far] // self.block, target[far]
        climbing = np.ones(len(far), bool)
        while climbing.any():
            right = climbing & (node % 2 == 0)
            beside = np.where(right, node + 1, node)
            hit = right & (self.low[beside] <= goal) & (goal <= self.high[beside])
            node = np.where(hit, beside, np.where(climbing, node // 2, node))
            climbing &= ~hit
        while (inner := node < self.size).any():
            left = np.where(inner, node * 2, node)
            fits = (self.low[left] <= goal) & (goal <= self.high[left])
            node = np.where(inner, np.where(fits, left, left + 1), node)
        found[far] = self._inside((node - self.size) * self.block, goal)
        return found

    def leaves(self, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
        return self.leaf_rank[closes + 1] - self.leaf_rank[opens]

    def parents(self, closes: np.ndarray) -> np.ndarray:
        """The node around each node, by order of opening; the root has none (-1)."""
        out = np.full(len(self.opens), -1)
        depth = self.excess[self.opens]
        last = {}
        for i, d in enumerate(depth.tolist()):
            out[i] = last.get(d - 1, -1)
            last[d] = i
        return out


def _keys(turns: list[str]) -> list[str]:
    """A key for each prefix of a sequence, the empty one first."""
    keys = ["root"]
    for turn in turns:
        keys.append(hashlib.sha256((keys[-1] + turn).encode()).hexdigest()[:40])
    return keys


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct sequences (part, at, turns, words, n, least, tail, ends) to shards of parentheses."""

    class Shard:
        def __init__(self, number: int) -> None:
            self.number, self.first, self.last = number, None, []
            self.bits = bytearray([1])
            self.words, self.ending, self.least, self.tails, self.ends = [0], [0], [-1], [0], [None]

        def add(self, turns, words, n, least, tail, ends) -> None:
            same = 0
            if self.first is None:
                self.first = turns
            else:
                for a, b in zip(self.last, turns):
                    if a != b:
                        break
                    same += 1
                self.bits.extend(bytes(len(self.last) - same))
            self.bits.extend(b"\x01" * (len(turns) - same))
            new = len(turns) - same
            self.words += words[same:]
            for numbers, inner in ((self.ending, 0), (self.least, -1), (self.tails, 0), (self.ends, None)):
                numbers += [inner] * new
            self.ending[-1], self.least[-1], self.tails[-1], self.ends[-1] = n, least, int(tail), ends
            self.last = turns

        def row(self) -> pa.RecordBatch:
            bits = np.frombuffer(bytes(self.bits) + bytes(len(self.last) + 1), np.uint8)
            numbers = [np.array(x, np.int64).tobytes() for x in (self.words, self.ending, self.least, self.tails)]
            values = [self.number, self.first, self.last, len(self.words), np.packbits(bits).tobytes(), *numbers, self.ends]
            return _batch(SHARD, [[v] for v in values])

    shard = None
    for batch in batches:
        for at, seq, n, least, tail, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard is None or len(shard.words) >= SHARD_NODES:
                if shard:
                    yield shard.row()
                shard = Shard(at)
            shard.add([x["d"] for x in seq], [x["w"] for x in seq], n, least, tail, ends)
    if shard:
        yield shard.row()


def shard_nodes(row: dict) -> pa.RecordBatch:
    """The nodes of a shard: final ones, and what the shard knows of those it shares with others (and of the root)."""
    m = row["nodes"]
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=2 * m)
    words, ending, least, tails = (np.frombuffer(row[c], np.int64) for c in ("words", "ending", "least", "tails"))
    tree = Parentheses(bits)
    opens = tree.opens
    closes = tree.findclose(opens)
    parents = tree.parents(closes)
    depth = tree.excess[opens] - 1
    after = np.cumsum(bits)[closes].astype(np.int64)  # the first node behind the subtree
    nodes = np.arange(m)
    span = lambda values: np.r_[0, np.cumsum(values)][after] - np.r_[0, np.cumsum(values)][nodes]

    # the shared spines: from the root towards the first and the last sequence
    left, right = _keys(row["first"]), _keys(row["last"])
    shared = np.zeros(m, bool)
    shared[: min(len(left), (row["before"] or 0) + 1)] = True
    keys: dict[int, str] = dict(enumerate(left))
    at = m - 1
    while at >= 0:
        keys[at] = right[depth[at]]
        shared[at] |= depth[at] <= (row["after"] or 0)
        at = int(parents[at])

    convs = span(ending)
    own_saved = np.where(shared, 0, (convs - 1) * words)
    saved = span(own_saved)
    leaf = closes == opens + 1
    leaves = tree.leaves(opens, closes) - span(leaf & shared)
    children = np.bincount(parents[1:], minlength=m) + tails
    low = np.where(least < 0, np.iinfo(np.int64).max, least)
    # the root may be a turnless conversation's end, ids may be negative: whether one ends here is told by the count
    low = np.where(ending > 0, least, np.iinfo(np.int64).max)
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for level in np.split(order, cuts):
        inner = level[parents[level] >= 0]
        np.minimum.at(low, parents[inner], low[inner])

    # of shared nodes only what no shared child brings as well
    inner = np.flatnonzero(shared & (parents >= 0))
    own = {"convs": convs.copy(), "saved": saved.copy(), "leaves": leaves.copy(), "children": children.copy()}
    for name, whole in (("convs", convs), ("saved", saved), ("leaves", leaves)):
        np.subtract.at(own[name], parents[inner], whole[inner])
    np.subtract.at(own["children"], parents[inner], 1)
    pick = lambda name, whole: np.where(shared, own[name], whole).tolist()

    above = parents.tolist()
    known = (parents >= 0) & ~shared[parents]
    columns = [
        shared.tolist(),
        [keys[i] if s else None for i, s in enumerate(shared.tolist())],
        [None if p < 0 or k else keys[p] for p, k in zip(above, known.tolist())],
        low.tolist(),
        depth.tolist(),
        [int(low[p]) if k else None for p, k in zip(above, known.tolist())],
        pick("convs", convs),
        pick("children", children),
        pick("leaves", leaves),
        pick("saved", saved),
        words.tolist(),
        row["ends"],
    ]
    return _batch(NODE, columns)


def _spines(rows: pa.Table) -> pa.Table:
    """The shared nodes of all shards, each known in parts summed before, with their subtrees' totals."""
    data = rows.to_pydict()
    m = len(data["key"])
    index = {k: i for i, k in enumerate(data["key"])}
    parents = np.array([index.get(k, -1) if k else -1 for k in data["parent_key"]], np.int64)
    depth, words = np.array(data["depth"], np.int64), np.array(data["words"], np.int64)
    convs, saved, leaves, children = (np.array(data[c], np.int64) for c in ("n_convs", "saved_tokens", "n_leaves", "n_children"))
    inner = np.flatnonzero(parents >= 0)
    np.add.at(children, parents[inner], 1)
    leaves += children == 0
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        saved[level] += (convs[level] - 1) * words[level]
        below = level[parents[level] >= 0]
        for total in (convs, saved, leaves):
            np.add.at(total, parents[below], total[below])
    ids = np.array(data["conv_id"], np.int64)
    columns = [
        [True] * m, data["key"], data["parent_key"], ids.tolist(), depth.tolist(),
        [int(ids[p]) if p >= 0 else None for p in parents.tolist()],
        convs.tolist(), children.tolist(), leaves.tolist(), saved.tolist(), words.tolist(), data["ends_sha256"],
    ]
    return pa.Table.from_batches([_batch(NODE, columns)])


def trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of sequences: seq (array of struct d string, w int), n, least, tail, ends; all different.

    ``n`` conversations, the smallest of which is ``least``, end with the sequence, or go on alone behind it (tail).
    """
    begin = F.transform(F.slice("seq", 1, SPLIT_TURNS), lambda x: x["d"])
    ordered = sequences.withColumn("begin", begin).repartitionByRange("begin").sortWithinPartitions("seq")
    ordered = ordered.select(F.monotonically_increasing_id().alias("at"), "seq", "n", "least", "tail", "ends")
    shards = materialized(ordered.mapInArrow(_encoded, SHARD), "shards")

    # how many turns a shard's last sequence shares with the next shard's first one; both kinds of ends are read alone
    by_shard = Window.orderBy("shard")  # one short row a shard

    def common(a, b):
        same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
        stop = F.array_position(same, False)
        return F.when(a.isNotNull() & b.isNotNull(), F.when(stop == 0, F.size(same)).otherwise(stop - 1).cast("int"))

    beside = shards.select("shard", "first", "last", F.lag("last").over(by_shard).alias("prior"), F.lead("first").over(by_shard).alias("next"))
    beside = beside.select("shard", common(F.col("prior"), F.col("first")).alias("before"), common(F.col("last"), F.col("next")).alias("after"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield shard_nodes(batch.slice(i, 1).to_pylist()[0])

    nodes = materialized(shards.join(beside, "shard").mapInArrow(run, NODE), "nodes")
    parts = nodes.where("shared").groupBy("key", "parent_key", "depth", "words")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spines = parts.agg(F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"), *sums)

    def join_spines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from _spines(pa.Table.from_batches(held)).to_batches()

    # a few nodes for each border between shards
    whole = materialized(spines.repartition(1).mapInArrow(join_spines, NODE), "spines")
    final = nodes.where(~F.col("shared"))
    ids = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of_spine"))
    final = final.join(ids, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "of_spine"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return final.select(*columns).union(whole.select(*columns)).fillna(NONE, ["ends_sha256"])


def id_list_digests(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key and the SHA-256 of its values in ascending order, joined by commas.

    The values are sorted and joined to chunks in ranges, however many a key has. A digest is one pass over its text by
    nature: a task reads a key's chunks one by one and holds none.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, out = None, 0, [], []
        for batch in batches:
            for k, v, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now or len(held) >= CHUNK:
                    if held:
                        out.append((now, first, ",".join(held)))
                    now, first, held = k, at, []
                held.append(str(v))
            yield _batch("key string, at long, ids string", list(zip(*out)) or [[], [], []])
            out = []
        if held:
            yield _batch("key string, at long, ids string", [[now], [first], [",".join(held)]])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = k, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _batch("key string, ends string", list(zip(*out)) or [[], []])
        if now is not None:
            yield _batch("key string, ends string", [[now], [digest.hexdigest()]])

    placed = rows.select(F.col(key).alias("key"), F.col(value).alias("value")).repartitionByRange("key", "value").sortWithinPartitions("key", "value")
    joined = placed.withColumn("at", F.monotonically_increasing_id()).mapInArrow(chunks, "key string, at long, ids string")
    return joined.repartition("key").sortWithinPartitions("key", "at").mapInArrow(hashed, "key string, ends string")


def rebuilt(conversations: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, depth, d, w) and conversations (conv_id, turns) with shared beginnings.

    Conversation c begins with the first h turns of conversation ``c - c % every`` (``%`` keeps the sign of c) and goes
    on with its own behind its first h; h is the CRC-32 of c's decimal digits modulo ``heads``. ``d`` is a digest of
    role and text, ``w`` the number of words.
    """
    role, text = whole_text("role"), whole_text("text")
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.substring(F.sha2(told, 256), 1, 40).alias("d"),
        F.regexp_count(text, F.lit(WORD)).alias("w"),
    )
    placed = sorted_parts(turns, ["conv_id"], ["turn", "role", "d"], "turns")
    found = materialized(runs(placed, ["conv_id"]), "runs")
    whole = found.select("conv_id", F.col("group_rows").alias("own")).distinct()
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    bases = whole.select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    begun = whole.select("conv_id", "own", h, base).join(bases, "base", "left")
    begun = begun.withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    begun = materialized(begun, "beginnings")

    numbered = positioned(placed, found.join(begun.select("conv_id", "h", "taken"), "conv_id"), ["conv_id"])
    rest = numbered.where("position >= h").select("conv_id", "part", (F.col("position") - F.col("h") + F.col("taken") + 1).alias("depth"), "d", "w")
    first = numbered.where(F.col("position") < heads - 1).where(F.col("conv_id") % every == 0)
    first = first.select(F.col("conv_id").alias("base"), "position", "d", "w")
    taken = begun.select("conv_id", "base", "taken").join(first, "base").where("position < taken")
    taken = taken.select("conv_id", F.lit(-1).cast("long").alias("part"), (F.col("position") + 1).alias("depth"), "d", "w")
    counts = begun.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns"))
    return materialized(rest.union(taken), "rebuilt"), materialized(counts, "lengths")


def prefix_nodes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations given as turns (conv_id, part, depth, d, w) and lengths.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256. A long
    conversation may be spread over parts.
    """
    alone = turns.groupBy("depth", "d").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).where("n = 1")
    cuts = alone.groupBy("conv_id").agg(F.min("depth").alias("cut"))
    convs = materialized(lengths.join(cuts, "conv_id", "left").withColumn("cut", F.coalesce("cut", "turns")), "cuts")
    # the cut comes to the turns by part as well, so that a long conversation is no hot key
    spread = turns.select("conv_id", "part").distinct().join(convs, "conv_id")
    cut = turns.join(spread, ["conv_id", "part"])

    last = F.col("depth") == F.col("turns")
    alone_nodes = cut.where(F.col("depth") > F.col("cut")).select(
        "conv_id",
        "depth",
        F.col("conv_id").alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NONE)).alias("ends_sha256"),
    )
    trunk = cut.where(F.col("depth") <= F.col("cut")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "d", "w"))).alias("s"))
    seq = F.transform("s", lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w")))
    none = F.array().cast("array<struct<d:string,w:int>>")
    sequences = convs.join(trunk, "conv_id", "left").select("conv_id", F.coalesce(seq, none).alias("seq"), (F.col("turns") > F.col("cut")).alias("tail"))
    sequences = sequences.withColumn("key", F.sha2(F.array_join(F.transform("seq", lambda x: x["d"]), ""), 256))
    sequences = materialized(sequences, "sequences")
    classes = sequences.groupBy("key", "seq").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.max("tail").alias("tail"))
    ends = id_list_digests(sequences.where(~F.col("tail")), "key", "conv_id")
    return trie(classes.join(ends, "key", "left").drop("key")).union(alone_nodes)


def conversation_trie(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """The nodes of the trie of conversations rebuilt with shared beginnings (``rebuilt``), as ``prefix_nodes``.

    Turns are ordered by turn, null first, then by role and digest of the text. Null roles and texts are empty; equal rows
    are turns of their own. Rows without a conv_id take no part, an empty table has no nodes, and a
    conversation without turns ends at the root. Further columns are ignored.
    """
    return prefix_nodes(*rebuilt(conversations, every, heads))
