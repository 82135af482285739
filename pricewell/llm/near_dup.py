"""MinHash near-dedup with fast similarity sketching.

A sketch has K coordinates. In each of the first K rounds every shingle is hashed to one random
coordinate and offers the round's number plus a random fraction; in each of the next K rounds all
shingles go to the one coordinate of that round. A coordinate keeps its least offer. So every
coordinate fills, after one or few rounds for a large set and after 2K rounds for any, and two sets
agree in a coordinate with the probability of their similarity, concentrated as K independent hashes.

Sketches are cut into bands; documents that agree in a band meet in a bucket. Buckets only
say which documents are worth comparing: every link is confirmed on full shingle sets, which are
built anew from the texts of the documents that met. The steps never write out the pairs
of a bucket or a group, but spanning edges: at most one for each member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.components import components
from pricewell.llm.tables import byte_batches, id_filter, kept_in_worker, parted_by_filter, text_ranges, whole_text
from pricewell.session import materialized

COORDINATES = 128
#: The chance that a linked pair of documents at the threshold meets in no band.
MISS = 1e-6
#: Members of a bucket whose sketches are compared with each other; in a larger one all members are taken as alike.
BUCKET_MEMBERS = 4_096
#: Members of a group that are compared in one task; a larger group is compared in pairs of such blocks.
BLOCK_MEMBERS = 1_024
#: Texts are turned into sets so many bytes at a time.
TEXT_BYTES = 4_000_000
#: Shingles are sketched so many at a time; a larger set is cut, and the least offers of its pieces count.
SKETCHED = 100_000
U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Texts to sets of hashed shingles; the hashes of words are remembered."""

    remembered = 100_000

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        """The sorted distinct shingles: with fewer words than a shingle has, all of them as one.

        A-Z are lower-cased and words are what ASCII white space separates.
        """
        tokens = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
        if not tokens:
            return np.zeros(0, U)
        if len(self.known) > self.remembered:
            self.known.clear()
        known = self.known
        for token in set(tokens).difference(known):
            known[token] = xxhash.xxh3_64_intdigest(token)
        h = np.fromiter(map(known.__getitem__, tokens), U, len(tokens))
        size = min(self.words, len(h))
        n = len(h) - size + 1
        out = np.full(n, size, U)
        for i in range(size):
            out = _mixed(out * U(0x9E3779B97F4A7C15) + h[i : i + n])
        return np.unique(out)


def sketches(sets: list[np.ndarray], k: int = COORDINATES) -> np.ndarray:
    """The sketch of each non-empty set, as a byte for each coordinate."""
    offers = np.full((len(sets), k), np.iinfo(U).max, U)
    pieces = [(i, s[at : at + SKETCHED]) for i, s in enumerate(sets) for at in range(0, len(s), SKETCHED)]
    for start, end in byte_batches([len(s) for _, s in pieces], SKETCHED):
        # only the last piece of a set shares a batch, so no set is in a batch twice
        of = [i for i, _ in pieces[start:end]]
        offers[of] = np.minimum(offers[of], _least_offers([s for _, s in pieces[start:end]], k))
    return (_mixed(offers) >> U(56)).astype(np.uint8)


def _least_offers(sets: list[np.ndarray], k: int) -> np.ndarray:
    offers = np.full(len(sets) * k, np.iinfo(U).max, U)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    items = np.concatenate(sets)
    open_ = np.ones(len(sets), bool)
    for turn in range(2 * k):
        if not open_.any():
            break
        inside = open_[owner]
        owner, items = owner[inside], items[inside]
        h = _mixed(items + U((turn * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF))
        place = (h >> U(40)) % U(k) if turn < k else U(turn - k)
        # the round's number above a fraction of 48 bits, so that an earlier round always wins
        offer = (U(turn) << U(48)) | (_mixed(h ^ U(0xA0761D6478BD642F)) >> U(16))
        np.minimum.at(offers, owner * k + place.astype(np.int64), offer)
        open_ &= (offers.reshape(-1, k) == np.iinfo(U).max).any(axis=1)
    return offers.reshape(-1, k)


@dataclass(frozen=True)
class Similarity:
    """What counts as alike: shingles of so many words, and 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def rows(self) -> int:
        """Rows of a band: the most with which a pair at the threshold is missed rarely enough."""
        s = self.percent / 100
        return max(r for r in range(1, 17) if r == 1 or (1 - s**r) ** (COORDINATES // r) <= MISS)

    def agreeing(self) -> int:
        """Coordinates in which a pair at the threshold agrees but for a chance as small as a miss."""
        s = self.percent / 100
        return math.floor(COORDINATES * s - 5 * math.sqrt(COORDINATES * s * (1 - s)))

    def alike(self, common: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
        return 100 * common >= self.percent * (size + sizes - common)


def _forest(n: int, neighbours) -> list[tuple[int, int]]:
    """Edges from the least member of each connected part to its others.

    ``neighbours(x, rest)`` says which of the members in rest are next to x. Members found are
    asked in turn, each about the members not found yet only.
    """
    rest = np.arange(n)
    edges = []
    while len(rest):
        root, rest = rest[0], rest[1:]
        waiting = [root]
        while waiting and len(rest):
            hit = neighbours(waiting.pop(), rest)
            found = rest[hit]
            rest = rest[~hit]
            waiting += found.tolist()
            edges += [(int(root), int(x)) for x in found]
    return edges


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Neighbouring rows with the same key as one table; only one group is held."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts, cuts[1:]):
            if held and keys[start] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = keys[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield now, pa.Table.from_batches(held)


def signed(docs: DataFrame, like: Similarity, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set and sketch (null for an empty set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = kept_in_worker(("shingles", like.words), lambda: Shingler(like.words))
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            for start, end in text_ranges(raw, TEXT_BYTES):
                sets = [shingles(x) for x in raw.slice(start, end - start).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                digests, marks = [None] * len(sets), [None] * len(sets)
                for i, mark in zip(full, sketches([sets[i] for i in full]), strict=True):
                    digests[i], marks[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), mark.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(marks, pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "sketch"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketch binary")


def plausible(classes: DataFrame, like: Similarity) -> DataFrame:
    """Edges (a, b) that join all classes whose sketches agree in a band and nearly enough altogether.

    A bucket's members are compared by their sketches, and spanning edges are kept. The
    members of a bucket beyond ``BUCKET_MEMBERS`` are joined without a look: nothing is lost by that,
    the full comparison only has a larger group to look at.
    """
    r, least = like.rows(), like.agreeing()
    bands = F.sequence(F.lit(0), F.lit(COORDINATES // r - 1))
    key = F.transform(bands, lambda i: F.xxhash64(i, F.substring(F.col("sketch"), i * r + 1, F.lit(r))))
    buckets = classes.select(F.explode(key).alias("bucket"), "id")
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).where("n > 1")
    met = materialized(buckets.join(sizes, "bucket").select("bucket", "id", "n", "least"), "buckets")
    large = met.where((F.col("n") > BUCKET_MEMBERS) & (F.col("id") != F.col("least"))).select(F.col("least").alias("a"), F.col("id").alias("b"))
    pairs = met.where("n = 2 and id != least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    small = met.where(F.col("n").between(3, BUCKET_MEMBERS)).select("bucket", "id")
    sketch = classes.select("id", "sketch")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in (2, 3))
            near = pa.array((one == two).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, rows in _grouped(batches, "bucket"):
            ids = rows.column("id").to_numpy()
            order = np.argsort(ids)
            marks = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)[order]
            ids = ids[order]
            for x, y in _forest(len(ids), lambda x, rest, m=marks: (m[rest] == m[x]).sum(axis=1) >= least):
                a.append(ids[x])
                b.append(ids[y])
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    by_two = (
        pairs.join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("s")), "a")
        .join(sketch.select(F.col("id").alias("b"), F.col("sketch").alias("t")), "b")
        .select("a", "b", "s", "t")
        .mapInArrow(agree, "a long, b long")
    )
    by_many = small.join(sketch, "id").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")
    return by_two.union(by_many).union(large)


def confirmed(docs: DataFrame, groups: DataFrame, like: Similarity, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) that join what is linked inside each group of plausible classes, by full sets.

    ``groups`` has id, digest and component. The texts of the groups' classes are read once more; a filter of
    the classes' ids keeps nearly all others from being shuffled. A group
    of more than ``BLOCK_MEMBERS`` classes is cut into blocks by a hash, and all pairs of blocks
    are compared, each in one task.
    """
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / F.lit(BLOCK_MEMBERS // 2)).cast("int")
    cut = (
        groups.join(sizes, "component")
        .withColumn("parts", F.when(F.col("n") <= BLOCK_MEMBERS, F.lit(1)).otherwise(parts))
        .withColumn("part", F.pmod(F.xxhash64("id", F.lit("block")), F.col("parts")).cast("int"))
    )
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    task = F.transform(others, lambda p: F.xxhash64("component", F.least("part", p), F.greatest("part", p)))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    wanted, _ = parted_by_filter(texts, id_filter(groups, "id"), "id")
    rows = (
        wanted.join(cut.select("id", "digest", "component", task.alias("tasks")), "id")
        .select("component", F.explode("tasks").alias("task"), "id", "digest", "text")
        .repartition("task")
        .sortWithinPartitions("task", "id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = kept_in_worker(("shingles", like.words), lambda: Shingler(like.words))
        for _, group in _grouped(_with_sets(batches, shingles), "task"):
            members = {}
            for key in zip(*(group.column(c).to_pylist() for c in ("id", "digest", "set")), strict=True):
                members.setdefault(key[:2], key[2])
            ids = np.array([i for i, _ in members])
            edges = _forest(len(ids), _linked([np.frombuffer(x, U) for x in members.values()], like))
            if edges:
                x, y = np.array(edges).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[x], pa.int64()), pa.array(ids[y], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _with_sets(batches: Iterator[pa.RecordBatch], shingles: Shingler) -> Iterator[pa.RecordBatch]:
    """Rows with their shingle set in place of the text; rows whose set is not the class's are left out."""
    for batch in batches:
        raw = batch.column("text").cast(pa.binary())
        for start, end in text_ranges(raw, TEXT_BYTES):
            part = batch.slice(start, end - start)
            sets = [shingles(x).tobytes() for x in raw.slice(start, end - start).to_pylist()]
            own = [xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, part.column("digest").to_pylist(), strict=True)]
            keep = pa.array(own, pa.bool_())
            columns = [part.column(c) for c in ("task", "id", "digest")] + [pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["task", "id", "digest", "set"])


def _linked(sets: list[np.ndarray], like: Similarity):
    """Which members are linked to one, from an index of the members of each shingle."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(place, kind="stable")
    owner = owner[order]
    starts = np.searchsorted(place[order], np.arange(len(values) + 1))
    bounds = np.r_[0, np.cumsum(sizes)]
    places = place  # of the concatenated sets

    def neighbours(x: int, rest: np.ndarray) -> np.ndarray:
        mine = places[bounds[x] : bounds[x + 1]]
        spans = starts[mine + 1] - starts[mine]
        at = np.repeat(starts[mine] - np.r_[0, np.cumsum(spans)[:-1]], spans) + np.arange(spans.sum())
        common = np.bincount(owner[at], minlength=len(sizes))[rest]
        return like.alike(common, sizes[x], sizes[rest])

    return neighbours


def near_duplicates(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where their shingle sets are alike; ``component_id`` is the smallest doc_id that can
    be reached over links, the document's own included, and the document with that id is kept. Equal sets
    are linked without a comparison. Null and empty texts have no shingles and are linked with nothing.
    Rows that share a doc_id are one document, linked to whatever any of them is linked to; a row without an
    id is linked to nothing, and kept. Further columns are ignored.
    """
    rows = materialized(signed(docs, like, id_col, text_col), "sketches")
    linkable = rows.where("digest is not null and doc_id is not null")
    classes = linkable.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"))
    classes = materialized(classes, "classes")
    found = components(plausible(classes, like)).select(F.col("node").alias("id"), "component")
    groups = materialized(classes.select("id", "digest").join(found, "id"), "groups")
    links = confirmed(docs, groups, like, id_col, text_col)
    # a document whose rows have several sets holds their classes together
    several = linkable.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x != y")
    held = (
        linkable.join(several.select("doc_id"), "doc_id", "left_semi")
        .join(classes.select("digest", "id"), "digest")
        .select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    )
    joined = components(links.union(held)).select(F.col("node").alias("id"), "component")
    of_class = classes.select("digest", "id").join(joined, "id", "left").select("digest", F.coalesce("component", "id").alias("found"))
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.coalesce("found", "doc_id"))
    return (
        rows.join(of_class, "digest", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
