"""Exact dedup by sorting the contents.

Sampled splitters cut the order of the normalised texts into ranges: by the first characters, then
by digest, and a text with very many copies is cut further by id. Every range is sorted externally, and one pass over a range compares each
text in full with its neighbour. Runs that a splitter cut meet again through the texts at the ends
of the ranges, at most two for a range, which are compared in full as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewell.llm.tables import id_filter, key_of, parted_by_filter, whole_text
from pricewell.session import materialized

#: The characters that do not count.
IGNORED = r"[\x20\x09-\x0D]+"
SORTED = "doc_id long, text_sha256 string, run long, keep_id long, group_size long, first boolean, edge string"
NAMES = [x.split()[0] for x in SORTED.split(", ")]
TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
#: Splitters are short: so many characters of a text, then its digest.
PREFIX = 32


class _Runs:
    """Rows of closed runs, handed out in batches."""

    def __init__(self, part: int) -> None:
        self.run = part << 40
        self.rows: list[list] = [[] for _ in NAMES]

    def close(self, ids: list, digest: str, edge: str | None) -> None:
        """Adds the rows of a run; the row that stays comes first."""
        n = len(ids)
        new = (ids, [digest] * n, [self.run] * n, [ids[0]] * n, [n] * n, [True] + [False] * (n - 1), [edge] + [None] * (n - 1))
        for column, values in zip(self.rows, new, strict=True):
            column += values
        self.run += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, [[] for _ in NAMES]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, TYPES, strict=True)], names=NAMES)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finds the runs of equal neighbours in one sorted range; only the ids of the open run are held."""
    found = _Runs(TaskContext.get().partitionId())
    text, ids, digest, first = None, [], "", True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        doc_ids, texts, digests = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
        same = pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(~same.astype(bool)) + 1).tolist()]
        for at, end in zip(starts, [*starts[1:], n], strict=True):
            if at == 0 and text is not None and texts[0].as_py() == text:
                ids += doc_ids[:end]
                continue
            if ids:
                found.close(ids, digest, text if first else None)
                first = False
            # the text itself is needed at the end of a batch and of the range only
            text = texts[at].as_py() if first or end == n else None
            ids, digest = doc_ids[at:end], digests[at].as_py()
        if len(found.rows[0]) > 10_000:
            yield found.batch()
    if ids:
        found.close(ids, digest, text)
    yield found.batch()


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space. Of equal texts the row with the
    most code points in the original text stays, then the one with the smallest id (null ids
    last); of wholly equal rows one stays. Null texts count as empty, and empty texts are equal to
    each other. Further columns are ignored. ``text_sha256`` is the digest of the text without
    white space.
    """
    text = whole_text(text_col)
    norm = F.regexp_replace(text, IGNORED, "")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), norm.alias("norm"), (-F.length(text)).alias("shorter")
    ).withColumn("digest", F.sha2("norm", 256))
    split = [F.substring("norm", 1, PREFIX), "digest", "shorter", F.asc_nulls_last("doc_id")]
    order = [*split[:2], "norm", *split[2:]]
    ranges = rows.repartitionByRange(*split).sortWithinPartitions(*order)
    found = materialized(ranges.select("doc_id", "norm", "digest").mapInArrow(_runs, SORTED), "content-runs")
    # runs at the ends of ranges: the same text in several ranges is one group, and its best row is
    # that of the first range, because the ranges are in the order in which rows are preferred
    ends = found.where(F.col("edge").isNotNull()).select("run", "keep_id", "group_size", "edge")
    whole = ends.groupBy("edge").agg(
        F.min(F.struct("run", "keep_id")).alias("best"), F.sum("group_size").alias("size"), F.collect_list("run").alias("runs")
    )
    mended = (
        whole.where(F.size("runs") > 1)
        .select(F.explode("runs").alias("run"), F.col("best.run").alias("first_run"), F.col("best.keep_id").alias("best_id"), "size")
    )
    # at most two rows for a range
    return found.join(F.broadcast(mended), "run", "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("keep_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", "group_size").alias("group_size"),
        (F.col("first") & (F.col("size").isNull() | (F.col("first_run") == F.col("run")))).alias("kept"),
        "text_sha256",
    )


def surviving(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that share an id and a text one stays.

    A row whose id occurs in no group of copies stays without more ado: a filter of the ids in groups tells
    that, and no text of it is shuffled. For the others the kept ids are joined back. Where several rows
    have the id of a kept one, those whose text has the kept digest are numbered and the first is taken.
    """
    found = duplicates(docs, id_col, text_col)
    bits = id_filter(found.where("group_size > 1"))
    kept, _ = parted_by_filter(found.where("kept").select("doc_id", "text_sha256"), bits)
    wanted = kept.groupBy("doc_id").agg(F.collect_set("text_sha256").alias("__digests")).select(
        key_of("doc_id").alias("__key"), "__digests"
    )
    in_groups, single = parted_by_filter(docs, bits, id_col)
    digest = F.sha2(F.regexp_replace(whole_text(text_col), IGNORED, ""), 256)
    rows = in_groups.withColumn("__key", key_of(id_col)).join(wanted, "__key").withColumn("__digest", digest)
    same_text = Window.partitionBy("__key", "__digest").orderBy(F.desc(F.length(whole_text(text_col))))
    chosen = (
        rows.where(F.array_contains("__digests", F.col("__digest")))
        .withColumn("__n", F.row_number().over(same_text))
        .where("__n = 1")
        .select(*docs.columns)
    )
    return single.unionByName(chosen)
