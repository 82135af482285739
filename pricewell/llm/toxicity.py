"""Toxicity by a chain of classifiers.

The chain predicts its categories one after the other with linear models (logistic regression) over
the words of a text; each model also sees the probabilities of all categories before its own. For
training these come from models that have not seen the row (out of fold), for prediction from the
models of the whole sample. The labelled sample, the number of features and so the model are bounded;
the scored documents are not, and they never leave their partitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewell.llm.tables import sampled, sent_to_python, text_ranges, whole_text, with_fields
from pricewell.session import materialized

#: The chain over the labels of the sample tables: harmful in either way, of low quality, toxic.
CATEGORIES = ["harmful", "low_quality", "toxic"]
#: At most so many labelled rows train the chain, the first by a hash of their id.
MOST_LABELLED = 8_000
#: At most so many features a category; each must be this significant (log-likelihood ratio) and in so many rows.
MOST_FEATURES, LEAST_RATIO, LEAST_ROWS = 600, 6.0, 2
FOLDS = 4
#: Lengths of beginnings, and those that count from the first word on.
PREFIXES, SHORT_PREFIXES = (4, 5, 6, 7, 8), (4, 5)
#: Texts are scored so many bytes at a time.
TEXT_BYTES = 2_000_000
WORD = re.compile(r"[^\W\d_]+")
MARK, UPPER = re.compile(r"[^\w\s]"), re.compile("[A-Z\xc0-\xde]")


def features(text: str, wanted: dict[int, set[str]] | None = None) -> set[str]:
    """Words in lower case, beginnings of words, and classes of the text's shape and size.

    A beginning counts from its first word on if it is short, and from the second and third
    different word that has it whatever its length: word forms with a common stem. ``wanted`` has the
    beginnings, by length, that matter to the caller; others may be left out.
    """
    words = set(WORD.findall(text.lower()))
    found = set(words)
    for size in PREFIXES:
        known = None if wanted is None else wanted.get(size)
        if wanted is not None and not known:
            continue
        seen: dict[str, int] = {}
        for word in words:
            if len(word) > size:
                start = word[:size]
                if known is None or start in known:
                    seen[start] = seen.get(start, 0) + 1
        for start, n in seen.items():
            if size in SHORT_PREFIXES:
                found.add(f"{start}*1")
            if n > 1:
                found.add(f"{start}*2")
            if n > 2:
                found.add(f"{start}*3")
    n = max(1, len(text))
    marks, upper, tokens = len(MARK.findall(text)), len(UPPER.findall(text)), max(1, len(text.split()))
    found |= {f"#marks{20 * marks // n}", f"#upper{10 * upper // n}", f"#kinds{10 * len(words) // tokens}"}
    found |= {f"#size{i}" for i in range(4, tokens.bit_length())}
    return found


@dataclass
class Link:
    """One model of the chain: weights of features, then of the categories before, and the intercept."""

    weights: np.ndarray
    before: np.ndarray
    intercept: float

    def probability(self, rows: np.ndarray, columns: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        z = np.bincount(rows, self.weights[columns], minlength=n) + earlier @ self.before + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_link(rows: np.ndarray, columns: np.ndarray, earlier: np.ndarray, y: np.ndarray, size: int, steps: int = 200) -> Link:
    """Logistic regression with a small ridge on sparse 0/1 features, by gradient steps with momentum (Adam)."""
    n, k = earlier.shape
    if not n or y.min() == y.max():
        rate = min(max(float(y.mean()) if n else 0.0, 1e-6), 1 - 1e-6)
        return Link(np.zeros(size), np.zeros(k), float(np.log(rate / (1 - rate))))
    w = np.zeros(size + k + 1)
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    first, second = np.zeros_like(w), np.zeros_like(w)
    ridge = np.r_[np.full(size + k, 0.5 / n), 0.0]
    for step in range(1, steps + 1):
        link = Link(w[:size], w[size:-1], w[-1])
        off = (link.probability(rows, columns, n, earlier) - y) / n
        slope = np.r_[np.bincount(columns, off[rows], minlength=size), off @ earlier, off.sum()] + ridge * w
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        w = w - 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Link(w[:size], w[size:-1], float(w[-1]))


@dataclass
class Chain:
    """Features and the models of the categories, in the order in which they feed each other."""

    categories: list[str]
    place: dict[str, int]
    links: list[Link]

    def __post_init__(self) -> None:
        self.wanted: dict[int, set[str]] = {}
        for name in self.place:
            if name[-2:-1] == "*":
                self.wanted.setdefault(len(name) - 2, set()).add(name[:-2])

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """A row of probabilities for each text, a column for each category."""
        hits = [[self.place[f] for f in features(t, self.wanted) if f in self.place] for t in texts]
        rows = np.repeat(np.arange(len(texts)), np.array([len(h) for h in hits], np.int64))
        columns = np.array([c for h in hits for c in h], dtype=np.int64)
        out = np.zeros((len(texts), 0))
        for link in self.links:
            out = np.c_[out, link.probability(rows, columns, len(texts), out)]
        return out


def fit_chain(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, folds: np.ndarray, size: int) -> list[Link]:
    """The models of all categories. A missing label (NaN) leaves the row out of that category's model."""
    n = len(labels)
    links: list[Link] = []
    unseen = np.zeros((n, 0))

    def part(keep: np.ndarray, y: np.ndarray) -> Link:
        place = np.cumsum(keep) - 1
        inside = keep[rows]
        return fit_link(place[rows[inside]], columns[inside], unseen[keep], y[keep], size)

    for category in range(labels.shape[1]):
        y = labels[:, category]
        known = ~np.isnan(y)
        out_of_fold = np.zeros(n)
        for fold in range(FOLDS):
            model = part(known & (folds != fold), y)
            held = model.probability(rows, columns, n, unseen)
            out_of_fold[folds == fold] = held[folds == fold]
        links.append(part(known, y))
        unseen = np.c_[unseen, out_of_fold]
    return links


def labelled_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """The bounded labelled sample: doc_id, text and a 0/1 (or null) column for each category.

    A document labelled several times takes its worst label. Ids are taken by a hash; of the rows that share an
    id the first in the order of texts is trained on, so the sample has as many rows as ids.
    """
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    low = (F.col("quality") < 1).cast("double")
    toxic = (F.col("toxic") > 0).cast("double")
    some = worst.select(
        "doc_id", F.greatest(low, toxic).alias("harmful"), low.alias("low_quality"), toxic.alias("toxic")
    )
    sample = sampled(some, "doc_id", most)
    # the sample is bounded by its parameter
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id")
    flags = ("harmful", "low_quality", "toxic")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.max(c).alias(c) for c in flags])


def trained(labelled: DataFrame, categories: list[str] = CATEGORIES) -> Chain:
    """Fits the chain on labelled rows: ``doc_id``, ``text`` and a column for each category."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, end in text_ranges(whole.column(1), TEXT_BYTES):
                batch = whole.slice(start, end - start)
                found = [sorted(features(t)) for t in batch.column(1).to_pylist()]
                flags = [batch.column(i + 2) for i in range(len(categories))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(found, pa.list_(pa.string())), *flags], names=["doc_id", "features", *categories]
                )

    flags = ", ".join(f"{c} double" for c in categories)
    rows = labelled.select("doc_id", "text", *(F.col(c).cast("double").alias(c) for c in categories))
    sample = materialized(rows.mapInArrow(words, f"doc_id long, features array<string>, {flags}"), "labelled")
    totals = sample.agg(
        *[F.sum(c).alias(c) for c in categories], *[F.count(c).alias(f"n_{c}") for c in categories]
    ).first()
    counts = (
        sample.select(F.explode("features").alias("feature"), *categories)
        .groupBy("feature")
        .agg(*[F.sum(c).alias(c) for c in categories], *[F.count(c).alias(f"n_{c}") for c in categories])
    )
    chosen: dict[str, int] = {}
    for c in categories:
        positive, all_rows = float(totals[c] or 0), float(totals[f"n_{c}"] or 0)
        if not 0 < positive < all_rows:
            continue
        a, n = F.col(c), F.col(f"n_{c}")
        part = lambda seen, of, share: F.when(seen > 0, seen * F.log(seen / (of * share))).otherwise(0.0)
        rate = positive / all_rows
        rest = F.lit(all_rows) - n
        ratio = 2 * (
            part(a, n, rate) + part(n - a, n, 1 - rate) + part(positive - a, rest, rate) + part(all_rows - positive - n + a, rest, 1 - rate)
        )
        best = (
            counts.where((n >= LEAST_ROWS) & (a / n > rate))
            .select("feature", ratio.alias("ratio"))
            .where(F.col("ratio") >= LEAST_RATIO)
            .orderBy(F.desc("ratio"), "feature")
            .limit(MOST_FEATURES)
        )
        for row in best.collect():
            chosen.setdefault(row.feature, len(chosen))
    names = F.array(*[F.lit(x) for x in chosen]) if chosen else F.array().cast("array<string>")
    # bounded: the sample's rows, of each the chosen features
    got = sample.select(
        F.pmod(F.xxhash64(F.array_join("features", " ")), F.lit(FOLDS)).alias("fold"),
        F.array_intersect("features", names).alias("features"),
        *categories,
    ).collect()
    got.sort(key=lambda r: (r.features, r.fold))
    row = np.repeat(np.arange(len(got)), np.array([len(r.features) for r in got], np.int64))
    column = np.array([chosen[f] for r in got for f in r.features], dtype=np.int64)
    labels = np.array([[np.nan if r[c] is None else r[c] for c in categories] for r in got], dtype=float).reshape(len(got), len(categories))
    folds = np.array([r.fold for r in got], dtype=int)
    return Chain(categories, chosen, fit_chain(row, column, labels, folds, len(chosen)))


#: The probability of the last category from which a document is rejected.
THRESHOLD = 0.4


def scored(
    docs: DataFrame, chain: Chain, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None
) -> DataFrame:
    """The rows with ``p_<category>`` for each category and ``rejected``: the last one's reaches the threshold.

    Whole texts are scored; null counts as empty, and a text without any known feature has the
    probabilities of the intercepts. Columns of the input with these names are replaced. ``keep`` names the
    columns of the input that come back, otherwise all do.
    """
    added = [T.StructField(f"p_{c}", T.DoubleType(), False) for c in chain.categories]
    kept = docs.schema if keep is None else T.StructType([docs.schema[c] for c in keep])
    schema = with_fields(kept, *added, T.StructField("rejected", T.BooleanType(), False))
    carried = [f.name for f in schema.fields[: -len(added) - 1]]
    sent, text = sent_to_python(docs, carried, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = pc.fill_null(whole.column(text), "")
            for start, end in text_ranges(texts, TEXT_BYTES):
                batch = whole.slice(start, end - start)
                p = chain.probabilities(texts.slice(start, end - start).to_pylist())
                found = [pa.array(np.ascontiguousarray(p[:, i])) for i in range(p.shape[1])]
                rejected = pa.array(p[:, -1] >= threshold)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *found, rejected], names=schema.names)

    return sent.mapInArrow(run, schema)
