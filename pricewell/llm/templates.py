"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders; windows of so many template tokens of the
documents are joined by hash with those of the benchmark. A window is looked up as its plain words in
whatever case, as a template whose names are the capitals inside sentences, and as one whose names
are all capitals. Where windows meet, the values in their
slots are laid side by side: a copy has the same ones, a re-parameterised question has others, but
the same name for the same name along a run. A filter of fixed size over the benchmark's windows keeps
nearly all other windows of the documents from being shuffled at all.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewell.llm.tables import kept_in_worker, whole_text
from pricewell.session import materialized

#: Tokens of a window, and how many of them must be words.
WINDOW, LEAST_WORDS = 8, 4
#: Windows that must meet in a row: as many as 13 tokens have, or half of a shorter item's.
LEAST_WINDOWS = 6
#: Size of the filter as a power of two in bits, and the most benchmark windows that are broadcast.
FILTER_BITS, BROADCAST_WINDOWS = 25, 500_000
#: Units after a number, numbers in words.
UNITS = set(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg lb lbs oz ton tons ml l liter liters litre litres"
    " s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years"
    " cent cents dollar dollars euro euros pound pounds percent degree degrees mph kmh volt volts watt watts".split()
)
NUMBER_WORDS = set(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
    " twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion trillion".split()
)
TOKEN = re.compile(r"[.!?\n]|\d[\d.,]*\d|\d|[^\W\d_]+")
PLAIN, STOP, NUMBER, CAPITAL, UNIT, ONE = range(6)
PLACEHOLDER = {NUMBER: "number", CAPITAL: "name", UNIT: "unit"}
EVIDENCE = "n_windows long, unchanged long, worded long, position long, reworded boolean"
#: What names an alignment, and how many are judged together.
ALIGNED = ["doc_id", "item_id", "item_windows", "item_worded"]
JUDGED_TOGETHER = 500
#: ``worded``: as a template the window has enough words; ``loose``: all capitals are names, and "one" is a number.
WINDOWS = "id long, window long, position long, words array<string>, worded boolean, loose boolean"


def _hash(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token.encode())


class _Places(dict):
    """The place of each token met; a new token is learned when it is asked for."""

    def __init__(self, learn) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self)
        self.learn(token, at)
        return at


def _in_window(flags: np.ndarray) -> np.ndarray:
    """How many flags each window has."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[WINDOW:] - total[:-WINDOW]


class Templates:
    """Turns texts into templates; tokens are classified once and remembered."""

    remembered = 250_000

    def __init__(self) -> None:
        self.place = _Places(self._learn)
        self.kinds = np.zeros(1024, np.int8)
        self.hashes = np.zeros(1024, np.uint64)
        self.slots = np.array([_hash(f"<{PLACEHOLDER.get(kind, '')}>") for kind in range(6)], np.uint64)
        self.powers = np.array([pow(0x9E3779B97F4A7C15, WINDOW - i, 1 << 64) for i in range(WINDOW)], np.uint64)

    def _learn(self, token: str, at: int) -> None:
        low = token.casefold()
        if token in ".!?\n":
            kind = STOP
        elif token[0].isdigit() or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif low == "one":
            kind = ONE
        else:
            kind = CAPITAL if token[0].isupper() and token[1:].islower() else PLAIN
        if at == len(self.kinds):
            self.kinds = np.concatenate([self.kinds, np.zeros_like(self.kinds)])
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        self.kinds[at], self.hashes[at] = kind, _hash(low)

    def _mixed(self, hashes: np.ndarray, length: int = WINDOW) -> np.ndarray:
        n = len(hashes) - length + 1
        mixed = np.full(n, WINDOW - length, np.uint64)
        for i, power in enumerate(self.powers[:length]):
            mixed += hashes[i : i + n] * power
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        return mixed

    def windows(
        self, text: str, shorter: list[int] | None = None
    ) -> tuple[list[str], np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray, bool]]]:
        """The text's tokens, which of them count (no stops), which windows are worded, and its windows as words and as templates.

        For each way: tokens of a window, where they are, their hashes, the tokens' kinds (0: a word), whether it is loose.
        A template comes only where it differs from what came before and has enough words. Shorter windows
        are words only; without their lengths, a shorter text is one window.
        """
        tokens = TOKEN.findall(text)
        if len(self.place) > self.remembered:
            self.place.clear()
        at = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
        kinds = self.kinds[at]
        keep = np.flatnonzero(kinds != STOP)
        n = len(keep) - WINDOW + 1
        words = self.hashes[at[keep]]
        if shorter is None:
            shorter = [len(keep)] if 0 < len(keep) < WINDOW else []
        ways = []
        for length in shorter:
            if len(keep) >= length:
                # the first of equal ones
                hashes, places = np.unique(self._mixed(words, length), return_index=True)
                ways.append((length, places, hashes, np.zeros(len(keep), np.int8), False))
        if n < 1:
            return tokens, keep, np.zeros(0, bool), ways
        # the start of a text counts as a stop
        before = np.where(keep > 0, kinds[keep - 1], np.int8(STOP))
        kinds = kinds[keep]
        # a name is a capital inside a sentence, a unit stands after a number
        capital = kinds == CAPITAL
        strict = (kinds == NUMBER) | (capital & (before != STOP)) | ((kinds == UNIT) & (before == NUMBER))
        loose = strict | capital | (kinds == ONE) | ((kinds == UNIT) & (before == ONE))
        slots = _in_window(strict)
        worded = slots <= WINDOW - LEAST_WORDS
        ways.append((WINDOW, np.arange(n), self._mixed(words), np.zeros_like(kinds), False))
        # the further capitals make further slots
        for slot, wanted, is_loose in ((strict, worded & (slots > 0), False), (loose, _in_window(loose & ~strict) > 0, True)):
            if is_loose:
                wanted &= _in_window(loose) <= WINDOW - LEAST_WORDS
            places = np.flatnonzero(wanted)
            if len(places):
                typed = np.where(slot, np.where(kinds == ONE, np.int8(NUMBER), kinds), np.int8(PLAIN))
                ways.append((WINDOW, places, self._mixed(np.where(slot, self.slots[typed], words))[places], typed, is_loose))
        return tokens, keep, worded, ways


def _bits(windows: np.ndarray, shift: int) -> np.ndarray:
    return (windows >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)


def _passes(passing: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which bits are set in a packed filter."""
    return (passing[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def windows(rows: DataFrame, passing: np.ndarray | None = None, shorter: list[int] | None = None) -> DataFrame:
    """The windows of texts (id, text): ``WINDOWS``. With a filter, only those that may be in it.

    Shorter windows are of the lengths given; without any given, a shorter text is one window.

    ``words`` has the window's tokens in lower case, slots marked by their type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = kept_in_worker(("templates",), Templates)
        for batch in batches:
            out: list[list] = [[] for _ in WINDOWS.split(", ")]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens, keep, worded, ways = templates.windows(text.as_py(), shorter)
                for length, places, hashes, kinds, loose in ways:
                    if passing is not None:
                        for shift in (0, FILTER_BITS):
                            some = _passes(passing, _bits(hashes, shift))
                            places, hashes = places[some], hashes[some]
                    for at, window in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        words = [
                            f"<{PLACEHOLDER[k]}>{t.casefold()}" if k else t.casefold()
                            for t, k in zip((tokens[i] for i in keep[at : at + length]), kinds[at : at + length].tolist(), strict=True)
                        ]
                        for column, value in zip(out, (doc_id, window, at, words, length == WINDOW and bool(worded[at]), loose), strict=True):
                            column.append(value)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(out, types, strict=True)],
                names=[part.split()[0] for part in WINDOWS.split(", ")],
            )

    return rows.select(F.col("id").cast("long"), "text").mapInArrow(run, WINDOWS)


def _filter(benchmark_windows: DataFrame) -> np.ndarray:
    """The bits of all benchmark windows, packed in bytes: 2 ** FILTER_BITS flags whatever the benchmark's size."""
    mask = (1 << FILTER_BITS) - 1
    bit = F.explode(
        F.array(F.col("window").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("window", FILTER_BITS).bitwiseAND(F.lit(mask)))
    ).alias("bit")
    words = (
        benchmark_windows.select(bit)
        .groupBy(F.floor(F.col("bit") / 64).cast("long").alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
        .collect()  # at most 2 ** FILTER_BITS / 64 numbers
    )
    packed = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    for row in words:
        packed[row.at] = row.bits
    return packed.view(np.uint8)


def evidence(windows: list) -> tuple[int, int, int, int, bool]:
    """What counts of one alignment: ``EVIDENCE``, the better with and without loose names.

    Numbers and units are independent slots: the same value twice need not mean the same quantity. A name means
    one person, so a name that meets two others speaks against a copy: windows over it count only where
    they are unchanged, or inside a run of windows in which it meets one name, and that more than once.
    """
    best = max((_counted([w for w in windows if not w["loose"]]), _counted(windows)), key=_weight)
    first = best[0]["position"] if best else 0
    return len(best), sum(not w["changed"] for w in best), sum(w["worded"] for w in best), first, any(w["changed"] for w in best)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments with their ``EVIDENCE`` in place of their windows."""
    schema = pa.schema([("n_windows", pa.int64()), ("unchanged", pa.int64()), ("worded", pa.int64()), ("position", pa.int64()), ("reworded", pa.bool_())])
    for whole in batches:
        for start in range(0, whole.num_rows, JUDGED_TOGETHER):
            batch = whole.slice(start, JUDGED_TOGETHER)
            found = [dict(zip(schema.names, evidence(w), strict=True)) for w in batch.column("windows").to_pylist()]
            e = pa.RecordBatch.from_pylist(found, schema).to_struct_array()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ALIGNED), e], names=[*ALIGNED, "e"])


def _weight(windows: list) -> tuple[int, int]:
    return sum(w["worded"] for w in windows), len(windows)


def _counted(windows: list) -> list:
    """The windows that count, one a position: an unchanged one if there is one, else that of fewest names."""
    ordered = sorted(windows, key=lambda w: (w["position"], w["changed"], w["slots"] == 0, w["slots"]))
    windows = [w for i, w in enumerate(ordered) if i == 0 or w["position"] != ordered[i - 1]["position"]]
    met = defaultdict(set)
    for w in windows:
        for n in w["names"]:
            met[n["asked"]].add(n["found"])
    torn = {name for name, others in met.items() if len(others) > 1}
    best = [w for w in windows if not w["changed"] or torn.isdisjoint(n["asked"] for n in w["names"])]
    start, last = 0, {}  # last: where in the run a torn name was met, by name and by what it met
    ends = [*windows, None] if torn else []
    for end, w in enumerate(ends):
        names = [(n["asked"], n["found"]) for n in w["names"] if n["asked"] in torn] if w else []
        clash = max((at for a, f in names for (b, g), at in last.items() if a == b and f != g), default=-1)
        broken = len(set(names)) > len({a for a, _ in names})  # within this window
        if w is None or broken or clash >= start:
            run = windows[start:end]
            tokens = defaultdict(set)
            for r in run:
                for n in r["names"]:
                    tokens[n["asked"]].add(n["token"])
            once = {name for name in torn if len(tokens[name]) < 2}
            counted = [r for r in run if not r["changed"] or once.isdisjoint(n["asked"] for n in r["names"])]
            best = max(best, counted, key=_weight)
            start = end + 1 if broken else max(start, clash + 1)
        last |= {pair: end for pair in names}
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item of which it holds a passage.

    Columns: doc_id, item_id, n_windows (met in a row, apart from gaps), item_windows, position (template
    token of the document), reworded (some slot holds another value). What counts where names are not
    changed alike says ``evidence``. Whole texts are searched,
    and items shorter than a window as a whole, in whatever case; texts without any token meet nothing. Repeated
    rows count once, rows without an id are searched too (as one id), further columns are ignored.
    """
    items = benchmark.select(F.col("item_id").alias("id"), whole_text().alias("text"))
    known = materialized(windows(items).distinct(), "benchmark-windows")
    sizes = known.groupBy("id").agg(
        F.count_distinct("position").alias("item_windows"), F.count_distinct(F.when(F.col("worded"), F.col("position"))).alias("item_worded")
    )
    item_windows = known.join(sizes, "id").select(
        *[F.col("id").alias("item_id"), "window", F.col("position").alias("at"), F.col("words").alias("asked")],
        *["item_windows", "item_worded", "worded", F.col("loose").alias("item_loose")],
    )
    if known.count() <= BROADCAST_WINDOWS:
        item_windows = F.broadcast(item_windows)
    # the lengths of items shorter than a window
    shorter = [row[0] for row in known.select(F.size("words")).where(F.size("words") < WINDOW).distinct().collect()]
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    found = windows(rows, _filter(known), shorter).withColumnRenamed("id", "doc_id").drop("worded").join(item_windows, "window")
    is_slot = lambda w: F.substring(w, 1, 1) == "<"
    # equal hashes of other templates are told apart by the words themselves
    same = F.forall(
        F.arrays_zip("asked", "words"),
        lambda p: (p["asked"] == p["words"])
        | (is_slot(p["asked"]) & is_slot(p["words"]) & (F.substring_index(p["asked"], ">", 1) == F.substring_index(p["words"], ">", 1))),
    )
    pairs = F.arrays_zip("asked", "words")
    place = lambda p, i: F.struct((F.col("position") + i).alias("token"), p["asked"].alias("asked"), p["words"].alias("found"))
    aligned = (
        found.where(same)
        .select(
            *["doc_id", "item_id", "item_windows", "item_worded", "position", (F.col("position") - F.col("at")).alias("shift")],
            *["worded", (F.col("loose") | F.col("item_loose")).alias("loose")],
            F.size(F.filter("words", is_slot)).alias("slots"),
            F.exists(pairs, lambda p: p["asked"] != p["words"]).alias("changed"),
            F.filter(F.transform(pairs, place), lambda p: F.startswith(p["asked"], F.lit("<name>"))).alias("names"),
        )
        .groupBy("doc_id", "item_id", "shift")
        .agg(
            F.count_distinct("position").alias("met"),
            F.first("item_windows").alias("item_windows"),
            F.first("item_worded").alias("item_worded"),
            # as many as the item has windows
            F.collect_set(F.struct("position", "changed", "worded", "loose", "slots", "names")).alias("windows"),
        )
    )
    least = lambda of: F.least(F.lit(LEAST_WINDOWS), F.ceil(F.col(of) / 2))
    enough = (F.col("e.unchanged") >= least("item_windows")) | ((F.col("item_worded") > 0) & (F.col("e.worded") >= least("item_worded")))
    best = F.max_by(
        F.struct("e.n_windows", "item_windows", "e.position", "e.reworded"), F.struct("e.n_windows", -F.col("e.position"))
    )
    return (
        aligned.where(F.col("met") >= F.greatest(F.lit(1), least("item_worded")))
        .select(*ALIGNED, "windows")
        .mapInArrow(_judged, f"doc_id long, item_id long, item_windows long, item_worded long, e struct<{EVIDENCE.replace(' ', ':').replace(',:', ', ')}>")
        .where(enough)
        .groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", "b.n_windows", "b.item_windows", "b.position", "b.reworded")
    )
