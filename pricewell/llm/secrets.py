"""Secret scans: fixed patterns, and two character Markov models compared by likelihood.

The models are first-order chains over a small alphabet, one of random strings and one of ordinary
identifiers, counted from labelled samples. A candidate (a long run of key characters) is a secret
where its characters are clearly likelier under the random model, else its pieces are judged. Everything is DataFrame
functions: the counts are a grouped table, the log ratios an array literal of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.llm.tables import sampled, whole_text

#: The base patterns.
ASSIGN = (
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: A run that is too short is no match for these two, so the bound may stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
ASSIGN_LEAST = 6
#: Candidates of the models: whole runs of key characters of at least this length.
CANDIDATE_LEAST = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{CANDIDATE_LEAST},}}"
#: What is scored by itself in a candidate that is ordinary as a whole: what stands between =, then between / _ = -.
PIECES = [rf"[A-Za-z0-9+/_-]{{{CANDIDATE_LEAST},}}", rf"[A-Za-z0-9+]{{{CANDIDATE_LEAST},}}"]
#: The models' alphabet; other characters share the last place.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Mean log ratio of a character from which a candidate is a secret.
THRESHOLD = 0.5
#: What trains the models: so many documents at most, and so many digests. Ordinary strings are long words.
SAMPLE_ROWS, DIGESTS = 2_000, 2_000
WORD = r"[A-Za-z][A-Za-z_-]{7,}"


def _steps(token: Column) -> Column:
    """The numbers of the pairs of neighbouring characters of a token, from 0 to SIZE * SIZE - 1."""
    place = lambda c: F.pmod(F.instr(F.lit(ALPHABET), c) - 1, F.lit(SIZE)).cast("int")
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), place)
    return F.zip_with(
        F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))),
        F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))),
        lambda a, b: a * SIZE + b,
    )


def trained(samples: DataFrame) -> list[float]:
    """Log ratios of all character steps from labelled strings (``token``, ``random`` 0 or 1).

    Counts are smoothed by one half. Null tokens and labels are left out. The result has SIZE * SIZE
    numbers whatever the input; a model without samples is uniform.
    """
    steps = (
        samples.where(F.col("token").isNotNull() & F.col("random").isNotNull())
        .select((F.col("random").cast("int") == 1).alias("random"), F.explode(_steps(F.col("token"))).alias("step"))
        .groupBy("step")
        .agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    )
    counts = {row.step: (row.r, row.o) for row in steps.collect()}  # at most SIZE * SIZE rows
    ratios: list[float] = []
    for first in range(SIZE):
        row = [counts.get(first * SIZE + second, (0, 0)) for second in range(SIZE)]
        random, ordinary = (sum(x[k] for x in row) + SIZE / 2 for k in (0, 1))
        ratios += [math.log((r + 0.5) / random) - math.log((o + 0.5) / ordinary) for r, o in row]
    return ratios


def random_ratio(token: Column, ratios: list[float]) -> Column:
    """The mean log ratio of a token's steps; 0 for fewer than two characters."""
    table = F.array(*[F.lit(round(x, 6)) for x in ratios])
    steps = _steps(token)
    total = F.aggregate(steps, F.lit(0.0), lambda sum_, s: sum_ + F.get(table, s))
    return F.when(F.size(steps) > 0, total / F.size(steps)).otherwise(F.lit(0.0))


SPANS = "array<struct<start:int,end:int,text:string>>"
#: Numbers whose running values are made one from the other; blocks of them are put together.
BLOCK = 64


def _no_spans() -> Column:
    return F.expr(f"cast(array() as {SPANS})")


def _bound(value: Column, use) -> Column:
    """What a function makes of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _running(numbers: Column, join) -> Column:
    """The running values of a list of numbers, joined by a sum or a maximum, in some n * sqrt(n) steps.

    A fold copies what it carries at each step, so it may not carry the list.
    """
    folded = lambda x: F.aggregate(x, F.lit(0), join)
    last = F.floor((F.size(numbers) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda j: F.slice(numbers, j * BLOCK + 1, F.lit(BLOCK)))
    inside = lambda block, before: F.transform(block, lambda _, i: join(before, folded(F.slice(block, 1, i + 1))))
    whole = lambda blocks_, ends: F.flatten(
        F.transform(blocks_, lambda block, j: _bound(folded(F.slice(ends, 1, j)), lambda before: inside(block, before)))
    )
    return _bound(blocks, lambda blocks_: _bound(F.transform(blocks_, folded), lambda ends: whole(blocks_, ends)))


def _found(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs of start, end (code points, end exclusive) and text.

    The pieces between the matches and the matches themselves give the positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def spans(hits_: Column) -> Column:
        steps = F.zip_with(hits_, F.slice(gaps, 1, F.size(hits_)), lambda h, g: F.length(g) + F.length(h))
        ends = _bound(steps, lambda n: _running(n, lambda x, y: x + y))
        return F.zip_with(hits_, ends, lambda h, end: _span(end - F.length(h), end, h))

    return F.when(F.rlike(text, F.lit(pattern)), _bound(hits, spans)).otherwise(_no_spans())


def _of_kind(spans: Column, kind: str) -> Column:
    """The spans as structs that sort by start, then kind as listed."""
    rank = KINDS.index(kind)
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def _span(start: Column, end: Column, text: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), text.alias("text"))


def _before(starts: Column, bound: Column) -> Column:
    """How many of the ascending starts are below a bound, by bisection."""
    middle = lambda acc: F.floor((acc["low"] + acc["high"]) / 2).cast("int")

    def half(acc: Column, _: Column) -> Column:
        below = F.get(starts, middle(acc)) < bound
        low = F.when(below, middle(acc) + 1).otherwise(acc["low"])
        high = F.when(below, acc["high"]).otherwise(middle(acc))
        step = F.struct(low.alias("low"), high.alias("high"))
        return F.when(acc["low"] < acc["high"], step).otherwise(acc)

    rounds = F.sequence(F.lit(1), F.length(F.bin(F.size(starts))))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(starts).alias("high")), half, lambda acc: acc["low"])


def _uncovered(candidates: Column, base: Column) -> Column:
    """The parts of the candidates, of at least their minimum length, that no base match covers.

    Between the matches that begin in a candidate, a part goes from the farthest end so far to the next match.
    """

    def parts(c: Column, starts: Column, ends: Column) -> Column:
        low, high = _before(starts, c["start"] + 1), _before(starts, c["end"])
        reach = lambda i: F.greatest(c["start"], F.when(i > 0, F.get(ends, i - 1)).otherwise(0))
        upto = lambda i, last: F.when(i < last, F.get(starts, i)).otherwise(c["end"])
        cut = lambda last: F.transform(F.sequence(low, F.greatest(low, last)), lambda i: F.struct(reach(i).alias("start"), upto(i, last).alias("end")))
        long = F.filter(_bound(high, cut), lambda p: p["end"] - p["start"] >= CANDIDATE_LEAST)
        text = lambda p: F.substring(c["text"], p["start"] - c["start"] + 1, p["end"] - p["start"])
        return F.transform(long, lambda p: _span(p["start"], p["end"], text(p)))

    def all_parts(starts: Column) -> Column:
        ends = _bound(F.transform(base, lambda b: b["end"]), lambda x: _running(x, lambda a, b: F.greatest(a, b)))
        return _bound(ends, lambda far: F.flatten(F.transform(candidates, lambda c: parts(c, starts, far))))

    # without base matches the candidates stay as they are
    return F.when((F.size(base) == 0) | (F.size(candidates) == 0), candidates).otherwise(_bound(F.transform(base, lambda b: b["start"]), all_parts))


def _likely(spans: Column, ratios: list[float], threshold: float, pieces: list[str]) -> Column:
    """The spans that the models take for random; of the others, the pieces that they do."""

    def judged(span: Column) -> Column:
        inner = _no_spans()
        if pieces:
            found = F.transform(
                _found(span["text"], pieces[0]), lambda s: _span(span["start"] + s["start"], span["start"] + s["end"], s["text"])
            )
            inner = _likely(found, ratios, threshold, pieces[1:])
        return F.when(random_ratio(span["text"], ratios) > threshold, F.array(span)).otherwise(inner)

    return F.flatten(F.transform(spans, judged))


def scanned(docs: DataFrame, ratios: list[float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``base`` and ``spans``: arrays of (start, rank, end, kind) in order of start and kind.

    ``base`` has the matches of the patterns, leftmost and non-overlapping per kind; ``spans`` has these
    and the candidates that the models take for random, without what a base match covers. Of a candidate that is
    ordinary as a whole, the pieces between = or / _ = - are judged by themselves, if they are long enough. Null
    texts are empty and have no spans. Columns of the input with these names are replaced.
    """
    text = F.col("__text")
    assigned = F.filter(_found(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= ASSIGN_LEAST)
    base = F.concat(
        _of_kind(assigned, "assign"), _of_kind(_found(text, ACCESS), "access"), _of_kind(_found(text, HEX), "hex")
    )
    parts = _uncovered(F.col("__candidates"), F.col("base"))
    likely = _likely(F.col("__parts"), ratios, threshold, PIECES)
    others = [c for c in docs.columns if c not in ("base", "spans")]
    return (
        docs.select(*others, whole_text(text_col).alias("__text"))
        .withColumn("base", F.array_sort(base))
        .withColumn("__candidates", _found(text, CANDIDATE))
        .withColumn("__parts", parts)
        .withColumn("spans", F.array_sort(F.concat("base", _of_kind(likely, "random"))))
        .select(*others, "base", "spans")
    )


def shown(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def labelled_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A bounded labelled sample (token, random) for the models.

    Of the documents with ``SAMPLE_ROWS`` ids, the first by a hash, the values that the assign pattern finds are
    random strings and long words are ordinary. ``DIGESTS`` digests of numbers, in base 64 and hex,
    are random strings too, so that a sample without secrets still gives a model.
    """
    ids = sampled(docs.select(id_col).where(F.col(id_col).isNotNull()), id_col, SAMPLE_ROWS).distinct()
    rows = docs.select(id_col, whole_text(text_col).alias("t")).join(F.broadcast(ids), id_col)
    number = F.col("id").cast("string").cast("binary")
    digests = docs.sparkSession.range(DIGESTS).select(
        F.explode(F.array(F.regexp_replace(F.base64(F.unhex(F.sha2(number, 256))), "=", ""), F.sha1(number))).alias("token")
    )
    strings = rows.select(F.explode(F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(1))).alias("token")).where(F.length("token") >= 16)
    words = rows.select(F.explode(F.regexp_extract_all("t", F.lit(WORD), F.lit(0))).alias("token"))
    return digests.unionByName(strings).withColumn("random", F.lit(1)).unionByName(words.withColumn("random", F.lit(0)))
