"""Exact dedup, near-dedup, decontamination, toxicity and the pipeline against plain Python."""

import hashlib
import itertools
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricewell.llm import content_sort, near_dup, queries, tables, templates, toxicity
from pricewell.llm.components import components
from pricewell.llm.tables import read

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, component_id long, kept boolean, digest string"


def docs_of(spark, texts):
    """Documents with further columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, 1, False, "x") for r in texts], DOC)


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact(rows):
    """doc_id: (keep_id, size, digest) of plain Python."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, i in g}


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_content_sort(spark, partitions):
    rng = random.Random(3)
    texts = ["", None, " \t\n\x0b\x0c\r", "a b", "ab", "a  b", "\x1fab", "é🙂", "long " * 20_000, "long" * 20_000]
    rows = [(i, rng.choice(texts)) for i in range(300)] + [(1_000 + i, "copy") for i in range(700)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = content_sort.duplicates(docs_of(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = exact(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert len(got) == len(rows)


@pytest.mark.parametrize("bits", [7, 25])
def test_rows_told_by_a_filter_and_a_join(spark, monkeypatch, bits):
    monkeypatch.setattr(tables, "ID_FILTER_BITS", bits)
    rng = random.Random(5)
    docs = docs_of(spark, [(rng.choice([None, *range(400)]), str(i)) for i in range(900)])
    listed = [None, 0, 3, 3, 5_000, *range(100, 160)]
    ids = spark.createDataFrame([(i,) for i in listed], "doc_id int")
    every = [tuple(r) for r in docs.collect()]
    for how, inside in (("left_semi", True), ("left_anti", False)):
        got = tables.rows_with_ids(docs, ids, how)
        assert got.columns == docs.columns
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(r) for r in every if (r[0] in listed) == inside)
        empty = tables.rows_with_ids(docs, ids.limit(0), how)
        assert empty.count() == (0 if inside else len(every))
    assert tables.rows_with_ids(docs.limit(0), ids, "left_anti").count() == 0


@pytest.mark.parametrize("bits", [6, 25])
def test_surviving_rows_behind_a_filter(spark, monkeypatch, bits):
    monkeypatch.setattr(tables, "ID_FILTER_BITS", bits)
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(500)]), rng.choice(["", None, "a b", "ab", f"own {i}", f"own  {i}"])) for i in range(700)]
    got = [(r.doc_id, r.text) for r in content_sort.surviving(docs_of(spark, rows)).collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0))
    assert sorted((norm(t), len(t or ""), i is None, i or 0) for i, t in got) == sorted(
        (n, -min(g)[0], *min(g)[1:]) for n, g in groups.items()
    )


def test_one_training_row_for_an_id(spark):
    docs = spark.range(50_000).selectExpr("id % 2 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled_rows(docs, labels).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, "text 0", 0.0, 0.0, 0.0), (1, "text 1", 1.0, 1.0, 1.0)]


def test_content_sort_edges(spark):
    rows = [(5, "x y"), (5, "x y"), (5, "xy"), (None, "x y"), (None, "z"), (6, "x  y")]
    got = content_sort.duplicates(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got) == [
        (-1, -1, 1, True), (-1, 6, 5, False), (5, 6, 5, False), (5, 6, 5, False), (5, 6, 5, False), (6, 6, 5, True)
    ]
    left = content_sort.surviving(docs_of(spark, [*rows, (7, "w"), (7, "w"), (7, "w w")])).collect()
    assert sorted((r.doc_id or -1, r.text) for r in left) == [(-1, "z"), (6, "x  y"), (7, "w"), (7, "w w")]
    assert content_sort.duplicates(docs_of(spark, [])).count() == 0


def test_components_against_python(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1_000 + i, 1_001 + i) for i in range(40)] + [(1, None), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in parent}
    assert len(got) == len(parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def linked(rows, k, percent):
    """doc_id: (n_shingles, component) by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in rows}
    by = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = {p for members in by.values() for p in itertools.combinations(sorted(members), 2)}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_of_all_documents(spark, words, percent):
    docs = read(spark, "/root/testdata/sf0.01", "documents")
    got = near_dup.near_duplicates(docs, near_dup.Similarity(words, percent)).collect()
    want = linked([(r.doc_id, r.text) for r in docs.collect()], words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_large_groups_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(5_000)}" for _ in range(120)]
    rows = [(i, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6, 9]))) for i in range(400)]
    rows += [(1_000 + i, " ".join(base[:40]) + f" short{i}") for i in range(60)] + [(5_000 + i, f"Only {i % 4}") for i in range(40)]
    want = linked(rows, 3, 85)
    for bucket, block in ((4_096, 1_024), (50, 32)):
        monkeypatch.setattr(near_dup, "BUCKET_MEMBERS", bucket)
        monkeypatch.setattr(near_dup, "BLOCK_MEMBERS", block)
        got = near_dup.near_duplicates(docs_of(spark, rows), near_dup.Similarity(3, 85)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicate_edges(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text), (1, text.upper()), (None, text), (4, None), (5, ""), (6, " \n"), (7, "a b"), (8, "A  B"), (9, "x " * 50_000)]
    rows += [(10, text + " more"), (10, "p q r s t u"), (2, "p q r s t u"), (10, "p q r s t u")]
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs_of(spark, rows)).collect())
    want = [(-1, 56, None, True), (1, 56, 1, True), (2, 2, 1, False), (3, 56, 1, False), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True)]
    want += [(7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True), (10, 2, 1, False), (10, 2, 1, False), (10, 57, 1, False)]
    assert got == want
    assert near_dup.near_duplicates(docs_of(spark, [])).count() == 0


def test_sketches_fill_and_concentrate():
    rng = np.random.default_rng(1)
    for n, common in ((1, 1), (2, 1), (7, 6), (300, 240), (5_000, 1_000)):
        union = rng.integers(0, 1 << 63, 2 * n - common).astype(np.uint64)
        a, b = near_dup.sketches([np.sort(union[:n]), np.sort(union[n - common :])])
        assert abs((a == b).mean() - common / len(union)) < 0.17
    like = near_dup.Similarity(3, 85)
    assert (1 - 0.85 ** like.rows()) ** (near_dup.COORDINATES // like.rows()) <= near_dup.MISS


def test_sketches_and_words_take_bounded_memory(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3, 400_000, 90, 1_000, 250_000, 1)]
    tracemalloc.start()
    got = near_dup.sketches(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12e6
    monkeypatch.setattr(near_dup, "SKETCHED", 10_000_000)
    assert (got == near_dup.sketches(sets)).all()
    shingles = near_dup.Shingler(5)
    again = [shingles(b" ".join(b"w%d" % i for i in range(at, at + 1_000))) for at in (*range(0, 300_000, 1_000), 0)]
    assert len(shingles.known) <= 110_000 and (again[0] == again[-1]).all()


def test_benchmark_passages(spark):
    docs, benchmark = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    items = [(r.item_id, " ".join(re.findall(r"\w+", r.text.lower()))) for r in benchmark.collect()]
    want = set()
    for d in docs.collect():
        text = f" {' '.join(re.findall(r'\w+', (d.text or '').lower()))} "
        want |= {(d.doc_id, i) for i, t in items if f" {t} " in text}
    got = queries.op7_template_decontamination(spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_templates_and_slots(spark):
    asked = "A farmer named Tom has 12 apples and gives 5 apples to his friend Tom Jones who walks 3 km to the big market."
    other = asked.replace("Tom", "Anna").replace("12", "34").replace("5", "9").replace("3 km", "8 miles")
    mixed = other.replace("friend Anna", "friend Bert")
    benchmark = spark.createDataFrame([(1, asked), (2, None), (3, "too short"), (1, asked)], "item_id long, text string")
    rows = [(1, f"Before. {asked} After."), (2, f"x\n{other}"), (3, f"x. {mixed}"), (4, None), (5, ""), (None, asked), (6, "word " * 30_000)]
    rows += [(7, f"X. {asked}"), (7, f"X. {asked}"), (8, " ".join(asked.split()[:7]))]
    got = {r.doc_id: r.reworded for r in templates.contaminated(docs_of(spark, rows), benchmark).collect()}
    assert got == {1: False, 2: True, None: False, 7: False}
    assert templates.contaminated(docs_of(spark, []), benchmark).count() == 0
    assert templates.contaminated(docs_of(spark, rows), benchmark.limit(0)).count() == 0


def test_a_changed_slot_does_not_veto_the_rest(spark):
    long = (
        "Yesterday the old baker Tom sold 40 loaves at the market while his neighbour carried heavy bags home and then"
        " the tired baker Tom counted 40 coins on the wooden table before going to bed early that night."
    )
    fruit = "In the basket of the girl there are 2 apples and 2 pears which she wants to share with all of her friends today."
    named = "We saw that Tom met Tom near the lake and we heard that Tom left Tom at home so we asked if our Tom was well today."
    benchmark = spark.createDataFrame([(1, long), (2, fruit), (3, named)], "item_id long, text string")
    other = named.replace("Tom", "Anna")
    rows = [(1, long.replace("baker Tom counted", "baker Bert counted")), (2, long.replace("40 coins", "50 coins"))]
    rows += [(3, fruit.replace("2 apples", "3 apples").replace("2 pears", "4 pears")), (4, other.replace("our Anna", "our Bert"))]
    rows += [(5, "Bert".join("Anna".join(named.split("Tom", 1)).split("Tom", 1)).replace("Tom left Tom", "Carl left Dora"))]
    got = {(r.doc_id, r.item_id) for r in templates.contaminated(docs_of(spark, rows), benchmark).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (4, 3)}


def test_names_at_line_and_sentence_starts_and_case(spark):
    short = "Tom has many red apples today. Tom buys some more green pears. Tom eats them all at home. Tom sleeps very well."
    wrapped = "Every day the shop of the old\nTom sells bread and milk to\nBerta while the good neighbour of\nCarl waits outside."
    german = "Der Bauer hat im Stall eine Kuh, ein Pferd und ein Schaf. Die Frau kauft im Laden Brot, Milch, Butter und Mehl."
    number = "On his way to the shop he took thirteen steps past the tree and sixty more past one house to the gate."
    benchmark = spark.createDataFrame(enumerate([short, wrapped, german, number]), "item_id long, text string")
    rows = [(1, short.replace("Tom", "Anna")), (2, "so " + wrapped.replace("\n", " ")), (3, "wir lesen " + german.lower()), (4, german.upper())]
    rows += [(5, wrapped.replace("\n", " ").replace("Tom", "Uwe")), (6, number.replace("thirteen", "14").replace("sixty", "8").replace("one", "2"))]
    rows += [(7, short.replace("Tom", "He")), (8, short.upper()), (9, " ".join(sorted(short.split())))]
    got = {(r.doc_id, r.item_id, r.reworded) for r in templates.contaminated(docs_of(spark, rows), benchmark).collect()}
    want = {(1, 0, True), (2, 1, False), (3, 2, False), (4, 2, False), (5, 1, True), (6, 3, True), (7, 0, True), (8, 0, False)}
    assert got == want


def test_slot_rich_items(spark):
    listed = "Anna Berta Carl Dora Emil Franz Gustav Hans Ida Jakob"
    formula = "1 + 2 * 3 / 4 - 5 + 6 * 7 + 8 = 9 x 10"
    benchmark = spark.createDataFrame([(1, listed), (2, formula)], "item_id long, text string")
    rows = [(1, f"We saw {listed} there."), (2, f"It is {formula} y."), (3, listed.replace("Dora", "Otto")), (4, formula.replace("5", "1"))]
    got = {(r.doc_id, r.item_id, r.reworded) for r in templates.contaminated(docs_of(spark, rows), benchmark).collect()}
    assert got == {(1, 1, False), (2, 2, False)}


def test_short_items(spark):
    benchmark = spark.createDataFrame([(1, "What is the capital of France?"), (2, "Who wrote Faust?"), (3, "?!"), (4, None)], "item_id long, text string")
    rows = [(1, "We ask: what is the capital\nof France? And again: What is the capital of France?"), (2, "Who wrote Faust"), (3, "who wrote Hamlet?!")]
    rows += [(4, "He knows who wrote Faust and what is the capital of Spain."), (5, None), (6, "of"), (7, "What is the capital of")]
    got = templates.contaminated(docs_of(spark, rows), benchmark).collect()
    assert sorted((r.doc_id, r.item_id, r.n_windows, r.position, r.reworded) for r in got) == [(1, 1, 1, 2, False), (2, 2, 1, 0, False), (4, 2, 1, 2, False)]


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    seen = labels.where("doc_id % 3 != 0")
    chain = toxicity.trained(toxicity.labelled_rows(docs, seen))
    held = labels.where("doc_id % 3 = 0")
    rows = toxicity.scored(docs.join(held, "doc_id"), chain).select("toxic", "rejected").collect()
    caught = sum(r.rejected for r in rows if r.toxic)
    wrong = sum(r.rejected for r in rows if not r.toxic)
    assert caught / sum(r.toxic for r in rows) > 0.9
    assert wrong / len(rows) < 0.01


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "bad " * 90_000, 3), (2, "", 3)], "doc_id long, text string, p_toxic long")
    schema = "doc_id long, quality int, toxic int"
    for labels in ([], [(1, None, None), (None, 1, 1)], [(2, 1, 0), (2, 0, 1), (1, 1, None)]):
        chain = toxicity.trained(toxicity.labelled_rows(docs, spark.createDataFrame(labels, schema)))
        got = toxicity.scored(docs, chain)
        assert got.columns == ["doc_id", "text", "p_harmful", "p_low_quality", "p_toxic", "rejected"]
        assert got.count() == 4
    assert toxicity.scored(docs.limit(0), chain).count() == 0


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.5).astype(float)
    rows, columns = np.flatnonzero(y), np.zeros(int(y.sum()), int)
    links = toxicity.fit_chain(rows, columns, np.c_[y, y], rng.integers(0, toxicity.FOLDS, 400), 1)
    assert links[1].before[0] > 1


def test_pipeline_stages(spark):
    docs = read(spark, SF, "documents")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns, name
    toxic = {r.doc_id for r in queries.op4_toxicity_chain(spark, SF).where("toxic").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    kept = exact(rows)
    rows = [r for r in rows if kept[r[0]][0] == r[0]]
    near = linked(rows, 5, 80)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    leaked = {r.doc_id for r in queries.op7_template_decontamination(spark, SF).collect()}
    want = {i for i, _ in rows if i not in leaked}
    assert {r.doc_id for r in now.collect()} == want
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == want and all(r.round_trip for r in out)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_pipeline_stages_send_small_batches(spark, name, stage):
    docs = read(spark, SF, "documents")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    large = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("some words "), 10_000).alias("text"))
    spark.conf.unset(corpus_pipeline.BATCH_SETTING)
    assert stage(spark, docs, SF).columns
    assert large.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 4_000_000
    spark.conf.set(corpus_pipeline.BATCH_SETTING, "8m")  # what the session says is kept
    stage(spark, docs, SF)
    assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == "8m"
    spark.conf.unset(corpus_pipeline.BATCH_SETTING)


def test_pipeline_stages_take_odd_rows(spark):
    schema = read(spark, SF, "documents").schema
    odd = [(None, None, None, None, None), (1, "", None, "s", 0), (2, "x y", "en", "s", 3), (2, "x y", "en", "s", 3), (3, "w " * 60_000, "en", None, 1)]
    for rows in (odd, []):
        now = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        assert len(now.collect()) == (3 if rows else 0)


def test_filter_of_windows_is_packed(spark):
    known = spark.createDataFrame([(5,), (-3,), (2**40 + 9,)], "window LONG")
    passing = templates._filter(known)
    assert passing.nbytes == (1 << templates.FILTER_BITS) // 8
    hashes = np.array([5, -3, 2**40 + 9, 6, 11], np.int64).view(np.uint64)
    found = [templates._passes(passing, templates._bits(hashes, shift)) for shift in (0, templates.FILTER_BITS)]
    assert (found[0] & found[1]).tolist() == [True, True, True, False, False]
