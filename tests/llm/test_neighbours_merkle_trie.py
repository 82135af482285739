"""Nearest neighbours, the Merkle manifest and the prefix trie against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import check_oracle
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricewell.llm import merkle, nearest, prefix_trie, queries
from pricewell.llm.tables import read

SF = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", list(queries.query.sql))
def test_sql_twins(spark, name):
    names, rows = check_oracle.spark_rows(queries.query.queries[name](spark, SF))
    assert (names, rows) == check_oracle.sql_rows(check_oracle.connect(SF), queries.query.sql[name])


# nearest neighbours


def brute_nearest(rows, k):
    """{query: [(id, score)]}: ids are as near as their nearest vectors."""
    vectors = defaultdict(list)
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            vectors[i].append(np.array(v, np.float64))
    found = {}
    for q in vectors:
        if q % 100:
            continue
        near = []
        for i, others in vectors.items():
            scores = [np.sqrt(((a - b) ** 2).sum()) for a in others for b in vectors[q] if len(a) == len(b)]
            if i != q and scores:
                near.append((min(scores), i))
        if near:
            found[q] = [(i, s) for s, i in sorted(near)[:k]]
    return found


def found_nearest(spark, rows, k=10, kind="float"):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int, score double").repartition(5)
    got = defaultdict(list)
    for r in sorted(nearest.nearest(df, F.col("vec_id") % 100 == 0, k).collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.vec_id, r.score))
    return got


def same_neighbours(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-13, atol=0), q


def test_neighbours_of_sample(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, SF, "embeddings").collect()]
    got = defaultdict(list)
    for r in queries.op11_block_matrix_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    same_neighbours(got, brute_nearest(rows, 10))


def test_neighbours_ties_repeats_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    grid = [[float(x) for x in v] for v in rng.integers(-2, 3, (600, 3))]  # very many ties
    rows = [(i, v) for i, v in enumerate(grid)]
    rows += [(1_000, None), (1_100, [0.0, 0.0, 0.0]), (1_200, [1.0, None, 2.0]), (1_300, [float("nan"), 1.0, 1.0]), (1_400, [float("inf"), 1.0, 1.0])]
    rows += [(None, [1.0, 1.0, 1.0]), (1_500, []), (1_600, [1.0, 2.0]), (1_601, [2.0, 2.0]), (1_700, [1.0] * 7)]
    rows += [(7, [1.0, 1.0, 1.0])] * 300 + [(100, [5.0, 5.0, 5.0]), (100, [5.0, 5.0, 4.0])]  # copies, and ids of several vectors
    rows += [(8, [float(x), 0.0, 1.0]) for x in range(200)]
    got = found_nearest(spark, rows)
    same_neighbours(got, brute_nearest(rows, 10))
    assert got[1_600] == [(1_601, 1.0)] and 1_700 not in got


def test_neighbours_of_any_magnitude(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=40) * 10.0 ** rng.integers(-200, 150)).tolist()) for i in range(300)]
    rows += [(300 + i, (rng.normal(size=1_500) + 50).tolist()) for i in range(150)]
    rows += [(1_000 + i, [5e-324 * (i + 1), 1e-320]) for i in range(101)]
    same_neighbours(found_nearest(spark, rows, kind="double"), brute_nearest(rows, 10))


def test_neighbours_over_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    for name, value in (("BLOCK_ROWS", 16), ("CELL_QUERIES", 60), ("CELL_CANDIDATES", 100), ("MERGED_CELLS", 3)):
        monkeypatch.setattr(nearest, name, value)
    rows = [(i * 10, rng.normal(size=5).tolist()) for i in range(700)] + [(0, rng.normal(size=5).tolist()) for _ in range(100)]
    same_neighbours(found_nearest(spark, rows, 7, "double"), brute_nearest(rows, 7))


def test_neighbours_of_nothing(spark):
    assert not found_nearest(spark, [])
    assert not found_nearest(spark, [(1, [1.0]), (2, [2.0])])
    assert not found_nearest(spark, [(100, [1.0])])


def test_bounds_hold():
    rng = np.random.default_rng(7)
    for scale in (1e-160, 1.0, 1e120):
        vectors = rng.normal(size=(80, 300)) * scale * rng.choice([1e-6, 1, 1e3], (80, 1))
        ids = pa.array(range(80))
        batch = pa.RecordBatch.from_arrays([ids, pa.array([False] * 80), pa.array(vectors.tolist())], names=["id", "q", "v"])
        block = nearest.Block(next(nearest.packed(iter([batch]))).to_pylist()[0])
        low, high = nearest.tile_bounds(block, block)
        true = np.sqrt(((vectors[:, None] - vectors) ** 2).sum(axis=2))
        assert (low <= true).all() and (true <= high).all()
        assert np.median(high / np.maximum(low, 1e-300)) < 1.2


# Merkle manifest


def entry_of(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves, arity=2):
    """The root and, for each leaf, its sides level by level."""
    level, at, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a - a % arity
            proofs[i].append(("".join(level[run:a]), "".join(level[a + 1 : run + arity])))
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
        at = [a // arity for a in at]
    return level[0], proofs


def brute_manifest(rows, arity=2):
    """{(order, leaf): [(subroot, root, proof)]} of (group, order, leaf)."""
    groups = defaultdict(list)
    for g, o, leaf in rows:
        groups[g].append(((o is not None, o or 0), leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [brute_tree([leaf for _, leaf in sorted(groups[g])], arity) for g in names]
    root, above = brute_tree([t[0] for t in trees], arity)
    found = defaultdict(list)
    for g, tree, top in zip(names, trees, above, strict=True):
        for ((has, o), leaf), proof in zip(sorted(groups[g]), tree[1], strict=True):
            found[(o if has else None, leaf)].append((tree[0], root, proof + top))
    return found


def fold(leaf, proof):
    for left, right in proof:
        leaf = sha(left + leaf + right)
    return leaf


def test_manifest_of_sample(spark):
    docs = read(spark, SF, "documents").collect()
    want = brute_manifest([(d.lang, d.doc_id, entry_of(d.doc_id, d.source, d.lang, d.n_chars, d.text)) for d in docs])
    by_id = {d.doc_id: d for d in docs}
    got = queries.op12_sibling_join_merkle(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        [(subroot, root, proof)] = want[(r.doc_id, r.leaf)]
        d = by_id[r.doc_id]
        touched = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and d.n_chars is not None
        later = fold(entry_of(d.doc_id, d.source, d.lang, d.n_chars + touched, d.text), proof)
        assert (r.subroot, r.root, r.folded_root, r.verified) == (subroot, root, later, later == root)
        assert r.proof_sha256 == sha("".join(a + b for a, b in proof))
        assert r.verified == (not touched)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_of_odd_rows(spark, arity):
    rng = random.Random(arity)
    rows = [(rng.choice([None, "", "a", "é", "z", "\U0001f600", "￿"]), rng.choice([None, *range(40)]), sha(str(rng.random()))) for _ in range(300)]
    rows += [("hot", i, sha(str(i))) for i in range(200)] + [("one", 1, sha("x"))] + [("same", 1, sha("y"))] * 3
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "g string, o long, leaf string, root string, idx int").repartition(6)
    got = merkle.manifest(df, "g", "o", arity=arity)
    assert got.columns == ["g", "o", "leaf", "idx", "subroot", "root", "proof"]
    want = brute_manifest(rows, arity)
    seen = defaultdict(list)
    for r in got.withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof"))).collect():
        proof = [tuple(x.split("|")) for x in r.proof.split(",") if x]
        assert r.folded == r.root
        seen[(r.o, r.leaf)].append((r.subroot, r.root, proof))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}


def test_manifest_of_few_rows(spark):
    empty = spark.createDataFrame([], "g string, o long, leaf string")
    assert merkle.manifest(empty, "g", "o").collect() == []
    one = merkle.manifest(spark.createDataFrame([(None, None, sha("a"))], "g string, o long, leaf string"), "g", "o").first()
    assert (one.subroot, one.root, one.proof) == (sha("a"), sha("a"), "")
    with pytest.raises(ValueError):
        merkle.manifest(empty, "g", "o", arity=1)


# prefix trie


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = sha(f"{len((role or '').encode())}:{role or ''}{text or ''}")
            own[c].append(((turn is not None, turn or 0), role or "", digest, text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(total[k][0] for k in kids[node]) or 1
        saved = sum(total[k][1] for k in kids[node]) + (len(members[node]) - 1) * (words(node[-1][1]) if node else 0)
        total[node] = (leaves, saved)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids[n]), *total[n], sha(",".join(map(str, sorted(c for c in m if full[c] == n)))))
        for n, m in members.items()
    )


def found_trie(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert df.columns == columns
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn int, role string, text string, depth int, ends string").repartition(5)


def test_trie_of_sample(spark):
    rows = [tuple(r) for r in read(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found_trie(queries.op13_parentheses_prefix_trie(spark, SF)) == brute_trie(rows)


def odd_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3_000), 500):
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", "bot", None]), rng.choice(["hi", "hi there", "", None, "a b  c\x0bd é"])))
    same = [(t, "user", f"turn {t} of many") for t in range(9)]
    rows += [(4_000 + i, *s) for i in range(300) for s in same[: 9 - (i % 7 == 0)]]  # copies, some a turn shorter
    rows += [(5_000, t, "user", f"word {t}") for t in range(700)] + [(5_020, t, "user", f"word {t}") for t in range(900)]  # long
    rows += [(5_001, t, "user", f"word {t}") for t in range(600)] + rows[:40] + [(None, 0, "user", "x")]
    return rows


@pytest.mark.parametrize("nodes,turns", [(1 << 17, 24), (1, 2), (40, 1)])
def test_trie_over_shards(spark, monkeypatch, nodes, turns):
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", nodes)
    monkeypatch.setattr(prefix_trie, "SPLIT_TURNS", turns)
    rows = odd_conversations(nodes)
    assert found_trie(prefix_trie.conversation_trie(conversations(spark, rows))) == brute_trie(rows)


def test_trie_of_few_rows(spark):
    assert found_trie(prefix_trie.conversation_trie(conversations(spark, []))) == []
    # h of 1 is 3, and conversation 0 is not there: it has no turns left
    assert zlib.crc32(b"1") % 4 == 3
    for rows in ([(1, 0, "user", "x")], [(1, 0, "user", "x"), (0, 0, None, None)], [(40, None, None, None)]):
        assert found_trie(prefix_trie.conversation_trie(conversations(spark, rows))) == brute_trie(rows)


def test_list_digests_cut_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [("a", i) for i in range(100)] + [("b", 5)] + [(f"c{i}", -i) for i in range(20)]
    got = prefix_trie.id_list_digests(spark.createDataFrame(rows, "k string, v long"), "k", "v").collect()
    want = defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    assert {r.key: r.ends for r in got} == {k: sha(",".join(map(str, sorted(v)))) for k, v in want.items()}
    assert len(got) == len(want)


@pytest.mark.parametrize("block", [1, 4, 64])
def test_findclose(block):
    rng = random.Random(block)
    for n in (1, 2, 3, 50, 700):
        bits, depth = [1], 1  # a random walk that comes back
        while len(bits) < 2 * n - depth:
            up = depth == 1 or rng.random() < 0.55
            bits.append(int(up))
            depth += 1 if up else -1
        bits += [0] * depth
        tree = prefix_trie.Parentheses(np.array(bits, np.uint8), block)
        want, stack = {}, []
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        closes = tree.findclose(tree.opens)
        assert dict(zip(tree.opens.tolist(), closes.tolist())) == want
        leaves = [sum(want[j] == j + 1 for j in range(i, want[i]) if bits[j]) for i in tree.opens.tolist()]
        assert tree.leaves(tree.opens, closes).tolist() == leaves
