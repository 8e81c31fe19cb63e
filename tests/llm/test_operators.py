"""Each operator against a brute-force version, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeflow.llm import hilbert, hnsw, jaccard, langid, mixing, packing, pii, quality, urlfilter, vptree
from gradeflow.llm.common import shingle_sets, utf8
from gradeflow.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, families=12, copies=6):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    passage = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for f in range(families):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 4, 6, 12, 30, 80, 200, 500]))]
        if f % 3 == 0:
            base[1:1] = passage
        for c in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 40, len(base) // 20])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts.append(rng.choice([" ", "\n", "  "]).join(own) + rng.choice(["", " ", "\t"]))
    texts += [None, "", " \n ", "one", "ONE", "one two", "a b c d", "A b c  d", "\u00a0x", "x" * 5000, texts[0], texts[0].upper() if texts[0].isascii() else texts[0]]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def components(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute_sets(rows, words):
    out = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("words,num,den,leaf", [(4, 85, 100, 256), (5, 80, 100, 4), (2, 50, 100, 8)])
def test_jaccard_against_all_pairs(spark, words, num, den, leaf):
    rows = corpus(words)
    sets = brute_sets(rows, words)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = [(i, len(sets[i]), c) for i, c in enumerate(components(len(rows), links))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, fp int").repartition(5)
    for tokens in (1 << 21, 300):
        got = jaccard.jaccard_components(docs, words=words, num=num, den=den, leaf_rows=leaf, leaf_tokens=tokens)
        assert sorted(map(tuple, got.collect())) == want


def test_bounds_of_count_points_keep_every_link():
    rng = np.random.default_rng(8)
    sets = []
    for size in (3, 40, 300, 1000, 1100, 5000):
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        for change in (0, size // 20, size // 9, size // 3):
            sets.append(np.unique(np.concatenate([base[change:], rng.integers(0, 2**64, change, dtype=np.uint64)])))
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    pts, sizes = jaccard.folded(jaccard.points(np.concatenate(sets), at)), np.diff(at)
    assert pts.shape == (len(sets), 128) and (pts.sum(1) == sizes).all()
    found = {(i, j) for i, js in jaccard.candidates(*jaccard._sides(np.zeros(len(sets), int), pts, sizes), pts, sizes, 80, 100) for j in js.tolist()}
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            same = len(np.intersect1d(s, t))
            if i != j and 100 * same >= 80 * (len(s) + len(t) - same):
                assert (i, j) in found
    assert len(found) < 100


def test_points_of_counts_beyond_16_bits():
    many, few = np.arange(70_000, dtype=np.uint64) << np.uint64(9), np.arange(2000, dtype=np.uint64)
    raw = jaccard.points(np.concatenate([many, few]), np.array([0, 70_000, 72_000]))
    assert [len(r) for r in raw] == [2048, 1024]
    assert jaccard.folded(raw)[0].tolist() == [70_000] + [0] * 511 and jaccard.folded(raw)[1].sum() == 2000


def test_jaccard_empty_table_null_ids_and_repeated_rows(spark):
    kind = "doc_id long, text string"
    assert jaccard.jaccard_components(spark.createDataFrame([], kind)).count() == 0
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None), (9, None), (None, long), (None, long), (7, long + " end"), (None, "z " + long)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, kind)).collect()
    # a row without an id links like any other
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got) == [(-1, 0, -1), (-1, 2, 3), (-1, 56, 7), (-1, 56, 7), (-1, 57, 7), (3, 2, 3), (3, 2, 3), (7, 57, 7), (9, 0, 9)]


def test_jaccard_shared_passages_join_no_family(spark, monkeypatch):
    """Documents that share passages but cannot link join no family, so no family grows with the table; near copies still do."""
    rng = np.random.default_rng(5)
    passages = [" ".join(f"p{k}w{i}" for i in range(70)) for k in range(12)]
    rows = [(i, " ".join([*(passages[k] for k in rng.choice(12, 2, replace=False)), *(f"d{i}w{j}" for j in range(45))])) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + f" x{i}") for i in range(0, 40, 2)]
    # a set of one text in many cells: near copies of which no two are equal
    rows += [(2000 + i, " ".join(f"c{j}" if j != i else f"e{i}" for j in range(200))) for i in range(100)]
    joined, found = jaccard.connected_components, {}

    def seen(edges, tag="components"):
        out = joined(edges, tag)
        found[tag] = out.groupBy("component").count().toPandas()["count"].tolist()
        return out

    monkeypatch.setattr(jaccard, "connected_components", seen)
    got = dict(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=5, num=80, den=100).select("doc_id", "component_id").collect())
    assert sorted(found["jaccard-families"]) == [2] * 20 + [100]
    assert all(got[i] == (2000 if i >= 2000 else i - 1000 if i >= 1000 else i) for i in got) and len(got) == 520


@pytest.mark.parametrize("size", [3, 500])
def test_jaccard_meetings_and_pairs_against_plain_python(size):
    """Meetings are the sets of members of cells, whatever the batches; pairs near by their bounds are those of the plain sum."""
    rng = np.random.default_rng(size)
    cell, fp = np.sort(rng.integers(-40, 40, 300)), rng.integers(0, 30, 300)
    cell[100:150] = cell[100]  # a cell over several batches
    cell.sort()
    batches = [pa.RecordBatch.from_pydict({"cell": cell[a : a + size], "fp": fp[a : a + size]}) for a in range(0, 300, size)]
    got = pa.Table.from_batches(jaccard._meetings(iter(batches))).to_pandas()
    sets = {frozenset(fp[cell == c].tolist()) for c in cell.tolist()}
    by = got.groupby("meeting")
    assert {frozenset(g.fp.tolist()) for _, g in by} == {x for x in sets if len(x) > 1} and not got.duplicated().any()
    assert all((g["first"] == g.fp.min()).all() and (g["last"] == g.fp.max()).all() for _, g in by)

    counts = [rng.integers(0, 9, 128) if k % 3 else rng.integers(0, 3, 512) for k in range(60)]
    sizes, raw = np.array([c.sum() for c in counts]), [c.astype("<u2").tobytes() for c in counts]
    i, j = np.triu_indices(60, 1)
    plain = lambda a, b: np.minimum(*(counts[k].reshape(-1, min(len(counts[a]), len(counts[b]))).sum(0) for k in (a, b))).sum()
    room = [min(plain(a, b), *sizes[[a, b]]) >= jaccard.least_overlap(sizes[a] + sizes[b], 46, 100) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert jaccard.near(raw, sizes, i, j, 46, 100).tolist() == room and any(room) and not all(room)


@pytest.mark.parametrize("law", [jaccard.LAW, jaccard.Law(10, 3)])
def test_every_linked_pair_shares_a_cell(law):
    rng = np.random.default_rng(5)
    for size in (7, 13, 20, 33, 60, 200, 900):
        for _ in range(20):
            s = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            t = s.copy()
            for _ in range(size):  # as many changes as the threshold allows
                u = t.copy()
                u[rng.integers(len(u))] = rng.integers(0, 2**64, dtype=np.uint64)
                u = np.unique(u)
                same = len(np.intersect1d(s, u))
                if 100 * same < 85 * (len(s) + len(u) - same):
                    break
                t = u
            v = jaccard._fingerprints(np.concatenate([s, t]), at := np.array([0, len(s), len(s) + len(t)]))[0]
            cell, whose = jaccard._dealt(np.concatenate([s, t]), v, at, 85, 100, law, np.zeros(2, bool))
            assert set(cell[whose == 0]) & set(cell[whose == 1]) or np.array_equal(s, t)


def test_shingle_sets_count_whole_texts():
    rows = corpus(9)
    import pyarrow as pa

    s, at = shingle_sets(*utf8(pa.array([t for _, t in rows], pa.string())), 4)
    assert np.diff(at).tolist() == [len(x) for x in brute_sets(rows, 4)]


def test_components_chain_hub_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(7, 7), (300, 301), (301, 300), (None, 4)] + [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(60)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()))
    want = components(600, [(a, b) for a, b in edges if a is not None])
    assert got == {i: want[i] for e in edges if None not in e and e[0] != e[1] for i in e}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(n=400, dim=12, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    for i in range(0, n, 4):
        base[i + 1 : i + 3] = base[i] + rng.normal(size=(min(2, n - i - 1), dim)) * 0.08
    base[50:58] = base[49]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    return rows + [(n, None), (n + 1, []), (n + 2, [0.0] * dim), (n + 3, [float("nan")] * dim), (n + 4, [None] + [1.0] * (dim - 1)), (n + 5, [float("inf")] + [1.0] * (dim - 1)), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (None, [1.0] * dim)]


def brute_cosines(rows):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    return {(i, j): float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) for i, a in good.items() for j, b in good.items() if i != j and len(a) == len(b)}


def test_nearest_exact_relaxed_and_odd_vectors(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string")
    cos = brute_cosines(rows)
    asked = df.where("vec_id % 7 = 0 or vec_id > 400")
    got = defaultdict(list)
    for r in vptree.nearest(df, asked, k=5, shard_rows=90, least_shards=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in {i for i, _ in cos} & ({i for i in range(0, 410, 7)} | set(range(401, 410))):
        want = sorted(((j, c) for (i, j), c in cos.items() if i == q), key=lambda x: (-round(x[1], 12), x[0]))[:5]
        assert [v for v, _ in got[q]] == [v for v, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-12)
    loose = {(r.query_id, r.vec_id) for r in vptree.nearest(df, asked, k=5, factor=2.0, shard_rows=90, least_shards=3).collect()}
    exact = {(q, v) for q, vs in got.items() for v, _ in vs}
    assert len(loose & exact) >= 0.9 * len(exact)
    assert vptree.nearest(df.limit(0), asked).count() == 0


def test_nearest_ranks_parallel_vectors_by_the_final_measure(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=24)
    rows = [(i, (v * c).tolist()) for i, c in enumerate(rng.uniform(0.01, 100, 60))] + [(60 + i, rng.normal(size=24).tolist()) for i in range(40)] + [(100 + i, (v * 2).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from gradeflow.llm.vectors import cosines

    x = np.array([r[1] for r in rows])
    got = defaultdict(list)
    for r in vptree.nearest(df, df, k=5, shard_rows=50, block_queries=40).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(len(rows)):
        score = cosines(np.repeat(x[q : q + 1], len(x), 0), x)
        want = [(j, score[j]) for j in sorted((j for j in range(len(x)) if j != q), key=lambda j: (-score[j], j))[:5]]
        assert got[q] == want, q


def test_near_vectors_against_all_pairs(spark):
    rows = vectors(600)
    df = spark.createDataFrame([*rows, rows[5]], "vec_id long, embedding array<float>")
    links = [p for p, c in brute_cosines(rows).items() if c >= 0.95]
    root = components(700, links)
    want = {i: (sum(a == i for a, _ in links), root[i], root[i] == i) for i, _ in rows if i is not None}
    for how in ({"shard_rows": 150}, {"shard_rows": 90, "widest": 1, "beam": 1}, {"least_shards": 1}):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(df, **how).collect()}
        assert got == want, how
    assert hnsw.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_audits_each_search_on_planted_groups(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(120, 32))
    vecs = np.concatenate([rng.normal(size=(1500, 32)), np.repeat(centres, 6, 0) + 0.08 * rng.normal(size=(720, 32)), rng.normal(size=(1, 32)) + 0.05 * rng.normal(size=(700, 32))])
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    out, audits = hnsw.audited_near_vectors(df, widest=128)
    audits = audits.collect()
    assert {(r.graph_shard, r.asking_shard) for r in audits} == {(i, j) for i in range(4) for j in range(4)}
    assert all(r.sampled > 20 and r.recall >= 0.999 for r in audits)
    unit = vecs.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.95).sum(1) - 1
    got = {r.vec_id: r.n_links for r in out.collect()}
    found = np.array([got[i] for i in range(len(vecs))])
    assert (found <= true).all() and found.sum() >= 0.999 * true.sum() and (found[2220:] == true[2220:]).all()


def graph(vecs, ids=None, copies=None):
    return hnsw.HNSW(np.arange(len(vecs)) if ids is None else ids, vecs, copies)


def test_graph_finds_crowded_neighbourhoods_and_comes_back_from_bytes():
    rng = np.random.default_rng(0)
    vecs = np.concatenate([rng.normal(size=(1, 16)) + 0.05 * rng.normal(size=(300, 16)), rng.normal(size=(700, 16))])
    g = hnsw.HNSW.unpacked(graph(vecs).packed())
    a, b, crowded = g.within(vecs, 0.95, 64)
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    true = (unit @ unit.T) >= 0.95
    assert not len(crowded) and true[a, g.ids[b]].all() and len(a) >= 0.999 * true.sum() and len(set(zip(a, b, strict=True))) == len(a)
    assert set(g.within(vecs, 0.95, 16, 128)[2]) == set(range(300))


def test_audit_asks_for_ordinary_vectors_beside_a_crowd(monkeypatch):
    rng = np.random.default_rng(1)
    single = rng.normal(size=(300, 16))
    crowd = rng.normal(size=(1, 16)) + 0.05 * rng.normal(size=(900, 16))
    g = graph(np.concatenate([crowd, single, single + 0.01 * rng.normal(size=single.shape)]))
    whole = hnsw.HNSW.within

    def losing(self, q, threshold, beam, widest=None):
        """Below a beam of 100 the links of all vectors but the crowd's are lost."""
        a, b, crowded = whole(self, q, threshold, beam, widest)
        size = np.bincount(a, minlength=len(q))
        own = np.array([(self.vecs[j] == q[i]).all() for i, j in zip(a, b, strict=True)], bool)
        keep = own | (size[a] > 50) | (beam >= 100)
        return a[keep], b[keep], crowded

    monkeypatch.setattr(hnsw.HNSW, "within", losing)
    assert hnsw._Direction(g, g, 0.95, 16, 4096, 64, 0.999).beam >= 100
    # where no beam is wide enough, all are compared with all
    narrow = hnsw._Direction(g, g, 0.95, 16, 64, 64, 0.999)
    assert narrow.recall < 0.999 and len(narrow.crowded) == 1500
    lone = graph(rng.normal(size=(3, 16)))
    assert hnsw._Direction(lone, lone, 0.95, 16, 512, 64, 0.999).recall is None


def test_a_link_found_from_one_end_counts_at_both(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    left, right = graph(base), graph(base + 0.001, np.arange(40) + 100, np.full(40, 3))
    whole = hnsw.HNSW.within

    def one_way(self, q, *how):
        a, b, crowded = whole(self, q, *how)
        return (a, b, crowded) if self is right else (a[:0], b[:0], crowded)

    monkeypatch.setattr(hnsw.HNSW, "within", one_way)
    counts, label, _ = hnsw.links_between(left, right, 0.99999, audit=0)
    assert (counts[:40] == 3).all() and (counts[40:] == 1).all() and len(set(label)) == 40


def test_hilbert_neighbours_touch(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        axes = [F.floor(F.col("id") / (1 << (bits * k))).cast("long") % (1 << bits) for k in range(n)]
        rows = spark.range(1 << (bits * n)).select(*[a.alias(f"a{k}") for k, a in enumerate(axes)], hilbert.hilbert_index(axes, bits).alias("h")).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(1 << (bits * n)))
        assert all(sum(abs(a[k] - b[k]) for k in range(n)) == 1 for a, b in zip(rows, rows[1:]))


def test_hilbert_shards_are_even_runs(spark):
    rows = [(i, f"text {i}" * (i % 9) if i % 11 else None, "hot" if i % 3 else f"s{i % 17}", None if i % 13 == 0 else "en", i * i % 1000, 1) for i in range(1003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, shard int").repartition(6)
    got = hilbert.hilbert_shards(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(1003))
    by = defaultdict(list)
    for r in got:
        t = rows[r.doc_id][1] or ""
        assert (r.size, r.text_crc32) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        by[r.shard].append(r)
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    runs = [[r.curve for r in sorted(by[s], key=lambda r: r.slot)] for s in range(8)]
    flat = [c for run in runs for c in run]
    assert flat == sorted(flat)
    assert hilbert.hilbert_shards(docs.limit(0)).count() == 0
    assert {r.shard for r in hilbert.hilbert_shards(docs.limit(3)).collect()} <= set(range(8))


def test_hilbert_cuts_texts_at_whole_values(spark):
    rows = [(i, f"common_crawl_{2000 + i % 8}" if i % 9 else None) for i in range(900)]
    df = spark.createDataFrame(rows, "i long, `a.b` string").repartition(5)
    assert hilbert.text_cuts(df, "a.b", 8) == [f"common_crawl_{y}" for y in range(2001, 2008)]
    assert len({r._q0 for r in hilbert.quantised(df, ["a.b"], 3).collect()}) == 8
    hot = spark.createDataFrame([(["hot", "hot", f"s{i:04}"][i % 3],) for i in range(999)], "v string")
    cuts = hilbert.text_cuts(hot, "v", 8)
    assert len(cuts) == 3 and cuts == sorted(cuts) and cuts[0] == "s0002"
    assert hilbert.text_cuts(hot.limit(0), "v", 8) == []


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(None, "a", "x"), (None, "b", "x"), (7, "c", "y"), (7, "d", "z"), (7, "d", "z"), (8, None, None), (9, "", "é"), (10, "long " * 100_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'de' as lang", "1 as n_chars", "5 as _slot")
    hilbert.write_shards(docs, hilbert.hilbert_shards(docs, shards=3), f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(map(repr, (tuple(r) for r in back.select("doc_id", "text", "source").collect()))) == sorted(map(repr, rows))
    assert "_slot" in back.columns and back.select("shard").distinct().count() == 3


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = corpus(4) + [(900, "It's THE café's «naïve» İstanbul e\u0301 H\u0331 x=\u0338y 12,5% a.b'c <|endoftext|> <|startoftext|>q ♥♥ don't\u2003stop"), (901, "word " * 5000), (902, "'s 's'd ..'ll ''re\x01\x02 \x7f\u0085z"), (None, "no id"), (903, "ÀÉ ß ŒUVRE straße")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(3)
    pieces = packing.packed_sequences(docs, tokenizer=path, window=64, block_docs=40)
    crc = {(r.doc_id, r.start): r for r in packing.with_crc(pieces).collect()}
    got, used = defaultdict(list), defaultdict(list)
    for r in pieces.collect():
        got[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) <= 64
        if r.doc_id is not None:
            assert crc[r.doc_id, r.start].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    tokenizer = Tokenizer.from_file(path)
    for i, t in rows:
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(got[i], key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == want, t
        assert [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist()
        assert {r.doc_tokens for r in own} == {len(want)}
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 64
    assert packing.packed_sequences(docs.limit(0), tokenizer=path).count() == 0


def test_packing_deals_null_ids_to_all_blocks(spark):
    docs = spark.createDataFrame([(None, f"text {k}") for k in range(400)], "doc_id long, text string")
    pieces = packing.packed_sequences(docs, tokenizer=public_tokenizers.path("word_bpe_49k.json"), block_docs=100)
    per_block = pieces.groupBy((F.col("sequence_id") / 2**40).cast("long").alias("block")).count().collect()
    assert len(per_block) == 4 and sum(r["count"] for r in per_block) == 400 and max(r["count"] for r in per_block) < 200


def test_levels_follow_the_sum_of_squares():
    rng = random.Random(1)
    levels, fill = packing.Levels(32), {}
    for _ in range(2000):
        size = rng.randint(1, 31)
        count = defaultdict(int)
        for f in fill.values():
            if f < 32:
                count[f] += 1
        costs = {}
        for h in [0, *count]:
            if h + size <= 32:
                after = dict(count)
                if h:
                    after[h] -= 1
                if h + size < 32:
                    after[h + size] = after.get(h + size, 0) + 1
                costs[h] = sum(v * v for v in after.values())
        number, level = levels.place(size)
        assert fill.get(number, 0) == level and costs[level] == min(costs.values())
        fill[number] = level + size


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(t):
    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base_spans_against_plain_patterns(spark):
    rng = random.Random(8)
    bits = ["a.b@c.de", "x@y", "@", "a@b@c.com", "@@q.r", "1.2.3.4", "1.2.3.400", "1.2.3.4.5.6.7.8", "0255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+1", "+49.30.1234567.", "é", " ", " ", ".", "-", "7", "12", "\n", "é@ü.de", "GB82 WEST 1234 5698 7654 32", "iban", "123-45-6789", "ssn"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))) for i in range(1500)] + [(2000, None), (2001, ""), (2002, "9" * 3000 + "." + "a" * 3000)]
    for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        t = (rows[r.doc_id][1] if r.doc_id < 2000 else dict(rows)[r.doc_id]) or ""
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] == base_spans(t)
        assert all(s.text == t[s.start : s.end] for s in r.spans)


def test_pii_checks_context_and_masks(spark):
    kinds = lambda t: [s[0] for s in pii.scored(t, 0.6)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 ok") == ["iban"] and kinds("IBAN GB83 WEST 1234 5698 7654 32") == []
    assert kinds("my ssn: 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == [] and kinds("ssn 000-45-6789") == []
    docs = spark.createDataFrame([(1, "mail a@b.com or 1.2.3.4", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, spans string")
    assert sorted(map(tuple, pii.redact_pii(docs).collect()), key=lambda r: r[0]) == [(1, "mail [EMAIL] or [IP]", "x"), (2, None, "y"), (3, "", "z")]


def test_pii_ibans_before_capitals_and_numbers():
    found = lambda t: [t[a:b] for k, a, b in pii.proposed(t) if k == "iban"]
    plain, spaced = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"
    unknown = next(f"QX{k:02d}370400440532013000" for k in range(98) if pii.mod97(f"QX{k:02d}370400440532013000"))
    for iban in (plain, spaced, unknown):
        for after in ("", " BIC COBADEFFXXX", " 12", " 2024 EUR", " Bank", ".", " A B C D E F G H I J K L M N O P", "\nBIC", " BIC lower"):
            assert found(f"IBAN {iban}{after}")[0].startswith(iban) and found(iban + after) == [iban], (iban, after)
        assert found(iban + "X") == found("X" + iban) == found(iban + "x") == []
    assert found(f"{plain} {spaced} AB12 {plain}") == [plain, spaced, plain]
    assert found("GB83 WEST 1234 5698 7654 32 BIC") == [] and found("DE89 " * 20000) == []
    t = f"IBAN {plain} BIC COBADEFFXXX"
    assert pii.masked(t, pii.scored(t, 0.6)) == "IBAN [IBAN] BIC COBADEFFXXX"


def test_pii_secrets_need_words_near_them(spark):
    hexed = "04db9f8e7c6a5b4d3e2f1a0b9c8d7e6f5a4b3c2d"
    texts = [f'so token = "{hexed}" here', f"TOKEN: {hexed.upper()}", f"checksum of it {hexed} here", f"plain {hexed} run", "secret " + "x" * 50, "key " + "1" * 40, "token " + "a1" * 20, "token " + hexed * 20]
    found = {r.doc_id: r.spans for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [[(s.kind, s.text) for s in found[i]] for i in range(len(texts))] == [[("secret", hexed)], [("secret", hexed.upper())], [], [], [], [], [], []]
    assert pii.masked(texts[0], pii.scored(texts[0], 0.6)) == 'so token = "[SECRET]" here'


def labelled():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(800)]
    rows, labels = [], []
    for i in range(1500):
        good = rng.random() < 0.8
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 150))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words) if i % 2 else " ".join([words[0]] * 30 + words[:3])
        rows.append((i, text))
        if i % 2 or not i % 5:
            labels.append((i, int(good)))
    return rows, labels, vocab


def test_quality_on_held_out_rows(spark):
    rows, labels, _ = labelled()
    docs = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit_quality(docs, lab)
    assert abs(model.prior - 0.8) < 0.12
    got = {r.doc_id: r.score for r in quality.with_quality(docs, model).collect()}
    held = [(got[i], q) for i, q in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(s >= 0.3) == q for s, q in held]) > 0.97 and all(0 <= s <= 1 for s in got.values())
    assert got[9000] == got[9001]
    assert quality.fit_quality(docs, lab.where("quality = 0")) is None
    assert quality.with_quality(docs.limit(0), None).count() == 0


def test_languages_on_held_out_rows(spark):
    rng = random.Random(6)
    parts = {"xx": "ka ki ko lu mu", "yy": "ßen sch ung ein der", "zz": "ção ment que los est"}
    rows = []
    for i in range(900):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choice(parts[lang].split()) for _ in range(3)) for _ in range(30)), lang))
    rows += [(2000, None, "xx"), (2001, "12 34 !!", "xx"), (2002, "", None), (2003, "kakiko", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, fit_rows=300)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [i for i, _, _ in rows[:900] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.98
    assert [got[i].lang_pred for i in (2000, 2001, 2002, 2003)] == ["und", "und", "und", "xx"]
    assert langid.identify(spark.createDataFrame([(1, "%%%% qqqq")], "doc_id long, text string"), model).first().rejected
    empty = langid.fit_languages(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_languages_made_mostly_of_copies(spark):
    rng = random.Random(16)
    parts = {"xx": "ka ki ko lu mu", "yy": "ßen sch ung ein der", "zz": "ção ment que los est"}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang].split()) for _ in range(3)) for _ in range(30))
    for salt in range(3):
        rows = [(text(lang), lang) for lang in ("xx", "yy") for _ in range(200)] + [(text("zz"), "zz")] * 3000 + [(text("zz"), "zz") for _ in range(10)]
        docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(5)
        model = langid.fit_languages(docs, F.lit(True), fit_rows=30)
        again = langid.fit_languages(docs.repartition(3), F.lit(True), fit_rows=30)
        assert set(model.langs) == {"xx", "yy", "zz"} and model.langs == again.langs and np.array_equal(model.points, again.points)
        assert {r.lang_pred for r in langid.identify(docs.where("lang = 'zz'"), model).collect()} == {"zz"}
    pairs = [(lang, rng.randint(-50, 50)) for lang in "abc" for _ in range(80)] + [("d", 7)] * 9
    got = langid.least_hashes(spark.createDataFrame(pairs, "lang string, h long"), 20, 4).collect()
    assert sorted(map(tuple, got)) == sorted((lang, h) for lang in "abcd" for h in sorted({h for k, h in pairs if k == lang})[:20])


def test_more_languages_than_sampled_rows(spark):
    rows = [(i, f"text {i} of {chr(97 + i % 26)}", f"l{i % 40:02d}" if i < 400 else "l07") for i in range(430)] + [(900 + i, "one", f"rare{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, F.lit(True), fit_rows=12)
    # ten rows each but thirty more of l07; ties by name
    assert sorted(set(model.langs)) == [f"l{i:02d}" for i in range(12)] and len(model.points) == 12
    assert {r.lang_pred for r in langid.identify(docs, model).collect()} <= set(model.langs)


def test_nearest_centroid_by_plain_cosines(spark):
    rng = random.Random(26)
    texts = ["".join(rng.choice("abcdeéß ") for _ in range(rng.choice([0, 1, 3, 40, 400]))) for _ in range(120)] + ["", "a" * 200_000, "abc", "abc"]
    docs = spark.createDataFrame([(i, t, "xyz"[i % 3]) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.fit_languages(docs, F.lit(True), fit_rows=60, per_lang=3)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for i, t in enumerate(texts):
        if not any(map(str.isalpha, t)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        v = [math.log1p(c) * w for c, w in zip(langid.counts(pa.array([t]))[0].tolist(), model.idf.tolist(), strict=True)]
        norm = math.sqrt(sum(x * x for x in v)) or 1
        cosines = [sum(x * y for x, y in zip(v, p, strict=True) if x) / norm for p in model.points.tolist()]
        best = max(cosines)
        assert abs(got[i].score - min(1, max(0, best))) < 1e-5
        assert got[i].lang_pred in {lang for lang, c in zip(model.langs, cosines, strict=True) if c > best - 1e-5}


def test_urls_against_every_rule(spark):
    rng = random.Random(7)
    hosts = ["net", "example.net", "m.example.net", "xexample.net", "a.b.c.org", "org", "b.c.org", "", "a..net", "EXAMPLE.net", "net.", "example.net:80", "ü.net"]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/en/x', '/en', '/fr/a?q=/de/', '?x', '#y', '/a#/b'])}" for _ in range(600)] + [None, "", "net/en/", "x://y://net/", "a\nb://net/\nq"]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("m.example.net", "/", "block"), ("org", "/fr/a", "allow"), ("c.org", "/", "block"), ("b.c.org", "", "allow"), ("net", "/en/x", "allow"), (None, "/", "block"), ("", "/", "block")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(4)
    got = {r.page_id: r for r in urlfilter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=7).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate(LOWER), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit)[2:] if fit else (None, "allow")
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *best), u
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urlfilter.judge_urls(pages, none).collect()} == {"allow"}
    assert urlfilter.judge_urls(pages.limit(0), none).count() == 0


def mixing_rows():
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), "hot" if i % 3 else rng.choice(["a", "b", "c", None])) for i in range(3000)]
    return rows + [(5000, None, "a"), (5001, "", "b"), (5002, None, "empty"), (5003, "w w", "tiny"), (None, "n n n", "a"), (None, "n n n", "a"), (7, rows[7][1], rows[7][2]), (8, "x" * 300_000, "a")]


def brute_mixture(rows, entropy, budget, block_docs):
    """Copies of each row by hand, from whole passes and the order of blocks in the last one."""
    sizes, docs = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
        docs[s] += 1
    total = sum(sizes.values())
    part = {s: n / total for s, n in sizes.items() if n}

    def spread(a):
        w = np.array([p**a for p in part.values()])
        return float(-(w / w.sum() * np.log(w / w.sum())).sum() / np.log(len(w)))

    lo, hi = 0.0, 1.0
    for _ in range(60):
        lo, hi = ((lo + hi) / 2, hi) if spread((lo + hi) / 2) >= entropy else (lo, (lo + hi) / 2)
    z = sum(p**lo for p in part.values())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = {}
    for s in sizes:
        name = "null" if s is None else "s" + s
        units = defaultdict(int)
        for i, t, o in rows:
            if o == s:
                h = int(sha(f"5:{'' if i is None else i}:{'' if t is None else hashlib.md5(t.encode()).hexdigest()}")[:15], 16)
                units[h, i] += len((t or "").split())
        amount = round(part.get(s, 0) ** lo / z * budget * total) if s in part else 0
        passes, rest = divmod(amount, sizes[s]) if sizes[s] else (1, 0)
        blocks = max(1, -(-docs[s] // block_docs))
        at = 0
        for block in sorted(range(blocks), key=lambda b: sha(f"{name}:{b}:{passes}")):
            for h, i in sorted(k for k in units if k[0] % blocks == block):
                n = units[h, i]
                out[s, h, i] = (passes + (n > 0 and at + n <= rest), at)
                at += n
    return out, lo


def test_mixing_against_brute_force(spark):
    rows = mixing_rows()
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, tokens int, `a.b` int, weight int")
    want, alpha = brute_mixture(rows, 0.97, 1, 64)
    assert 0 < alpha < 1
    sha = lambda i, t: int(hashlib.sha256(f"5:{'' if i is None else i}:{'' if t is None else hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:15], 16)
    where = {(s, i, sha(i, t)): want[s, sha(i, t), i] for i, t, s in rows}
    for parts in (1, 7):
        got = mixing.mixed(docs.repartition(parts), target_entropy=0.97, block_docs=64).collect()
        assert sorted(((r.doc_id or -1, r.source or "", r.copies, r.start) for r in got)) == sorted((i or -1, s or "", *where[s, i, sha(i, t)]) for i, t, s in rows)
    assert len({r.copies for r in got}) > 1
    out = mixing.drawn(docs, target_entropy=0.97, block_docs=64)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_mixing_weights_and_budgets(spark):
    rows = mixing_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    total = sum(sizes.values())
    got = mixing.mixed(docs, target_entropy=0.9, most_repeats=None, block_docs=64).collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i, _, _ in rows)
    weight = {r.source: r.weight for r in got}
    w = np.array([weight[s] for s in sizes if sizes[s]])
    assert abs(w.sum() - 1) < 1e-9 and abs(-(w * np.log(w)).sum() / np.log(len(w)) - 0.9) < 1e-6
    for s in sizes:
        drawn = sum(r.copies * r.tokens for r in got if r.source == s)
        assert weight[s] * total - 41 <= drawn <= weight[s] * total + 1 or not sizes[s]
    assert {r.copies for r in got if r.source == "empty"} == {1}
    capped = mixing.mixed(docs, most_repeats=3.0, budget="cover").collect()
    assert max(r.repeats for r in capped) <= 3.01 and min(r.copies for r in capped) >= 1 and max(r.copies for r in capped) <= 3
    assert mixing.mixed(docs.limit(0), most_repeats=2.0).count() == 0
    assert mixing.drawn(docs.limit(0), most_repeats=2.0).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rows, labels, vocab = labelled()
    rng = random.Random(12)
    clean = [(3000 + i, " ".join(rng.choice(vocab) for _ in range(80)), "en", f"s{i % 3}", 1) for i in range(60)]
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in rows] + clean + [(4000, clean[0][1], "en", "s1", 1), (4001, clean[1][1] + " extra", "en", "s1", 1), (4002, "write to a.b@c.de now " + clean[2][1], None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    table, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if k < 4:
            assert out.columns == table.columns
        table = seen[name]
    ids = lambda n: {r.doc_id for r in seen[n].select("doc_id").collect()}
    assert {c[0] for c in clean} <= ids("quality_classifier") and len(ids("quality_classifier")) < len(docs) - 100
    assert {c[0] for c in clean} <= ids("ngram_jaccard_join") and not {4000, 4001} & ids("ngram_jaccard_join")
    assert seen["pii"].where("text like '%@c.de%'").count() == 0 and ids("pii") == ids("ngram_jaccard_join")
    assert ids("mixing") == ids("pii") and ids("packing") == ids("mixing")
    assert hashlib.sha256(b"").hexdigest()


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    kind = "doc_id long, text string, source string"
    rows = [(3, words(1), "s"), (5, words(1), "s"), (5, words(2), "s"), (5, words(3), "s"), (None, words(2) + " more", "s"), (None, words(4), "b"), (None, words(4), "a"), (None, words(4) + " more", "c"), (None, words(5), None), (9, words(6), "y"), (9, words(6), "x"), (None, None, "s"), (None, None, "s"), (None, "", "s"), (7, None, "s"), (7, "", "s"), (7, "", "s")]
    want = {(3, words(1), "s"), (5, words(2), "s"), (5, words(3), "s"), (None, words(5), None), (9, words(6), "x")}
    for parts in (1, 4):
        got = [tuple(r) for r in corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, kind).repartition(parts), "").collect()]
        assert sorted(map(repr, (r for r in got if not r[1]))) == sorted(map(repr, [(None, None, "s")] * 2 + [(None, "", "s"), (7, None, "s"), (7, "", "s")]))
        fours = [r for r in got if r[1] and r[1].startswith(words(4))]
        assert len(fours) == 1 and fours[0][2] in "ac"
        rest = [r for r in got if r[1] and r not in fours]
        assert set(rest) == want and len(rest) == len(want)
    assert corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame([], kind), "").count() == 0
