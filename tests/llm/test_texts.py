"""Operators 11 to 13: pieces, phrases, spelling variants."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from gradeflow.llm import phrases, pieces, spelling

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=MODEL)


ODD = ["", None, " ", "  a  b ", "a▁b", "▁▁", "\0x\n\ty", "</s><0x0A> <unk>", "😀é漢字", "a b　c", "⁇ x", "\n \n  \t", "=" * 999, "漢" * 5000, "the cat " * 5000, "x" + " " * 100_000 + "漢", "\n" * 3000]


def test_pieces_equal_the_library(spark, library):
    rnd = random.Random(11)
    letters = list("abcdefthinong  =-#*.,'\n▁é漢ingtheaaa")
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(800)] + ["x" + " " * n + e for n in range(40) for e in ("a", "漢", "", "the")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in pieces.encoded(docs, model=MODEL, decode=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_eos=True)
        assert got[i].ids == want, repr(t)[:80]
        assert got[i].decoded == library.decode(want)


def test_pieces_merge_from_the_left_in_turn(library):
    """Pairs of equal rank that overlap, and merges that make a better pair, go one after the other."""
    import pyarrow as pa

    rnd = random.Random(4)
    table = pieces.Pieces(MODEL)
    texts = ["".join(rnd.choice("aabbee==--  tion") for _ in range(rnd.randrange(80))) for _ in range(4000)]
    ids, at = table.encode(pa.array(texts))
    assert all(ids[at[k] : at[k + 1]].tolist() == library.encode(t) for k, t in enumerate(texts))


def test_pieces_forget_words_and_still_agree(library):
    import pyarrow as pa

    table = pieces.Pieces(MODEL, most=5)
    for texts in (["one two three", "four"], ["five six seven eight", "one"], ["two two"]):
        ids, at = table.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [library.encode(t) for t in texts]


def test_pieces_of_repeated_null_and_no_rows(spark, library):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (1, "b"), (1, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.ids) for r in pieces.encoded(docs, model=MODEL, end=False).collect())
    assert got == [("1", []), ("1", library.encode("b")), ("None", library.encode("a")), ("None", library.encode("a"))]
    assert pieces.encoded(docs.where("false"), model=MODEL).count() == 0


def test_decoding_lists_of_ids(spark, library):
    lists = [[], None, [1, 2], [0, 264], [3 + 0xE6, 3 + 0xBC, 3 + 0xA2], [3 + 0x20, 264], [28705, 264, 2, 287], [259, 264]]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in pieces.decoded(rows, model=MODEL).collect()}
    assert got == {i: None if x is None else library.decode(x) for i, x in enumerate(lists)}


def plain_collocations(rows, least, depth, top=2000):
    counts, sizes, out = defaultdict(Counter), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            counts[lang].update(tuple(w[i : i + k]) for i in range(len(w)) for k in range(1, depth + 1) if i + k <= len(w))
    for lang, f in counts.items():
        outer, scored = Counter(), []
        for p, a in f.items():
            if a >= least:
                for k in range(2, len(p)):
                    for i in range(len(p) - k + 1):
                        outer[p[i : i + k]] = max(outer[p[i : i + k]], a)
        for p, a in f.items():
            if len(p) > 1 and a >= least and 100 * outer[p] < 80 * a:
                s, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, sizes[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("route_rows", "chunk"), [(1_000_000, 300_000), (40, 50)])
def test_collocations_equal_plain_counts(spark, route_rows, chunk):
    """Routes dealt on and chunks of single routes give the counts of one."""
    rnd = random.Random(2)
    words = ["a", "B", "cc", "é", ". ", "; x", "\n", "d\t", "  "]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randrange(40))), rnd.choice(["en", None, "de"])) for _ in range(300)]
    rows += [("hot word again " * 400, "en"), (None, "en"), ("", None), ("...", "fr"), ("q", None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, f int, n int")
    got = sorted(map(tuple, phrases.collocations(docs, route_rows=route_rows, chunk=chunk, sample=1.0).collect()))
    assert got == plain_collocations(rows, 30, 4)
    assert len(got) > 20


def test_collocations_ties_and_top(spark):
    rows = [("x y. a b. b a", "en")] * 40 + [("zz zz zz zz zz", "de")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = sorted(map(tuple, phrases.collocations(docs, top=2).collect()))
    assert got == plain_collocations(rows, 30, 4, 2)
    assert phrases.collocations(docs.where("false")).count() == 0


def test_equal_partitions_count_prefixes():
    import numpy as np

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (3, 500))
    keys[2, rng.random(500) < 0.3] = -1
    keys[1:, rng.random(500) < 0.3] = -1
    route, weight = rng.integers(0, 4, 500), rng.integers(1, 5, 500)
    want = Counter()
    for k in range(500):
        for d in range(1, 4):
            if keys[d - 1, k] >= 0:
                want[route[k], *keys[:d, k].tolist()] += int(weight[k])
    got = {(route[p], *keys[:d, p].tolist()): int(f) for a, b, c in phrases.equal_partitions(keys, weight, route, np.full((3, 4), 20)) for p, d, f in zip(a, b, c, strict=True)}
    assert got == {k: f for k, f in want.items() if f >= 20}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_forms(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v), default=None) for w, vs in near.items()}
    form = {w: f if f and words[f] >= 5 * words[w] else None for w, f in form.items()}
    out = {}
    for w, f in form.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (words[w], len(near[w]), f, words[f] if f else None, root)
    return out


@pytest.mark.parametrize(("most", "chunk"), [(20_000, 100_000), (12, 40)])
def test_spelling_equals_all_pairs(spark, most, chunk):
    """Also where files are cut down to single places and scanned in small chunks."""
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(2, 9))): rnd.choice([1, 5, 30, 200, 1500]) for _ in range(700)}
    words |= {"prefix" + "z" * k: 5**k for k in range(8)} | {"q" * 3000: 5, "q" * 2999 + "r": 50}
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long"), most=most, chunk=chunk).collect()}
    assert got == plain_forms(words)


def test_sorted_scan_skips_nothing_near():
    import numpy as np

    rnd = random.Random(3)
    for letters in ("ab", "abcd") * 8:
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9))) for _ in range(60)})
        file = np.array([k > len(words) // 2 for k in range(len(words))])
        a, b = spelling.Sorted([w.encode() for w in words], file).near(np.arange(len(words)))
        want = {(i, j) for i in range(len(words)) for j in range(len(words)) if file[i] == file[j] and i != j and one_edit(words[i], words[j])}
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
        assert len(a) == len(want)


def test_vocabulary_counts_runs_and_leaves_out_code_points(spark):
    rnd = random.Random(9)
    base = ["Straße", "ÀÉÎõüÿ", "foreign-word", "words×words", "abcdefg", "x", "naïvely"]
    rows = [(rnd.choice([None, *range(40)]), " ".join(rnd.choice(base) for _ in range(30)), "z") for _ in range(300)] + [(1, None, "z"), (2, "", "z"), (3, "a" * 100_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            want[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 7 == 0 else w] += 1
    got = {r.word: r.n for r in spelling.vocabulary(docs, noise=7).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    assert spelling.spelling_forms(spelling.vocabulary(docs.where("false"))).count() == 0
