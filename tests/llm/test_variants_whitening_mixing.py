"""Spelling variants, whitening and mixing against brute force on small and odd tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from stratolab.llm import mixing, variants, whitening

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_words(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: c for w, c in counts.items() if c >= 5}


def brute_groups(n):
    wild, near = defaultdict(set), {w: set() for w in n}
    for w in n:
        for i in range(len(w)):
            wild[w[:i], w[i + 1 :]].add(w)
    for w in n:
        for i in range(len(w)):
            near[w] |= wild[w[:i], w[i + 1 :]] - {w}
            shorter = w[:i] + w[i + 1 :]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 5 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def test_variants_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute_groups(brute_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    got = rows_of(variants.report(docs))
    assert got == want and any(r[1] for r in got)


def test_variants_of_odd_texts(spark):
    long = "ab" * 20_000
    texts = [None, "", "  ", "short a", "Größen größen GRÖSSEN ÄÖÜäöü×÷ naïveté naiveté", f"{long} {long}c", "wordword " * 700]
    rows = [(None if i % 5 == 0 else i % 11, texts[i % len(texts)], "k", 1) for i in range(91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    want = brute_words([r[:2] for r in rows])
    assert rows_of(variants.report(docs)) == brute_groups(want) and long in want
    assert not variants.report(docs.where("false")).collect() and not variants.report(docs.where("text is null")).collect()


def test_near_words_over_parts(spark):
    """Dense neighbourhoods of a two-letter alphabet, words that are prefixes of others, in many parts and in one."""
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("ab"), rng.integers(1, 9))) for _ in range(400)} | {"a" * k for k in range(1, 30)} | {"é一\U0001f600", "é一"}
    n = {w: int(10 ** rng.integers(0, 6)) for w in words}
    table = spark.createDataFrame([*n.items(), (None, 3), ("", 9)], "word string, n long")
    want = brute_groups(n)
    for parts in (1, 13):
        assert rows_of(variants.groups(table, parts=parts)) == want
    paths = {r.word: r.path for r in variants.tries(table.where("word != ''"), 13).collect()}
    node = {}
    for word, path in paths.items():
        assert len(path) == len(word) + 1
        for k, number in enumerate(path):
            assert node.setdefault(word[:k], number) == number
    assert len(set(node.values())) == len(node)
    assert [w for w, _ in sorted(paths.items(), key=lambda x: x[1][-1])] == sorted(paths)


def test_roots_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 500)], "id long, to long")
    assert {(r.id, r.root) for r in variants.roots(links).collect()} == {(i, 500) for i in [*range(500), 1000]}


def test_inertia_counts_signs():
    rng = np.random.default_rng(5)
    for dim in (1, 2, 7, 40):
        q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        values = rng.choice([-2.0, -1e-3, 1e-3, 1.0, 5.0], dim)
        a = (q * values) @ q.T
        assert whitening.inertia((a + a.T) / 2)[:2] == ((values > 0).sum(), (values < 0).sum())
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]])) == (1, 1, 0)
    assert whitening.inertia(np.zeros((3, 3))) == (0, 0, 3)


@pytest.mark.parametrize("values", [np.arange(30, 0, -1.0), np.repeat([4.0, 2.0, 1.0], 10), 1 + np.arange(30) * 1e-6, np.r_[5.0, np.zeros(29)]])
def test_contours_find_all_components(spark, values):
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((30, 30)))[0]
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    found, axes = whitening.components(spark, v, 22)
    assert np.allclose(found, np.sort(values)[::-1][:22], rtol=0, atol=1e-12 * values.max())
    assert np.abs(axes @ axes.T - np.eye(22)).max() < 1e-8
    assert np.abs(v @ axes.T - axes.T * found).max() < 1e-11 * values.max()


def test_a_missed_component_is_an_error():
    with pytest.raises(ArithmeticError):
        whitening.feast(np.diag([3.0, 2.0, 1.0]), 1.5, 3.5, 3, rounds=5)


def brute_whitened(rows, count=4):
    good = [(i, [math.floor(256 * c) for c in x]) for i, x in rows if x and all(c is not None and math.isfinite(c) for c in x)]
    common = min(Counter(len(x) for _, x in good).items(), key=lambda p: (-p[1], p[0]))[0]
    good = [(i, x) for i, x in good if len(x) == common]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=np.float64)
    n, sums = len(fit), [sum(int(v) for v in column) for column in fit.T]
    centred = fit - fit.mean(axis=0)
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    return [
        (i, k + 1, n, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)),
         (np.array(x) - np.array(sums) / n) @ axes[:, -1 - k] / math.sqrt(e[-1 - k]), e[-1 - k] / e.sum())
        for i, x in good for k in range(count)
    ]


def test_whitening_is_that_of_the_distinct_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    rows += [(7, rows[0][1]), (None, rows[1][1]), (8, None), (9, [None, *rows[0][1][1:]]), (10, [math.nan] * 64), (11, [math.inf] * 64), (12, []), (13, [1.0, 2.0])]
    wide = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<float>, x int, n int")
    got = whitening.whitened(wide).collect()
    want = brute_whitened(rows)
    key = lambda r: (str(r[0]), r[1], r[3], abs(r[4]))
    pairs = list(zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True))
    for k in range(1, 5):
        sign = next(math.copysign(1, a[4] * b[4]) for a, b in pairs if a[1] == k)  # one for all rows
        for a, b in (p for p in pairs if p[0][1] == k):
            assert a[:4] == b[:4] and math.isclose(a[4], sign * b[4], abs_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-9)
            assert a[6] < 1e-9


def test_whitening_of_few_and_large_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert not whitening.whitened(make([])).collect() and not whitening.whitened(make([(1, None), (2, [])])).collect()
    one = whitening.whitened(make([(1, [0.5, -0.0, 2.0]), (2, [0.5, 0.0, 2.0])])).collect()
    assert len(one) == 6 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in one)
    line = whitening.whitened(make([(k, [float(k), 0.0, 0.0, 0.0, 1.0]) for k in range(4)])).collect()
    first = [r for r in line if r.component == 1]
    assert all(math.isclose(r.explained, 1.0) and r.identity_error < 1e-12 for r in first)
    assert all(r.whitened is None and r.explained == 0 for r in line if r.component > 1)
    assert sorted(r.deviation for r in first) == [256 * 256 * 4, 256 * 256 * 4, 256 * 256 * 36, 256 * 256 * 36]
    large = whitening.whitened(make([(1, [1e9, 0.0]), (2, [-1e9, 1.0]), (3, [0.0, 5.0])])).collect()
    x = 256 * 10**9
    assert {(r.vec_id, r.deviation) for r in large} == {(i, d if d < 1 << 63 else None) for i, d in ((1, 9 * x * x + 1536**2), (2, 9 * x * x + (768 - 1536) ** 2), (3, (3 * 1280 - 1536) ** 2))}
    with pytest.raises(ValueError, match="max_dim"):
        whitening.whitened(make([(1, [0.0] * 5)]), max_dim=4)


def brute_mix(rows, share=1.5, most=2):
    """(doc_id, size, source_size, target, taken), sources filled by repeated resharing of what is above their limit."""
    size = [len(re.findall(mixing.WORD, t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    have = {s: sum(z for z, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while True:
        left = share * sum(have.values()) - sum(target.values())
        each = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if each[s] > most * have[s]}
        if not over:
            target |= each
            break
        target |= {s: float(most * have[s]) for s in over}
        open_ -= over
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    order = sorted(range(len(rows)), key=lambda k: (md5("" if rows[k][0] is None else str(rows[k][0])), rows[k][0] is not None, rows[k][0] or 0, md5(rows[k][1] or "")))
    at, out = Counter(), []
    for k in order:
        i, _, s = rows[k]
        stop = math.floor(target[s] + 0.5)
        out.append((i, size[k], have[s], round(target[s], 6), sum(max(0, min(size[k], stop - at[s] - p * have[s])) for p in range(most))))
        at[s] += size[k]
    return sorted(out, key=str)


def test_mix_takes_what_targets_say(spark):
    rng = np.random.default_rng(11)
    texts = [None, "", " \t\n", "one", "a b\x0bc\x0cd", "  nbsp word", "w " * 40_000]
    rows = [(int(rng.integers(0, 40)) if k % 9 else None, texts[k % 7] if k % 4 == 0 else "x " * int(rng.integers(0, 50)), [None, "b", "a", "é", "", "hot", "hot", "hot"][k % 8]) for k in range(300)]
    rows += [(5, "same text", "hot")] * 150
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, target int, takes string")
    for parts in (1, 9):
        got = sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.plan(docs, parts=parts).collect()), key=str)
        assert got == brute_mix(rows)
    assert not mixing.report(docs.where("false")).collect()
    blank = mixing.report(docs.where("text is null")).collect()
    assert blank and all((r.size, r.source_size, r.target, r.taken, r.first_position) == (0, 0, 0.0, 0, None) for r in blank)


def test_mixed_rows_stand_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("mix_words", mixing.F.lit("old"))
    docs = docs.unionByName(docs.limit(1).crossJoin(spark.range(20)).drop("id"))
    plan = mixing.plan(docs).collect()
    out = mixing.mixed(docs, salt_rows=3).collect()
    assert [r.mix_position for r in out] == sorted(t["position"] for r in plan for t in r.takes)
    got, want = Counter(), Counter()
    for r in out:
        got[r.doc_id] += r.mix_words
        assert 0 < r.mix_words <= len(re.findall(mixing.WORD, r.text))
    for r in plan:
        want[r.doc_id] += r.taken
    assert got == want


@pytest.mark.parametrize("knots", [((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.0), (0.25, 3.0), (0.5, 3.0), (1.0, 0.0)), ((0.0, 1.0), (0.5, 0.0), (0.75, 0.0), (1.0, 2.0))])
def test_due_inverts_the_integral(spark, knots):
    shares = spark.range(0, 1001).select((mixing.F.col("id") / 1000).alias("s"))
    upto = mixing.areas(knots)
    times = [t for t, _ in knots]
    for r in shares.select("s", mixing.due(mixing.F.col("s"), knots).alias("t")).collect():
        i = max(k for k in range(len(knots) - 1) if times[k] <= r.t)
        (t0, w0), (t1, w1) = knots[i], knots[i + 1]
        x = r.t - t0
        assert math.isclose(upto[i] + w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2, r.s * upto[-1], abs_tol=1e-9)


def test_schedules_and_shares_are_checked(spark):
    for bad in (((0.0, 1.0),), ((0.0, 1.0), (0.5, 1.0)), ((0.0, -1.0), (1.0, 2.0)), ((0.0, 0.0), (1.0, 0.0))):
        with pytest.raises(ValueError):
            mixing.areas(bad)
    with pytest.raises(ValueError):
        mixing.targets(spark.createDataFrame([(1, 1.0)], "source_size long, weight double"), share=3.0, most=2)
