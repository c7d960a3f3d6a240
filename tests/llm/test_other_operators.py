"""Vectors, pages, shards and the pipeline against plain brute force."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from stratolab.llm import ann, queries, sharding, url_filter, warc
from stratolab.llm.components import components


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def brute_nearest(rows, k=5, every=50):
    usable = [(i, np.array(v, float)) for i, v in rows]
    ids, x = np.array([i for i, _ in usable]), np.array([v for _, v in usable])
    out = {}
    for q in sorted(i for i in ids.tolist() if i % every == 0):
        one = x[ids == q][0]
        score = ann.cosine(x, one[None, :])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_against_brute_force(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    want = brute_nearest([(r.vec_id, r.embedding) for r in vectors.collect()])
    for size in (4000, 64):
        got = defaultdict(dict)
        for r in ann.nearest(vectors, block_rows=size, query_rows=4, task_blocks=1 + size // 4000).collect():
            got[r.query_id][r.rank] = (r.vec_id, r.score)
        assert set(got) == set(want)
        assert all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
        found = sum(len({x[0] for x in got[q].values()} & {x[0] for x in want[q]}) for q in want)
        assert found >= 0.9 * sum(map(len, want.values()))
        for q, g in got.items():
            exact = dict(brute_nearest([(r.vec_id, r.embedding) for r in vectors.collect()], k=10**6)[q]) if q == 0 else {}
            for vec, score in g.values():
                assert q or math.isclose(score, exact[vec], rel_tol=0, abs_tol=1e-15)


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (4, None), (5, [0.0, 0.0])]
    rows += [(6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 0.0]), (2, [1.0, 1.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(frame).orderBy("rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 1)]
    assert ann.nearest(frame.limit(0)).count() == 0
    assert ann.nearest(frame.where("vec_id = 0")).count() == 0


def test_one_odd_length_drops_no_other(spark):
    rows = [(0, [1.0]), (50, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert [(r.query_id, r.rank, r.vec_id) for r in got.orderBy("rank").collect()] == [(50, 1, 1), (50, 2, 2)]


def oracle(name, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return sorted(con.execute(queries.ORACLES[name]).fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted((tuple(r) for r in got.collect()), key=str) == oracle(name, sf_dir)


URLS = [
    ("http://EXAMPLE.com/en/a", "example.com", "/en/a", "example.com/en/", "block"),
    ("http://www.Example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://a.b.example.com/en/x?q", "a.b.example.com", "/en/x", "example.com/en/", "block"),
    ("http://example.com/EN/a", "example.com", "/EN/a", "com/", "allow"),
    ("http://notexample.com/en/a", "notexample.com", "/en/a", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://x.net/es/", "x.net", "/es/", "net/es/", "block"),
    ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://x.net/fr/1#a", "x.net", "/fr/1", "net/fr/", "block"),
    ("http://x.cheap-pills.org/de/", "x.cheap-pills.org", "/de/", None, "block"),
    ("http://x.cheap-pills.org/en/help/", "x.cheap-pills.org", "/en/help/", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://", "", "", None, "allow"),
    ("a://b://com/", "b:", "//com/", None, "allow"),
    ("http://q.net?x=/es/", "q.net", "", None, "allow"),
]


@pytest.mark.parametrize("most", [500, 2])
def test_url_rules(spark, most):
    frame = spark.createDataFrame(
        [(i, u[0], "t") for i, u in enumerate(URLS)], "page_id long, url string, tokens string"
    )
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(frame, max_rules=most).collect()}
    assert got == {i: u[1:] for i, u in enumerate(URLS)}
    assert url_filter.judge(frame.limit(0)).count() == 0


def test_url_plan_has_no_python(spark, sf_dir):
    plan = url_filter.judge(table(spark, sf_dir, "pages"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    long = url_filter.judge(table(spark, sf_dir, "pages"), max_rules=2)._jdf.queryExecution().toString()
    assert "MapInArrow" not in long and "BatchEvalPython" not in long


def test_long_rule_lists_and_long_urls(spark, tmp_path):
    """A list too long for a plan, read from a file; a very long URL; repeated and null rows; pattern rules decide some."""
    lines = ["# hosts", "block host bad7.example.org/", "allow pattern /en/help/  # help", *[f"block pattern ^rare{i}.host" for i in range(3000)], ""]
    (tmp_path / "rules.txt").write_text("\n".join(lines))
    rules = url_filter.read_rules(spark, f"file://{tmp_path}/rules.txt")
    assert len(rules) == 3002
    urls = [f"http://rare{i}.host/x" for i in (5, 2999, 3000)] + ["http://rare5.host/en/help/a", "http://a.bad7.example.org/q", None, None]
    urls += ["http://rare5.host/x", "http://ok.org/" + "a/" * 100_000 + "rare17.host"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(frame, rules=rules).collect()}
    block, allow = (None, "block"), (None, "allow")
    assert got == dict(enumerate([block, block, allow, allow, ("bad7.example.org/", "block"), allow, allow, block, block]))
    (tmp_path / "bad.txt").write_text("deny host x/")
    with pytest.raises(ValueError, match="no rule"):
        url_filter.read_rules(spark, f"file://{tmp_path}/bad.txt")


def test_rules_on_very_common_tokens(spark, monkeypatch):
    """A long list with rules whose only token nearly every URL holds: tokens are spread, rows are those of the short list."""
    monkeypatch.setattr(url_filter, "HOT", 4)
    rules = url_filter.HOST_RULES + tuple(url_filter.host_rule("block", f"com/p{i}/") for i in range(40))
    urls = [f"http://h{i}.com/p{i % 60}/x" for i in range(400)] + [f"http://h{i}.net/es/" for i in range(40)] + ["http://a.org/", None]
    frame = spark.createDataFrame(list(enumerate(urls + urls)), "page_id long, url string")
    long, short = (sorted(map(tuple, url_filter.judge(frame, rules=rules, max_rules=m).collect())) for m in (1, 500))
    assert long == short and {r[3] for r in long} >= {"com/", "com/p7/", "net/es/", None}


def test_patterns_decide_given_pages(spark):
    got = url_filter.judge(table(spark, "/root/testdata/sf0.01", "pages"))
    assert got.where("rule is null and verdict = 'block'").count() > 2


def test_shards_obey_the_law(spark):
    rows = [(i, f"copy {i // 40}" if i < 400 else f"alone {i}") for i in range(1000)]
    rows += [(1000 + i, "one text that a third of all rows have") for i in range(500)]
    rows += [(7, "copy 0"), (7, "copy 0"), (None, None), (2000, None), (2001, ""), (None, "copy 1")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, size int")
    got = sharding.shard(docs, shards=8).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = Counter((d, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t in rows)
    assert text == Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    # Groups of 40 lie in one shard of 188, and the large one in few.
    crc = {zlib.crc32(t.encode()): t for _, t in rows if t}
    at = defaultdict(set)
    for r in got:
        at[crc.get(r.text_crc32)].add(r.shard)
    assert sum(len(at[f"copy {g}"]) == 1 for g in range(10)) >= 8
    assert len(at["one text that a third of all rows have"]) <= 5


def cut_edges(rows):
    """Pairs of equal texts in different shards, one by one; rows are (text, shard)."""
    groups = defaultdict(list)
    for text, shard in rows:
        groups[text].append(shard)
    return sum(a != b for g in groups.values() for i, a in enumerate(g) for b in g[:i])


def test_propagation_cuts_few_edges(spark):
    rng = np.random.default_rng(8)
    texts = [f"group {g}" for g in range(60) for _ in range(int(rng.integers(2, 16)))] + [f"alone {i}" for i in range(500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [(texts[r.doc_id], r.shard) for r in sharding.shard(docs, shards=8).collect()]
    by_hash = [(t, i % 8) for i, t in enumerate(texts)]
    # No edge need be cut: the groups fit the shards. One in fifty of a blind placement's is allowed.
    assert cut_edges(got) <= cut_edges(by_hash) / 50


def test_shards_of_long_and_very_common_texts(spark):
    rows = [(i, "x" * 3_000_000 if i < 3 else "common" if i % 2 else f"own {i}") for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=4, bucket_rows=50).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(got) == 4000
    assert {r.size for r in got if r.doc_id < 3} == {3_000_016}
    slots = defaultdict(set)
    for r in got:
        slots[r.shard].add(r.slot)
    assert all(s == set(range(counts[k])) for k, s in slots.items())


def test_shards_of_small_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = sharding.shard(docs).collect()
    counts = Counter(r.shard for r in got)
    assert len(counts) == 40 and set(counts.values()) == {len(got) // 40}
    few = sharding.shard(docs.limit(3)).collect()
    assert sorted(r.shard for r in few) == [0, 1, 2] and {r.slot for r in few} == {0}
    assert sharding.shard(docs.limit(0)).count() == 0


def test_ascending_chains_take_few_rounds(spark, monkeypatch):
    from stratolab.llm import components as module

    real, rounds = module.stored, []
    monkeypatch.setattr(module, "stored", lambda df, name: (rounds.append(name), real(df, name))[1])
    got = components(spark.createDataFrame([(i, i + 1) for i in range(1000)], "a long, b long")).collect()
    assert len(got) == 1001 and {r.root for r in got} == {0} and rounds.count("labels") <= 15


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_archive_gives_back_exact_records(spark, tmp_path):
    long = "ü" * 600
    rows = [(1, "http://a/", long), (2, "http://b/\r\nx", long), (3, None, "short"), (4, "u", "short"), (5, "u", None)]
    rows += [(6, "u", ""), (2, "again", long), (None, "n", long), (9, "z", "y" * 999), (8, "z", "y" * 999)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha256 int")
    path = f"file://{tmp_path}/w"
    warc.write_archive(frame, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for salt in (2000, 1):
        got = warc.read_archive(spark, path, salt_rows=salt).collect()
        want = []
        for p, u, h in rows:
            raw = (h or "").encode()
            refers = 2 if h == long and p != 2 else None
            head = warc.record_head(p, u, len(raw), hashlib.sha1(raw).hexdigest(), refers)
            want.append((head, raw))
        assert sorted((bytes(r.head), bytes(r.payload)) for r in got) == sorted(want)
    record = warc.warc_bytes(*next(x for x in want if b"urn:page:1>" in x[0]))
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n") and record.endswith(b"\r\n\r\n\r\n\r\n")
    made = warc.write_warc_files(spark, path, f"file://{tmp_path}/files")
    times = {x.name: x.stat().st_mtime_ns for x in (tmp_path / "files").iterdir()}
    files = made.collect()
    assert made.count() == len(files) and times == {x.name: x.stat().st_mtime_ns for x in (tmp_path / "files").iterdir()}
    with pytest.raises(ValueError, match="not empty"):
        warc.write_warc_files(spark, path, f"file://{tmp_path}/files")
    import gzip

    texts = [gzip.decompress((tmp_path / "files" / f.file).read_bytes()) for f in files]
    assert sum(f.records for f in files) == len(rows) and sorted(f.file for f in files) == sorted(x.name for x in (tmp_path / "files").iterdir())
    records, at = [], 0
    whole = b"".join(texts)
    while at < len(whole):  # by each record's own length, as a reader goes
        stop = whole.index(b"\r\n\r\n", at) + 4
        size = int(warc.parse_head(whole[at:stop])["Content-Length"])
        records.append(whole[at : stop + size])
        assert whole[stop + size : stop + size + 4] == b"\r\n\r\n"
        at = stop + size + 4
    assert sorted(records) == sorted(warc.warc_bytes(*x)[:-4] for x in want)
    facts = sorted((tuple(r) for r in warc.report(frame).collect()), key=str)
    assert (None, 1200, hashlib.sha1(long.encode()).hexdigest(), "revisit", 2) in facts
    assert sum(f[3] == "revisit" for f in facts) == 2
    assert warc.report(frame.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = [docs.count()]
    at = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf_dir)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        at = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(at.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > sizes[4] == sizes[5] > sizes[0] // 3
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, at.collect()))
