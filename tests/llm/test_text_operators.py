"""Text operators against plain brute force over whole small tables and odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
import xxhash

from stratolab.llm import bpe, decontaminate, line_dedup, quality, queries, simhash, token_files

ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda"),
    (5, "Alpha beta GAMMA delta epsilon zeta eta theta iota kappa lambda"),
    (6, "alpha, beta; gamma-delta epsilon zeta eta theta iota kappa!"),
    (7, "Größe ÄÖ naïve 日本語 text \x00 \x1c ² end"),
    (8, "word " * 30_000),
    (9, "a\nb\nc\nd\ne\nf\ng\nh"),
    (10, "x\na\nb\nc\nd\ne\nf\ng\nh"),
    (None, "a row without an id"),
    (11, "<|endoftext|>in<|endoftext|> the <|endoftext"),
]


def odd(spark, rows=ODD):
    """Odd rows with extra columns whose names clash with those the operators make."""
    wide = [(i, t, "k", 1, 2, "z") for i, t in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, key string, pos int, n_hit int, digest string")


def docs_of(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def both(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_hits(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        if item is None or text is None:
            continue
        w = WORD.findall(lowered(text))
        for i in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[i : i + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w = WORD.findall(lowered(text))
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    ids |= got
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4_000_000, 3000])
def test_decontamination_is_brute_force(spark, sf_dir, block):
    docs = both(spark, sf_dir)
    items = [(r.item_id, r.text) for r in docs_of(spark, sf_dir, "benchmark").collect()]
    items += [(900, "Alpha beta gamma delta epsilon zeta eta theta iota kappa"), (901, "one"), (902, None), (903, "..")]
    items += [(None, "alpha"), (900, "word word word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs, bench, max_block_chars=block)
    rows = sorted((tuple(r)[:6] for r in got.collect()), key=str)
    assert rows == brute_hits([tuple(r) for r in docs.collect()], items)
    assert sum(r[5] for r in rows) > 5


def test_spans_point_into_the_original(spark):
    bench = spark.createDataFrame([(1, "GAMMA delta epsilon")], "item_id long, text string")
    got = decontaminate.scan(odd(spark), bench)
    found = {r.doc_id: [r.text[s.start : s.stop] for s in r.spans] for r in got.collect()}
    assert found[5] == ["GAMMA delta epsilon"] and found[6] == ["gamma-delta epsilon"] and found[7] == []
    assert got.columns[:4] == ["doc_id", "text", "key", "pos"]


def test_a_benchmark_beyond_the_stated_size_is_refused(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a b"), ("y", "b c d"), ("z", None)], "item_id string, text string")
    assert decontaminate.scan(docs, items, max_benchmark_chars=8).first().n_hit == 2
    with pytest.raises(ValueError, match="max_benchmark_chars"):
        decontaminate.scan(docs, items, max_benchmark_chars=7)
    assert decontaminate.scan(docs.limit(0), items).count() == 0
    assert decontaminate.scan(docs, items.limit(0)).first().n_hit == 0


def test_decontaminated_keeps_clean_rows_and_columns(spark):
    bench = spark.createDataFrame([(1, "GAMMA delta epsilon")], "item_id long, text string")
    docs = odd(spark)
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(docs, none).count() == len(ODD)
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(queries.vocabulary_path())


def test_bpe_is_the_library(spark, sf_dir):
    t = library()
    docs = both(spark, sf_dir)
    got = {tuple(r) for r in bpe.report(docs, queries.vocabulary_path()).collect()}
    want = set()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back)]
        want.add((r.doc_id, len(ids), *sha))
    assert got == want
    whole = bpe.encoded(odd(spark), queries.vocabulary_path())
    assert all(r.decoded == (r.text or "") for r in whole.collect())
    assert bpe.report(docs.limit(0), queries.vocabulary_path()).count() == 0


def test_stream_needs_no_more_than_the_lookahead():
    t = bpe.Transducer(queries.vocabulary_path())
    import random

    rng = random.Random(5)
    for letters in ("a", "ab", "etaoinshrdlu", "-=", "thequickbrown"):
        raw = "".join(rng.choice(letters) for _ in range(9000)).encode()
        t.buffer = t.lookahead + t.longest + 1
        assert list(t.stream(raw[i : i + 13] for i in range(0, len(raw), 13))) == t.merged(raw)


def test_decoding_any_ids_is_the_library():
    import random

    t, own, rng = library(), bpe.Transducer(queries.vocabulary_path()), random.Random(2)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(256), rng.randrange(50257), 50256]) for _ in range(rng.randrange(12))]
        assert own.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_token_files_round_trip(spark, sf_dir, tmp_path):
    t = library()
    docs = both(spark, sf_dir)
    rows = docs.collect()
    ids = {(r.doc_id, r.text): [*t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in rows}
    got = sorted(token_files.report(docs, queries.vocabulary_path(), parts=5).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    import struct

    crc = lambda x: zlib.crc32(struct.pack(f"<{len(x)}I", *x))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (r.doc_id or -1, len(ids[r.doc_id, r.text]), crc(ids[r.doc_id, r.text])) for r in rows
    )
    named = [r.doc_id for r in got if r.doc_id is not None]
    assert named == sorted(named) and got[0].doc_id is None
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(odd(spark), path, queries.vocabulary_path())
    back = {r.doc_id: r.ids for r in token_files.read_tokens(spark, path).collect()}
    assert back[7] == ids[7, ODD[7][1]] and back[1] == [2]
    assert token_files.report(docs.limit(0), queries.vocabulary_path()).count() == 0


def test_damaged_block_is_found():
    import numpy as np

    from stratolab.llm.token_codec import BLOCK, decode_segment, encode_segment

    rng = np.random.default_rng(1)
    for n in (0, 1, BLOCK, BLOCK + 1, 3 * BLOCK + 7):
        for ids in (rng.integers(0, 1 << 16, n), rng.integers(0, 9, n), np.full(n, 3)):
            assert (decode_segment(encode_segment(ids)) == ids).all()
    data = bytearray(encode_segment(rng.integers(0, 500, 9000)))
    data[-900] ^= 4
    with pytest.raises(ValueError):
        decode_segment(bytes(data))


def test_coded_ids_are_smaller_than_deflate(spark):
    """Bytes an id over the documents of sf0.01, against zlib over 16-bit ids."""
    import numpy as np
    import pyarrow as pa

    from stratolab.llm.token_codec import encode_segment

    texts = [r.text for r in docs_of(spark, "/root/testdata/sf0.01").orderBy("doc_id").collect()]
    ids = np.frombuffer(b"".join(token_files.Words(queries.vocabulary_path()).encode(pa.array(texts))), "<u2")
    coded = len(encode_segment(ids)) / len(ids)
    assert coded < 0.95 and coded < 0.9 * len(zlib.compress(ids.tobytes(), 6)) / len(ids)


def test_words_are_the_library():
    import numpy as np
    import pyarrow as pa

    t = library()
    words = token_files.Words(queries.vocabulary_path(), most=50, longest=8)
    texts = [x for _, x in ODD] + ["  a", "a  b ", " \n x", "a <|endoftext|>", "x  y", "\u3000 z", "q \x1c r", "it's  't "]
    texts += ["lead\n\nline.\nLine, two", "a.b! c?! d.e.", "foo.Ġfoo Ġfoo", "Ġfoo", "x" * 90_000, "wait...\nso", "tail\n", "a.\n b"]
    for _ in range(2):
        got = list(words.encode(pa.array(texts, pa.string())))
        assert got == [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u2").tobytes() for x in texts]
        assert max(map(len, [*words.plain, *words.pieces])) <= 8
    assert list(words.encode(pa.array([], pa.string()))) == []


def brute_fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if x]
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, most=4):
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= most:
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return sorted(((rows[i][0], f"{rows[i][1]:016x}", least[find(i)]) for i in range(len(rows))), key=str)


def test_simhash_is_brute_force(spark, sf_dir):
    docs = both(spark, sf_dir)
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    want = brute_components(rows)
    assert got == want
    assert len({r[2] for r in want}) < len(rows) - 10
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_dense_fingerprints_in_small_blocks(spark):
    """Chains of near fingerprints, long posting lists cut in parts: no link is lost."""
    import random

    from stratolab.llm.components import components

    rng, fps = random.Random(3), {0}
    for _ in range(250):
        fp = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 9)):
            fp ^= 1 << rng.randrange(64)
        fps.add(fp)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    for block, rows in ((4000, 2000), (7, 2000), (4000, 0.5), (7, 0.001)):  # one, one, two and three positions a list
        found = simhash.links(frame, block=block, list_rows=rows)
        roots = {r.node & (1 << 64) - 1: r.root for r in components(found).collect()}
        want = defaultdict(set)
        for d, f, c in brute_components([(x, x) for x in sorted(fps)]):
            want[c].add(int(f, 16))
        for group in want.values():
            assert len({roots.get(x) for x in group}) == 1 or len(group) == 1
            assert len(group) > 1 or not (group & set(roots))
        assert len({roots[x] for x in roots}) == sum(len(g) > 1 for g in want.values())


def test_the_tally_decides_what_is_verified():
    import numpy as np

    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 1 << 63, 600, dtype=np.uint64) & np.uint64(0xFFFFFFFFFFFFFF00) | np.uint64(7))
    fps = np.unique(np.concatenate((fps, fps[:100] ^ np.uint64(1 << 40), fps[100:200] ^ np.uint64((1 << 9) | (1 << 63)))))
    found, verified = {}, {}
    for minimum in (4, 0):
        verified[minimum] = []
        a, b = simhash.links_in_list(fps, 4, minimum, verified[minimum])
        found[minimum] = set(zip(a.tolist(), b.tolist(), strict=True))
    assert len(found[4]) == 200 and {tuple(sorted(x)) for x in found[4]} == {tuple(sorted(x)) for x in found[0]}
    assert sum(verified[4]) < sum(verified[0]) / 100


def brute_spans(text):
    """Chunks of a text by the rules' wording: every polynomial is summed anew."""
    lines = [] if text is None else text.split("\n")
    base, full = 0x9E3779B97F4A7C15, 1 << 64
    hashes, found = [xxhash.xxh3_64_intdigest(x.encode()) for x in lines], set()
    for window, divisor in ((2, 3), (1, 3), (1, 2), (2, 2)):
        start = 0
        for i in range(len(lines)):
            last = hashes[max(0, i - window + 1) : i + 1]
            poly = sum(h * pow(base, len(last) - 1 - k, full) for k, h in enumerate(last)) % full
            mixed = (poly ^ poly >> 31) * 0xBF58476D1CE4E5B9 % full >> 33
            if mixed % divisor == 0 or i == len(lines) - 1:
                if i + 1 - start >= 2:
                    found.add((start, i + 1 - start))
                start = i + 1
    found |= {(i, 2) for i in range(len(lines) - 1)}
    return lines, found | {(i, 1) for i, x in enumerate(lines) if len(x.split()) >= 50}


def brute_lines(rows):
    """Documents one after the other: what an earlier place still holds whole goes, what is whole then is held."""
    held, out = {}, {}
    for d, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, found = brute_spans(text)
        first = {}
        goes = set()
        # Within a document places come in order of their line, and what goes there may take others with it.
        while True:
            now, first = set(), {}
            for at, n in sorted(found):
                chunk = tuple(lines[at : at + n])
                keeper = first.get(chunk)
                if chunk in held or (keeper is not None and at - keeper >= n):
                    now |= set(range(at, at + n))
                elif keeper is None and not goes & set(range(at, at + n)):
                    first[chunk] = at
            if now == goes:
                break
            goes = now
        for chunk in first:
            held.setdefault(chunk, d)
        out[d, text] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in goes)
    return sorted(((d, out[d, text]) for d, text in rows), key=str)


@pytest.mark.parametrize("salt_rows", [2000, 1])
def test_line_dedup_is_brute_force(spark, sf_dir, salt_rows):
    docs = both(spark, sf_dir)
    rows = [tuple(r) for r in docs.collect()]
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup(docs, salt_rows=salt_rows).collect()), key=str)
    want = brute_lines(rows)
    assert got == want
    assert sum(a != b for a, b in zip(sorted(rows, key=str), want, strict=True)) > 3
    wide = line_dedup.dedup(odd(spark))
    assert wide.columns == [*odd(spark).columns, "n_removed_lines"] and wide.count() == len(ODD)
    assert line_dedup.dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("local", [0, 10_000])
def test_what_goes_is_still_whole_somewhere(spark, local):
    """Many small corpora of few different lines, where chunks of all rules overlap."""
    import random

    rng, rows, words = random.Random(6), [], {}
    for corpus in range(60):
        for d in range(9):
            words[100 * corpus + d] = [f"{corpus} {rng.choice('abcdefgh')}" for _ in range(rng.randrange(1, 9))]
    rows = [(d, "\n".join(x)) for d, x in words.items()]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), local_places=local).collect()}
    gone = 0
    for corpus in range(60):
        ids = [100 * corpus + d for d in range(9)]
        left = [f"\n{got[i].text}\n" for i in ids]
        for i in ids:
            lines, found = brute_spans("\n".join(words[i]))
            goes = len(lines) - (len(got[i].text.split("\n")) if got[i].text or not got[i].n_removed_lines else 0)
            assert goes == got[i].n_removed_lines
            whole = {(at, n) for at, n in found if any("\n" + "\n".join(lines[at : at + n]) + "\n" in x for x in left)}
            # Lines that went lie in chunks that are whole somewhere: enough of them to explain the text left.
            cover = set().union(*(range(at, at + n) for at, n in whole))
            assert goes <= len(cover)
            gone += goes
    assert gone > 300
    want = {}
    for corpus in range(60):
        want |= dict(brute_lines([r for r in rows if r[0] // 100 == corpus]))
    assert {d: r.text for d, r in got.items()} == want


@pytest.mark.parametrize(("local", "documents"), [(0, 12), (10_000, 60)])
def test_chains_of_documents_are_settled_to_their_end(spark, local, documents):
    """Each document shares two of its three lines with the next: every second one is cut, however long the chain."""
    rows = [(i, "\n".join(f"line number {k} of the chain" for k in range(i, i + 3))) for i in range(documents)]
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"), local_places=local).collect()
    assert sorted(r.doc_id for r in got if r.n_removed_lines) == list(range(1, documents, 2))


def test_rows_without_ids_are_told_apart(spark):
    passage = "\n".join(f"line {i} of a passage that two rows share" for i in range(6))
    rows = [(None, f"own a\n{passage}"), (None, f"own b\n{passage}"), (None, f"own b\n{passage}"), (3, passage), (3, "other")]
    got = [(r.doc_id, r.text) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str).count((3, "")) == 1 and (3, "other") in got
    # One of the two texts without an id keeps the passage; repeated rows are alike.
    kept = [t for d, t in got if d is None]
    assert len(kept) == 3 and len(set(kept)) == 2 and sum(passage in t for t in set(kept)) == 1


def test_chunks_resist_shifts():
    def cut(lines):
        got, found = line_dedup.spans("\n".join(lines), rules=((2, 3),), min_lines=1)
        assert [x for at, n in found for x in got[at : at + n]] == got
        return [tuple(got[at : at + n]) for at, n in found]

    body = [f"line {i} of the passage" for i in range(40)]
    inside = cut(body)[1:-1]
    moved = set(cut(["before", "more", *body, "after"]))
    assert len(inside) > 5 and set(inside[1:]) <= moved


def test_passages_leave_one_copy(spark):
    passage = [f"sentence {i} that several documents share, word by word" for i in range(12)]
    rows = [(d, "\n".join([f"own {d} a", f"own {d} b", *passage, f"own {d} c"])) for d in range(30)]
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(passage) <= set(got[0])
    for d in range(1, 30):
        assert len(set(passage) & set(got[d])) <= 3
        assert {f"own {d} a", f"own {d} b"} & set(got[d])


def test_quality_on_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = docs_of(spark, big), docs_of(spark, big, "labels")
    got = quality.report(docs, labels)
    assert got.count() == docs.count()
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    base = sum(r.quality for r in rows) / len(rows)
    assert right > max(0.9, base)
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_quality_odd_rows(spark):
    docs = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.report(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (7, 1)], "doc_id long, quality int")
    assert quality.report(docs, some).count() == len(ODD)
    kept = quality.accepted(docs, some, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == len(ODD)
    assert quality.report(docs.limit(0), some).count() == 0


def test_flattened_trees_are_walked_node_by_node():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 5))
    forest = quality.learn(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float), trees=12, depth=3)
    for row, score in zip(x[:200], forest.score(x[:200]), strict=True):
        margin = forest.base
        for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += leaf[node - len(feature)]
        assert abs(score - 1 / (1 + np.exp(-margin))) < 1e-12


def test_learning_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(7, f"text {i} of one id") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    assert quality.report(docs, labels, max_rows=50).count() == 400


def test_memory_stays_flat_on_one_long_text():
    """Ids and text of 20 million characters without a space pass through in parts."""
    import tracemalloc

    t = bpe.Transducer(queries.vocabulary_path(), cache_pieces=1000)
    peaks = []
    for n in (1_000_000, 4_000_000):
        text = "ab1-" * (n // 4)
        tracemalloc.start()
        total = sum(len(p) for p in t.decode_parts(t.encode_parts(text)))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert total == n
    assert peaks[1] < 1.5 * peaks[0] + 1_000_000


def test_automaton_of_a_full_block_fits_a_worker():
    """At the default bound on a block's text, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, random
from stratolab.llm import decontaminate
rng, items, size = random.Random(1), [], 0
while size < 1_500_000:
    text = ' '.join(rng.choice('abcdefgh') * 2 + str(rng.randrange(10**4)) for _ in range(300))
    items.append((str(len(items)), text)); size += len(text)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert decontaminate.automaton(items, 10).built
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, env=os.environ | {"PYTHONPATH": root}, check=True)
    assert int(out.stdout) < 400, out.stdout


def test_flattened_trees_learn_a_rule():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.learn(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
