"""Properties on arbitrary inputs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratolab.llm import bpe, decontaminate, line_dedup, queries, simhash, token_codec, token_files, warc


@lru_cache
def both():
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    return bpe.Transducer(path), tokenizers.Tokenizer.from_file(path)


@lru_cache
def words():
    return token_files.Words(queries.vocabulary_path())


TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=200)
WORDY = st.lists(st.sampled_from(["the", " ", "  ", "\n", "re", "'s", "é", "ß", "12", "²", "日", "!?", "<|endoftext|>", "_"]), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.one_of(TEXT, WORDY))
def test_encoding_is_the_library(text):
    own, library = both()
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(TEXT, WORDY), max_size=4))
def test_words_are_the_library(texts):
    import pyarrow as pa

    _, library = both()
    got = [np.frombuffer(x, "<u2").tolist() for x in words().encode(pa.array(texts, pa.string()))]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 50))
def test_stream_is_the_whole(raw, step):
    own, _ = both()
    assert list(own.stream(raw[i : i + step] for i in range(0, len(raw), step))) == own.merged(raw)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=600))
def test_coded_ids_come_back(ids):
    assert token_codec.decode_segment(token_codec.encode_segment(np.array(ids, np.int64))).tolist() == ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", ""]), max_size=40).map("\n".join))
def test_chunks_lie_inside_the_text(text):
    lines, found = line_dedup.spans(text)
    assert "\n".join(lines) == text
    assert all(n >= 2 and 0 <= at and at + n <= len(lines) for at, n in found)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.lists(st.integers(0, 63), max_size=4, unique=True))
def test_near_fingerprints_meet_in_a_list(text, bits):
    one = simhash.fingerprint(text)
    other = one
    for b in bits:
        other ^= 1 << b
    equal = {p for p in range(8) if not (one ^ other) >> (8 * p) & 0xFF}
    assert len(equal) == simhash.tally(np.uint64(one), np.array([other], np.uint64))[0] >= 4
    assert all(any(set(t) <= equal for t in simhash.postings(4, depth)) for depth in (1, 2, 3))
    a, _ = simhash.links_in_list(np.unique(np.array([one, other], np.uint64)), 4, 4)
    assert len(a) == (1 if bits else 0)


@settings(max_examples=200, deadline=None)
@given(TEXT, TEXT)
def test_words_do_not_join_across_texts(a, b):
    assert decontaminate.words(f"{a} {b}") == decontaminate.words(a) + decontaminate.words(b)


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.none(), st.integers(-(10**6), 10**6)), st.one_of(st.none(), TEXT), st.binary(max_size=50), st.one_of(st.none(), st.integers(0, 99)))
def test_record_heads_parse_back(page, url, payload, refers):
    head = warc.record_head(page, url, len(payload), "0" * 40, refers)
    fields = warc.parse_head(head)
    assert warc._page(fields["WARC-Record-ID"]) == page and warc._page(fields.get("WARC-Refers-To")) == refers
    block = len(warc.http_head(len(payload))) + (len(payload) if refers is None else 0)
    assert int(fields["Content-Length"]) == block
