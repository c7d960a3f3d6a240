"""Benchmark decontamination: one Aho-Corasick automaton over normalised items.

Words are runs of characters other than ASCII control, punctuation and
space, with A-Z lower-cased. Separators are single ASCII bytes, so one byte
translation normalises a text; words keep their order, which maps hits back to
offsets of the original text. Each text is scanned once per automaton. The
items are sent to every task, so their size is checked: a benchmark above the bound is
cut into blocks of items that are scanned one after the other in the same
narrow pass over the documents. A Python worker builds a block's automaton once. No shuffle takes place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SEPARATOR = bytes(
    32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256)
)
_NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else _SEPARATOR[c] for c in range(256))
_FIRST = 0xE000  # the first word's character, behind those that no text may hold
_SCANNED = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class Scanner(NamedTuple):
    """The automaton over words as numbers, each a character, and the numbers of the items' words."""

    built: ahocorasick.Automaton
    number: dict[bytes, str]


def automaton(items: list[tuple[str, str]], window: int) -> Scanner | None:
    """One automaton over all windows; a value is (words in the window, items that hold it).

    Words are numbered, so a window takes as many states as it has words at most, and windows
    that begin alike share them. A word that no item has is no step of the automaton.
    """
    number: dict[bytes, str] = {}
    holders: dict[str, set[str]] = {}
    for item_id, text in items:
        found = "".join([number.setdefault(w, chr(_FIRST + len(number))) for w in words(text)])
        for i in range(max(1, len(found) - window + 1)) if found else ():
            holders.setdefault(found[i : i + window], set()).add(item_id)
    if not holders:
        return None
    built = ahocorasick.Automaton()
    for w, ids in holders.items():
        built.add_word(w, (len(w), sorted(ids)))
    built.make_automaton()
    return Scanner(built, number)


_BUILT: dict[tuple[str, int], Scanner | None] = {}


def _cached(items: list[tuple[str, str]], digest: str, window: int) -> Scanner | None:
    """One automaton for each benchmark block and Python worker, of the few last used."""
    if (digest, window) not in _BUILT:
        if len(_BUILT) >= 2:
            _BUILT.clear()
        _BUILT[digest, window] = automaton(items, window)
    return _BUILT[digest, window]


def _hits(scanner: Scanner | None, found: list[bytes]) -> tuple[np.ndarray, set[str]] | None:
    """Which words are hit, and by which items; None without any hit."""
    if scanner is None or not found:
        return None
    line = "".join(map(scanner.number.get, found, repeat("\0")))
    edge = items = None
    for last, (n, ids) in scanner.built.iter(line):
        if edge is None:
            edge, items = np.zeros(len(found) + 1, dtype=np.int64), set()
        edge[last + 1 - n] += 1
        edge[last + 1] -= 1
        items.update(ids)
    return None if edge is None else (np.cumsum(edge)[:-1] > 0, items)


def _char_spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Character offsets in the original text of each run of hit words."""
    raw = text.encode()
    mask = np.frombuffer(raw.translate(_NORMAL), dtype=np.uint8) != 32
    step = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)))
    return [
        {"start": int(chars[starts[a]]), "stop": int(chars[stops[b - 1]])}
        for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1), strict=True)
    ]


def _scanner(items: list[tuple[str, str]], window: int, at: int, previous: int | None):
    """A pass over Arrow batches; the found columns stand last and are added to, if there already."""

    digest = hashlib.sha256(repr(sorted(items)).encode()).hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _cached(items, digest, window)
        for batch in batches:
            kept = batch.columns if previous is None else batch.columns[:previous]
            before = None if previous is None else [c.to_pylist() for c in batch.columns[previous:]]
            out: tuple[list, list, list, list] = ([], [], [], [])
            for i, text in enumerate(batch.column(at).to_pylist()):
                found = words(text)
                got = _hits(built, found)
                hit, ids = got if got else (None, set())
                spans = _char_spans(text, hit) if hit is not None else []
                n_hit = int(hit.sum()) if hit is not None else 0
                if before is not None and before[1][i]:
                    ids |= set(before[2][i])
                    if hit is None:
                        n_hit, spans = before[1][i], before[3][i]
                    else:
                        spans, n_hit = _joined(text, before[3][i] + spans)
                for column, value in zip(out, (len(found), n_hit, sorted(ids), spans), strict=True):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            made = [
                pa.array(out[0], pa.int64()),
                pa.array(out[1], pa.int64()),
                pa.array(out[2], pa.list_(pa.string())),
                pa.array(out[3], span),
            ]
            names = [*batch.schema.names[: len(kept)], "n_words", "n_hit", "items", "spans"]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    return scan


def _joined(text: str, spans: list[dict[str, int]]) -> tuple[list[dict[str, int]], int]:
    """The union of spans of whole words, and how many words lie inside."""
    hit = np.zeros(len(text) + 1, dtype=bool)
    for s in spans:
        hit[s["start"] : s["stop"]] = True
    step = np.diff(np.concatenate(([0], hit.view(np.int8))))
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    merged = [{"start": int(a), "stop": int(b)} for a, b in zip(starts, stops, strict=True)]
    return merged, sum(len(words(text[m["start"] : m["stop"]])) for m in merged)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    max_block_chars: int = 1_500_000,
    max_benchmark_chars: int = 150_000_000,
) -> DataFrame:
    """docs with n_words, n_hit, items and spans (character offsets) of benchmark windows.

    Each row of docs gives one row, repeated rows and null ids included. A null
    or empty text has no words and no hit. Benchmark rows with a null id or text
    take no part; rows that repeat an id add to that item's windows. Columns of
    docs named as one of the four results are replaced. max_block_chars bounds
    the item text in one automaton, whose states take some hundred bytes a character at
    most; larger benchmarks take more automata. Items reach the tasks through the driver, so a benchmark of
    more than max_benchmark_chars is refused with a ValueError before any of it is collected: scan such
    a benchmark in parts. An empty docs gives no row, an empty benchmark no hit.
    """
    items = benchmark.select(
        F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text")
    ).where("id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    if total > max_benchmark_chars:
        raise ValueError(f"a benchmark of {total} characters; max_benchmark_chars is {max_benchmark_chars}")
    blocks = max(1, -(-total // max_block_chars))
    docs = docs.drop("n_words", "n_hit", "items", "spans")
    names, previous = docs.columns, None
    out = docs
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        rows = [(r.id, r.text) for r in block.collect()]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + _SCANNED
        out = out.mapInArrow(_scanner(rows, window, names.index(text_col), previous), schema)
        previous = len(names)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, min_hit: int = 1, **options) -> DataFrame:
    """The rows of docs with fewer than min_hit hit words, columns unchanged.

    Options are those of scan(). Rows whose text is null or empty stay.
    """
    made = {"n_words", "n_hit", "items", "spans"}
    aside = {c: f"__{c}" for c in docs.columns if c in made}
    kept = scan(docs.withColumnsRenamed(aside), benchmark, **options).where(F.col("n_hit") < min_hit)
    return kept.drop(*made).withColumnsRenamed({v: k for k, v in aside.items()})


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans."""
    found = scan(docs.select("doc_id", "text"), benchmark, **options)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "spans",
    )
