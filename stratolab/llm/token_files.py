"""Token-ID output: whole texts to ids, coded segments in a file table, and back.

Documents are range-partitioned by id and sorted, each task encodes its range,
and ids go through the context-mixing range coder in segments of about
SEGMENT ids. A segment holds whole documents, its directory, and blocks that are
reset and checksummed one by one; it is a row of a Parquet table, so any store that
Spark writes to will do, and a lost task rewrites its own rows only.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import scratch
from .token_codec import decode_segment, encode_segment

SEGMENT = 4_000_000  # a block of the coder, with room for the end of a document
# A space between characters that are none is where pieces part, whatever stands around it.
_PARTS = re.compile(r"(?<=\S) (?=\S)")
# The common forms of a word, of a group to a piece: letters, a mark, a line break, letters, a mark.
_LETTERS, _MARK = "[A-Za-zÀ-ÖØ-öø-ſ]", "[.,:;?!|]?"
_WORD = f"^(?P<a>{_LETTERS}+)(?P<b>{_MARK})(?P<c>\\n?)(?P<d>{_LETTERS}*)(?P<e>{_MARK})$"
_BLANK_END = r"^$|^[\s\pZ\x{85}\x{1c}-\x{1f}]|[\s\pZ\x{85}\x{1c}-\x{1f}]$"
_SLICE = 32 << 20


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, .. of each run of so many, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class Words:
    """The library's ids of texts, as packed 16-bit numbers; pieces are remembered up to a fixed number.

    Where a space parts two characters that are no space, a piece of a byte-level
    vocabulary begins with that space. So the texts of a slice are cut into words there, the
    distinct words into pieces, and only pieces not seen before are given to
    the library's model. Pieces longer than `longest` characters are never remembered.
    Texts with other white space are cut with more care, and one with a special
    token's string goes to the library whole.
    """

    def __init__(self, path: str, most: int = 800_000, longest: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.normalizer is not None or self.library.pre_tokenizer is None:
            raise ValueError("the vocabulary is not of the byte-level kind")
        self.model, self.part = self.library.model, self.library.pre_tokenizer.pre_tokenize_str
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.shown = {b: c for c, b in byte_letters().items()}
        self.most, self.longest = most, longest
        self.plain: dict[str, bytes] = {}  # by piece
        self.pieces: dict[str, bytes] = {}  # by piece as the model spells it

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; null is as empty."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _SLICE, side="right")))
            yield from self._slice(texts.slice(at, stop - at))
            at = stop

    def _slice(self, texts: pa.Array) -> Iterator[bytes]:
        lists = pc.split_pattern(texts, " ")
        ends = lists.offsets.to_numpy()
        words = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
        codes, ends = words.indices.to_numpy(), ends - ends[0]
        distinct = words.dictionary
        # A word that is empty, or has white space at an end, is no place to cut: its text is cut with care.
        careful = pc.match_substring_regex(distinct, _BLANK_END).to_numpy(zero_copy_only=False)
        apart = np.logical_or.reduceat(careful[codes], ends[:-1])
        for s in self.special:
            apart |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        flat, size = self._distinct(distinct)
        start = np.cumsum(size) - size
        first = distinct.take(words.indices.take(pa.array(ends[:-1]))).to_pylist()
        for at in range(0, len(texts), 256):
            some = ends[at : at + 257]
            here = codes[some[0] : some[-1]]
            n = size[here]
            n[some[:-1] - some[0]] = 0  # the first word of a text has no space before it
            stops = 2 * np.cumsum(n)[some[1:] - some[0] - 1]
            out, before = flat[_places(start[here], n)].tobytes(), 0
            for k, stop in enumerate(stops.tolist(), at):
                yield self._careful(texts[k].as_py()) if apart[k] else self._spelled(first[k]) + out[before:stop]
                before = stop

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words, each with a space before it, side by side, and how many each has."""
        for table in (self.pieces, self.plain):
            if len(table) > self.most:
                table.clear()
        found = pc.extract_regex(words, _WORD)
        # Two marks side by side are one piece.
        marks = [pc.equal(found.field(i), "") for i in range(1, 5)]
        fits = pc.and_(found.is_valid(), pc.or_(pc.or_(marks[0], marks[3]), pc.invert(pc.and_(marks[1], marks[2]))))
        fits = fits.to_numpy(zero_copy_only=False)
        other = np.flatnonzero(~fits)
        parts = []
        for i in range(5):
            group = found.field(i).dictionary_encode()
            of = [self._letters(" " + x if i == 0 else x) for x in group.dictionary.to_pylist()]
            at = np.where(fits, group.indices.fill_null(0).to_numpy(), len(of))
            of.append(b"")
            if i == 0:
                at[other] = np.arange(len(of), len(of) + len(other))
                of += [self._spelled(" " + words[k].as_py()) for k in other.tolist()]
            size = np.fromiter(map(len, of), np.int64, len(of)) // 2
            parts.append((np.frombuffer(b"".join(of), "<u2"), (np.cumsum(size) - size)[at], size[at]))
        total = sum(n for _, _, n in parts)
        flat, put = np.empty(int(total.sum()), "<u2"), np.cumsum(total) - total
        for ids, start, n in parts:
            flat[_places(put, n)] = ids[_places(start, n)]
            put = put + n
        return flat, total

    def _careful(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        words = _PARTS.split(text)
        return b"".join(self._spelled(" " + w if i else w) for i, w in enumerate(words))

    def _spelled(self, text: str) -> bytes:
        """The ids of a text of any pieces."""
        return b"".join([self.pieces.get(p) or self._piece(self.pieces, p, p) for p, _ in self.part(text)])

    def _letters(self, piece: str) -> bytes:
        """The ids of one piece in plain spelling."""
        if not piece:
            return b""
        return self.plain.get(piece) or self._piece(self.plain, piece, piece.encode().decode("latin-1").translate(self.shown))

    def _piece(self, table: dict[str, bytes], key: str, spelled: str) -> bytes:
        ids = array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()
        if len(key) <= self.longest:
            table[key] = ids
        return ids


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def _pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """Document directory (ids, which are null, lengths), then the coded segment."""
    directory = zlib.compress(
        np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + np.array([d is None for d in doc_ids], "u1").tobytes()
        + np.array(lengths, "<i8").tobytes()
    )
    return struct.pack("<II", len(doc_ids), len(directory)) + directory + encode_segment(ids)


def _unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    n, size = struct.unpack_from("<II", data)
    raw = zlib.decompress(data[8 : 8 + size])
    ids = np.frombuffer(raw, "<i8", n).tolist()
    null = np.frombuffer(raw, "u1", n, 8 * n)
    lengths = np.frombuffer(raw, "<i8", n, 9 * n)
    return [None if x else d for d, x in zip(ids, null, strict=True)], lengths, decode_segment(data[8 + size :])


def _writer(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        words, end = _words(vocabulary), np.array([end_id], "<u2").tobytes()
        held: list[bytes] = []
        docs: list[int | None] = []

        def segment() -> pa.RecordBatch:
            nonlocal seq
            ids = np.frombuffer(b"".join(held), "<u2")
            data = _pack(docs, [len(h) // 2 for h in held], ids)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([seq]), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())],
                schema=_SEGMENTS,
            )
            seq += 1
            held.clear()
            docs.clear()
            return row

        size = 0
        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), words.encode(batch.column(1)), strict=True):
                held.append(ids + end)
                docs.append(d)
                size += len(ids) // 2 + 1
                if size >= SEGMENT:
                    yield segment()
                    size = 0
        if held:
            yield segment()

    return run


_SEGMENTS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("data", pa.binary())])


def write_tokens(
    docs: DataFrame, path: str, vocabulary: str, *, end_id: int = 2, parts: int | None = None
) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order into a segment table at path.

    Null ids come first; rows that share an id stand in order of their text's
    hash, and may fill several ranges. A null text is as empty and leaves the end
    id alone. parts: how many ranges; by default as many as a shuffle has.
    """
    slim = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    dealt = slim.repartitionByRange(parts, "doc_id", "h") if parts else slim.repartitionByRange("doc_id", "h")
    ordered = dealt.sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(_writer(vocabulary, end_id), "part int, seq int, n_ids long, data binary").write.option(
        "compression", "uncompressed"
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document, in the order of (part, seq, place): doc_id, array<int> ids. Damage fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, doc_ids, lengths, ids in _opened(batches):
            ends = np.cumsum(lengths)
            for at in range(0, len(doc_ids), 1000):
                some = slice(at, at + 1000)
                rows = [ids[e - n : e] for e, n in zip(ends[some], lengths[some], strict=True)]
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()),
                        pa.array(range(at, at + n), pa.int32()), pa.array(doc_ids[some], pa.int64()),
                        pa.array(rows, pa.list_(pa.int32())),
                    ],
                    names=["part", "seq", "place", "doc_id", "ids"],
                )

    return _segments(spark, path).mapInArrow(run, "part int, seq int, place int, doc_id long, ids array<int>")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, seq int, n_ids long, data binary").parquet(path).select("part", "seq", "data")


def _opened(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            part, seq, data = (batch.column(c)[i].as_py() for c in range(3))
            yield part, seq, *_unpack(data)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a segment table: doc_id, start (ids of all before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, seq, doc_ids, lengths, ids in _opened(batches):
            ends, n = np.cumsum(lengths), len(doc_ids)
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - x) : 4 * e]) for e, x in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(doc_ids, pa.int64()),
                    pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()),
                ],
                names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )

    schema = "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    rows = _segments(spark, path).mapInArrow(run, schema)
    sizes = spark.read.schema("part int, seq int, n_ids long").parquet(path)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_part = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    of_segment = sizes.withColumn("skip", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(of_part, "part")
    starts = of_segment.select("part", "seq", (F.col("base") + F.col("skip")).alias("before"))
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def report(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write docs as a segment table in the shared folder, read it back, and digest each document."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, vocabulary, **options)
    return digests(spark, path)
