"""Byte-level BPE as a streaming transducer with bounded lookahead.

Merges happen in order of rank, so whether a boundary survives depends on what
follows only through chains of rules of falling rank, each starting with a symbol
that ends where the one before it ended. The longest such chain, in bytes, is the
merge list's sufficient lookahead: a token that ends so far before the last byte
read is stable. A long run of bytes is encoded through a buffer of fixed size;
stable tokens leave it, and encoding starts anew at their end. Short pieces, which
fit the buffer whole, are remembered in a table of fixed size. Decoding is a
byte-to-text state machine that holds back an unfinished character. Ids go from
the encoder to a digest and to the decoder as they become stable.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the vocabulary's splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# On texts of these characters the two engines agree, and the standard library's is faster.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ſ–—‘’“”…¿¡«»]*")
_QUICK = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_PIECE_CHARS = 1 << 16
_ID, _NONE = (1 << 24) - 1, 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Encoder and decoder of one vocabulary file of the byte-level kind."""

    def __init__(self, path: str, cache_pieces: int = 600_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        ids: dict[str, int] = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letter[c] for c in token) for token, i in ids.items()}
        self.single = [ids[c] for c, _ in sorted(letter.items(), key=lambda x: x[1])]
        self.rank: dict[tuple[int, int], int] = {}  # the rule's rank above the id it makes
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault((ids[left], ids[right]), n << 24 | ids[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.is_special = set(self.special.values())
        self.lookahead = self._sufficient_lookahead()
        self.longest = max(map(len, self.bytes_of.values()))
        self.buffer = 4 * (self.lookahead + self.longest)
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_pieces = cache_pieces
        self._split = regex.compile(PATTERN)
        self._specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _sufficient_lookahead(self) -> int:
        """The longest chain of rules of falling rank, in bytes, one pass in order of rank.

        Rule (u, v) merges at a place only if v's end stayed a boundary, which an
        earlier rule may have removed whose left symbol ends there: v or one of
        the symbols down v's right side.
        """
        right: dict[int, int] = {}
        longest_from: dict[int, int] = {}  # over rules seen, by left symbol
        best = 0
        for (u, v), rule in sorted(self.rank.items(), key=lambda x: x[1]):
            after, at = 0, v
            while True:
                after = max(after, longest_from.get(at, 0))
                if at not in right:
                    break
                at = right[at]
            chain = len(self.bytes_of[v]) + after
            longest_from[u] = max(longest_from.get(u, 0), chain)
            best = max(best, chain)
            right.setdefault(rule & _ID, v)
        return best

    def merged(self, raw: bytes) -> list[int]:
        """BPE of bytes that stand alone: lowest rank first, leftmost of equals."""
        ids = [self.single[b] for b in raw]
        rank = self.rank
        if len(ids) <= 64:
            # A rule as one number, rank first, so that the least is the next to run.
            rules = [rank.get(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
            while rules and (rule := min(rules)) < _NONE:
                i = rules.index(rule)
                ids[i] = rule & _ID
                del ids[i + 1], rules[i]
                if i:
                    rules[i - 1] = rank.get((ids[i - 1], ids[i]), _NONE)
                if i < len(rules):
                    rules[i] = rank.get((ids[i], ids[i + 1]), _NONE)
            return ids
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            rule, i, pair = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j], after[i] = rule & _ID, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (got := rank.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (got, a, (ids[a], ids[b])))
        return [t for t, live in zip(ids, alive, strict=True) if live]

    def stream(self, parts: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece whose bytes arrive in parts; memory stays within the buffer."""
        held = b""
        for part in parts:
            for at in range(0, len(part), self.buffer):
                held += part[at : at + self.buffer]
                if len(held) < self.buffer:
                    continue
                end, stable = 0, len(held) - self.lookahead
                for token in self.merged(held):
                    if end + len(self.bytes_of[token]) > stable:
                        break
                    end += len(self.bytes_of[token])
                    yield token
                held = held[end:]
        yield from self.merged(held)

    def _fresh(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece that fits the buffer; short ones are remembered."""
        raw = piece.encode()
        ids = tuple(self.merged(raw))
        if len(raw) <= 64:
            if len(self.cache) >= self.cache_pieces:
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def pieces(self, text: str, start: int, stop: int) -> Iterator[list[str]]:
        """The pieces of text[start:stop], some at a time: parts end where a space follows a letter and leads one."""
        at = start
        while at < stop:
            cut = _CUT.search(text, min(stop, at + _PIECE_CHARS), stop)
            end = cut.start() if cut else stop
            pattern = _QUICK if _PLAIN.fullmatch(text, at, end) else self._split
            if end - at <= 2 * _PIECE_CHARS:
                yield pattern.findall(text, at, end)
            else:
                found = pattern.finditer(text, at, end)
                while some := [m[0] for m in islice(found, 4096)]:
                    yield some
            at = end

    def encode_parts(self, text: str | None) -> Iterator[list[int]]:
        """Ids as they become stable, some at a time; the file's tokenizer without added ends.

        Special strings in the text are their ids. What is held at a time does not grow with the text.
        """
        cache, fresh, short = self.cache, self._fresh, self.buffer // 4
        for number, start, stop in self._parts(text or ""):
            if number is not None:
                yield [number]
                continue
            for pieces in self.pieces(text, start, stop):
                ids: list[int] = []
                for p in pieces:
                    if got := cache.get(p):
                        ids += got
                    elif len(p) < short:
                        ids += fresh(p)
                    else:
                        yield ids
                        ids = []
                        stable = self.stream(p[i : i + 4096].encode() for i in range(0, len(p), 4096))
                        while some := list(islice(stable, 4096)):
                            yield some
                yield ids

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text."""
        return list(chain.from_iterable(self.encode_parts(text)))

    def _parts(self, text: str) -> Iterator[tuple[int | None, int, int]]:
        """Special tokens, by id, and what stands between them, by place."""
        at = 0
        for m in self._specials.finditer(text) if self._specials else ():
            if m.start() > at:
                yield None, at, m.start()
            yield self.special[m[0]], m.start(), m.end()
            at = m.end()
        if at < len(text):
            yield None, at, len(text)

    def decode_parts(self, parts: Iterable[list[int]]) -> Iterator[str]:
        """Text of ids that arrive some at a time; bytes that form no character become U+FFFD, unknown ids nothing.

        A special token's string stands by itself: bytes do not join across it.
        """
        machine, of = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes_of
        for ids in parts:
            yield machine.decode(b"".join([of.get(i, b"") for i in ids]))
        yield machine.decode(b"", final=True)

    def decode_stream(self, ids: Iterable[int], chunk: int = 4096) -> Iterator[str]:
        ids = iter(ids)
        return self.decode_parts(iter(lambda: list(islice(ids, chunk)), []))

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One for each vocabulary and Python worker; the file is at the same path on every machine."""
    return Transducer(path)


def encoded(docs: DataFrame, vocabulary: str, *, text_col: str = "text") -> DataFrame:
    """docs with array<int> ids and string decoded of each whole text; columns of those names are replaced.

    Null is as empty: no ids, empty decoded text. Every row of docs gives a row.
    """
    docs = docs.drop("ids", "decoded")
    at, names = docs.columns.index(text_col), [*docs.columns, "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in _small(batches):
            ids = [t.encode(x) for x in batch.column(at).to_pylist()]
            made = [pa.array(ids, pa.list_(pa.int32())), pa.array([t.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", ids array<int>, decoded string"
    return docs.mapInArrow(run, schema)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(vocabulary)
        for batch in _small(batches):
            n, of_ids, of_text = [], [], []
            for k in range(batch.num_rows):
                found, ids_of, text_of = 0, hashlib.sha256(), hashlib.sha256()

                def counted(text: str | None) -> Iterator[list[int]]:
                    nonlocal found
                    for ids in t.encode_parts(text):
                        if ids:
                            ids_of.update(("," * (found > 0) + ",".join(map(str, ids))).encode())  # noqa: B023
                            found += len(ids)
                            yield ids

                for part in t.decode_parts(counted(batch.column(1)[k].as_py())):
                    text_of.update(part.encode())
                n.append(found)
                of_ids.append(ids_of.hexdigest())
                of_text.append(text_of.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
