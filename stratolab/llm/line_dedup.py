"""Line dedup by content-defined chunks of lines.

Rolling hashes over the hashes of the last lines decide where a chunk ends, so
boundaries follow content: lines put in before a repeated passage move no
boundary inside it. Several such rules cut each text in several ways, so that a
short passage, in which one rule may find no two boundaries, is met by another.
What boundaries miss is met without them: every two consecutive lines are a chunk,
and so is a single line of LONG_LINE words or more.

Documents stand in order of their ids. A chunk goes where an earlier place still holds
it whole: its keeper, the first place of which no line has gone. Chunks of different rules
overlap, so keepers hang on each other; they are found by bounds from both
sides that close in round by round, until no chunk is open. Every chunk that goes has its bytes compared with
its keeper's, and the keeper stays whole.

Plan: one pass writes (document, lines, digest) of all chunks; a partial
aggregation finds repeated digests, and rounds work on the places of those; only
the texts of what goes, each line once, and of its keepers are shuffled for the comparison, with hot digests
salted; the decisions go back to the documents by one join on their key. Before each of these joins a bitmap of
the keys' hashes leaves out rows that meet nothing, so documents of which nothing goes are not shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parted, spread_join, stored

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
# Lines under the rolling hash, and the mean number of lines between boundaries, of each rule.
# With 0 for the second every run of so many lines is a chunk; of single lines only long ones.
RULES = ((2, 3), (1, 3), (1, 2), (2, 2), (2, 0), (1, 0))
# Words from which a line is a chunk by itself.
LONG_LINE = 50


def boundaries(hashes: list[int], window: int, divisor: int) -> list[int]:
    """Line counts behind which a chunk ends; the last is the number of lines.

    A chunk ends behind a line where the polynomial hash of the last `window`
    line hashes, mixed, is 0 modulo `divisor`.
    """
    ends, rolling = [], 0
    drop = pow(_BASE, window, 1 << 64)
    for i, h in enumerate(hashes):
        rolling = (rolling * _BASE + h) & _M
        if i >= window:
            rolling = (rolling - hashes[i - window] * drop) & _M
        mixed = (rolling ^ (rolling >> 31)) * 0xBF58476D1CE4E5B9 & _M
        if (mixed >> 33) % divisor == 0:
            ends.append(i + 1)
    if not ends or ends[-1] != len(hashes):
        ends.append(len(hashes))
    return ends


def spans(text: str | None, rules=RULES, min_lines: int = 2) -> tuple[list[str], list[tuple[int, int]]]:
    """The text's lines, and (first line, number of lines) of its chunks under any rule.

    Chunks between boundaries have min_lines or more, others the lines their rule says.
    """
    if text is None:
        return [], []
    lines = text.split("\n")
    hashes = [xxhash.xxh3_64_intdigest(x.encode()) for x in lines]
    found = set()
    for window, divisor in rules:
        if not divisor:
            runs = [(at, window) for at in range(len(lines) - window + 1)]
            found.update(r for r in runs if window > 1 or len(lines[r[0]].split()) >= LONG_LINE)
            continue
        start = 0
        for stop in boundaries(hashes, window, divisor):
            if stop - start >= min_lines:
                found.add((start, stop - start))
            start = stop
    return lines, sorted(found)


# Id, 0 where null; hash of the text, its last bit telling whether there is an id.
_DOC = ["id", "tie"]
_PLACE = "id long, tie long, span long, digest binary"  # span: first line and number of lines, 32 bits each


def _candidates(rules, min_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, span, digest = [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                lines, found = spans(text, rules, min_lines)
                for at, n in found:
                    row.append(k)
                    span.append(at << 32 | n)
                    digest.append(xxhash.xxh3_128_digest("\n".join(lines[at : at + n]).encode()))
            yield _places(batch, row, span, digest)

    return run


def _places(batch: pa.RecordBatch, row: list[int], span: list[int], digest: list[bytes]) -> pa.RecordBatch:
    doc = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:2]]
    return pa.RecordBatch.from_arrays([*doc, pa.array(span, pa.int64()), pa.array(digest, pa.binary())], names=[*_DOC, "span", "digest"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its places (span, digest, goes): those of which no line goes."""
    for batch in batches:
        row, span, digest = [], [], []
        for k, found in enumerate(batch.column(2).to_pylist()):
            at = [(p["span"] >> 32, p["span"] & 0xFFFFFFFF) for p in found]
            edge = np.zeros(max(a + n for a, n in at) + 1, dtype=np.int64)
            for p, (a, n) in zip(found, at, strict=True):
                if p["goes"]:
                    edge[a] += 1
                    edge[a + n] -= 1
            upto = np.concatenate(([0], np.cumsum(np.cumsum(edge) > 0))).tolist()
            for p, (a, n) in zip(found, at, strict=True):
                if upto[a] == upto[a + n]:
                    row.append(k)
                    span.append(p["span"])
                    digest.append(p["digest"])
        yield _places(batch, row, span, digest)


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the fewest of the places that go whose lines are all lines that go."""
    for batch in batches:
        row, span, digest = [], [], []
        for k, found in enumerate(batch.column(2).to_pylist()):
            done, best, order = 0, None, sorted((p["span"] >> 32, p["span"] & 0xFFFFFFFF, p["digest"]) for p in found)
            for a, n, d in [*order, (1 << 31, 0, b"")]:
                if best and a > done:
                    # Nothing that starts within reach goes farther than the best.
                    row.append(k)
                    span.append(best[0] << 32 | best[1])
                    digest.append(best[2])
                    done, best = best[0] + best[1], None
                if a + n > max(done, best[0] + best[1] if best else 0):
                    best = (a, n, d)
        yield _places(batch, row, span, digest)


def _place() -> F.Column:
    """Places in order: null ids first, then by id, hash of the text, and line."""
    return F.struct(F.col("tie").bitwiseAND(1).alias("named"), "id", "tie", "span")


def _goes() -> F.Column:
    """Whether a place lies behind its chunk's keeper and does not overlap it."""
    same = (F.col("id") == F.col("keeper.id")) & (F.col("tie") == F.col("keeper.tie"))
    apart = F.shiftright("span", 32) - F.shiftright("keeper.span", 32) >= F.col("span").bitwiseAND(0xFFFFFFFF)
    return (_place() > F.col("keeper")) & (~same | apart)


def closed(found: set[tuple[tuple, bytes, bool | None]]) -> dict[bytes, tuple | None]:
    """Keepers of the chunks of places (place, digest, fixed) whose `fixed` is not known, as _settled() finds them.

    A place is (named, id, tie, span). All places of a document that has such a chunk must be there.
    """
    fixed = {(p, d): f for p, d, f in found if f is not None}
    docs, chunks = defaultdict(list), defaultdict(list)
    for p, d, f in found:
        docs[p[:3]].append((p, d))
        if f is None:
            chunks[d].append(p)

    def goes(p: tuple, keeper: tuple | None) -> bool:
        if keeper is None or p <= keeper:
            return False
        return p[:3] != keeper[:3] or (p[3] >> 32) - (keeper[3] >> 32) >= p[3] & 0xFFFFFFFF

    def keepers(of: dict[bytes, tuple | None]) -> dict[bytes, tuple | None]:
        best: dict[bytes, tuple | None] = dict.fromkeys(of)
        for here in docs.values():
            gone = []
            for p, d in here:
                if fixed[p, d] if (p, d) in fixed else goes(p, of.get(d)):
                    gone.append((p[3] >> 32, (p[3] >> 32) + (p[3] & 0xFFFFFFFF)))
            starts, ends = sorted(a for a, _ in gone), sorted(z for _, z in gone)
            for p, d in here:
                if d in best and (best[d] is None or p < best[d]):
                    first, behind = p[3] >> 32, (p[3] >> 32) + (p[3] & 0xFFFFFFFF)
                    # As many intervals end by its first line as begin before its end: none overlaps.
                    if bisect_right(ends, first) == bisect_left(starts, behind):
                        best[d] = p
        return best

    done: dict[bytes, tuple | None] = {}
    early: dict[bytes, tuple | None] = {d: min(ps) for d, ps in chunks.items()}
    late = keepers(early)
    while early:
        for d in [d for d in early if early[d] == late[d]]:
            done[d] = early.pop(d)
            fixed |= {(p, d): goes(p, done[d]) for p in chunks[d]}
        late = {d: late[d] for d in early}
        open_docs = {p[:3] for d in early for p in chunks[d]}
        docs = {k: v for k, v in docs.items() if k in open_docs}
        closer = keepers(late)
        if closer == early:
            return done | late
        early, late = closer, keepers(closer)
    return done


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = set()
    for batch in batches:
        for id_, tie, span, digest, fixed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.add(((tie & 1, id_, tie, span), digest, fixed))
    found = {d: p for d, p in closed(rows).items() if p is not None}
    kept = [dict(zip(("named", "id", "tie", "span"), p, strict=True)) for p in found.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(kept, _KEEPER)], names=["digest", "keeper"])


_KEEPER = pa.struct([(c, pa.int64()) for c in ("named", "id", "tie", "span")])


def _settled(places: DataFrame, repeated: DataFrame, total: int, local_places: int) -> DataFrame:
    """Keepers of the repeated chunks. Each keeper stays whole when all that lies behind keepers goes.

    Keepers taken too early make too much go; those still whole then are keepers for
    certain, though perhaps too late. What goes by these makes too little go, so the first
    places still whole are early again, but closer. A chunk is settled when both agree, and what becomes of its places
    is fixed; only documents with a chunk that is not go on. Rounds end when none is open. Chunks whose keepers hang on
    each other in a circle never agree: when nothing moves, the certain ones hold for them. What is left when documents
    with open chunks have at most local_places places goes through the same rounds within one task.
    """

    def keepers(of: DataFrame, digests: DataFrame) -> DataFrame:
        first = of.groupBy("digest").agg(F.min(_place()).alias("keeper"))
        return digests.select("digest", "copies").join(first, "digest", "left")

    def whole(rows: DataFrame, keepers: DataFrame) -> DataFrame:
        # A chunk without a keeper goes nowhere.
        judged = spread_join(rows.where("fixed is null").drop("fixed"), keepers, "digest", total, "left")
        judged = judged.select(*places.columns, F.coalesce(_goes(), F.lit(False)).alias("goes"))
        judged = judged.unionByName(rows.where("fixed is not null").withColumnRenamed("fixed", "goes"))
        # The places of one document are fewer than its lines times the rules.
        return judged.groupBy(*_DOC).agg(F.collect_set(F.struct("span", "digest", "goes")).alias("found")).mapInArrow(_whole, _PLACE)

    def unequal(a: DataFrame, b: DataFrame) -> bool:
        both = a.join(b.select("digest", F.col("keeper").alias("other")), "digest")
        return not both.where(~F.col("keeper").eqNullSafe(F.col("other"))).isEmpty()

    def rest(rows: DataFrame) -> DataFrame:
        """The keepers of the open chunks of few rows."""
        one = rows.select(*_DOC, "span", "digest", "fixed").coalesce(1)
        made = one.mapInArrow(_closed, "digest binary, keeper struct<named:bigint,id:bigint,tie:bigint,span:bigint>")
        return repeated.join(made, "digest").select("digest", "copies", "keeper")

    rows = places.withColumn("fixed", F.lit(None).cast("boolean"))
    if places.count() <= local_places:
        return rest(rows)
    early = stored(keepers(rows, repeated), "keepers")
    late = keepers(whole(rows, early), repeated)
    settled = []
    while True:
        both = early.join(late.select("digest", F.col("keeper").alias("late")), "digest", "left")
        both = stored(both.withColumn("same", F.col("keeper").eqNullSafe(F.col("late"))), "line-bounds")
        settled.append(both.where("same").select("digest", "copies", "keeper"))
        # Tables of their own, of known size: where they are small, the places stay where they are.
        open_ = stored(both.where("not same"), "line-open-chunks")
        if open_.isEmpty():
            break
        docs = rows.where("fixed is null").join(open_.select("digest"), "digest", "left_semi").select(*_DOC).distinct()
        docs = stored(docs, "line-open-documents")
        near = rows.join(docs, _DOC, "left_semi")
        fixed = spread_join(near.where("fixed is null").drop("fixed"), both, "digest", total, "left")
        fixed = fixed.select(*places.columns, F.when(F.col("same"), F.coalesce(_goes(), F.lit(False))).alias("fixed"))
        rows = stored(fixed.unionByName(near.where("fixed is not null")), "line-open")
        if rows.count() <= local_places:
            settled.append(rest(rows))
            break
        certain = open_.select("digest", "copies", F.col("late").alias("keeper"))
        closer = stored(keepers(whole(rows, certain), open_), "keepers")
        if not unequal(closer, open_):
            settled.append(certain)
            break
        early, late = closer, keepers(whole(rows, closer), open_)
    return reduce(DataFrame.unionByName, settled).where("keeper is not null")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per wanted chunk its place, digest, role and bytes."""
    for batch in batches:
        row, made = [], {"span": [], "digest": [], "first": [], "copies": [], "body": []}
        for k, (text, wanted) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3)), strict=True)):
            lines = (text or "").split("\n")
            for w in wanted:
                at = w["span"] >> 32
                row.append(k)
                made["body"].append("\n".join(lines[at : at + (w["span"] & 0xFFFFFFFF)]).encode())
                for c in ("span", "digest", "first", "copies"):
                    made[c].append(w[c])
        doc = [c.take(pa.array(row, pa.int64())) for c in batch.columns[:2]]
        kinds = (pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([*doc, *(pa.array(v, t) for v, t in zip(made.values(), kinds, strict=True))], names=[*_DOC, *made])


def _rebuilt(text_at: int):
    """Texts without their removed lines; `removed` is the last column and is replaced by counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            for text, removed in zip(
                batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True
            ):
                drop: set[int] = set()
                if removed and text is not None:
                    lines = text.split("\n")
                    for r in removed:
                        drop.update(range(r >> 32, (r >> 32) + (r & 0xFFFFFFFF)))
                    if drop:
                        text = "\n".join(x for i, x in enumerate(lines) if i not in drop)
                texts.append(text)
                gone.append(len(drop))
            columns = list(batch.columns[:-1])
            columns[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int32())], names=batch.schema.names)

    return run


def dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[tuple[int, int], ...] = RULES,
    min_lines: int = 2,
    salt_rows: int = 500,
    local_places: int = 10_000,
) -> DataFrame:
    """docs with repeated chunks of lines taken out of the text, and int n_removed_lines.

    A chunk goes where an earlier place, by (id, line) with null ids before all, still
    holds it whole; that place is never cut. Occurrences that overlap their keeper
    stay. All rows stay, in any number; a row emptied of lines has an empty text. Null
    texts stay null. Chunks between boundaries of fewer than min_lines lines are
    never removed. Rows of one id are told apart by a hash of their text, and so are those
    without an id; rows that repeat id and text are one document and share its decisions.
    Other columns are carried; one named n_removed_lines is replaced.
    """
    docs = docs.drop("n_removed_lines")
    names = docs.columns
    doc_id, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    tie = F.xxhash64(text).bitwiseAND(~1).bitwiseOR(doc_id.isNotNull().cast("long"))
    key = [F.coalesce(doc_id, F.lit(0)).alias("id"), tie.alias("tie")]
    slim = docs.select(*key, text.alias("text"))
    found = stored(slim.mapInArrow(_candidates(rules, min_lines), _PLACE), "line-chunks")
    repeated = stored(found.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1"), "line-repeats")
    rows = found.count()
    likely, _ = parted(found, repeated, ["digest"], repeated.count())
    places = stored(spread_join(likely, repeated, "digest", rows).select(found.columns), "line-places")
    keepers = _settled(places, repeated, rows, local_places)
    going = spread_join(places, keepers, "digest", rows).where(_goes())
    going = going.groupBy(*_DOC).agg(F.collect_set(F.struct("span", "digest")).alias("found")).mapInArrow(_cover, _PLACE)
    going = stored(going, "line-cover")
    used = keepers.join(going.groupBy("digest").agg(F.count("*").alias("uses")), "digest")
    used = stored(used.select("digest", "keeper", F.col("uses").alias("copies")), "line-used")
    firsts = used.select("keeper.id", "keeper.tie", F.struct("keeper.span", "digest", F.lit(True).alias("first"), "copies").alias("w"))
    others = spread_join(going, used, "digest", rows).select(*_DOC, F.struct("span", "digest", F.lit(False).alias("first"), "copies").alias("w"))
    wanted = firsts.unionByName(others).groupBy(*_DOC).agg(F.collect_list("w").alias("wanted"))
    cut, met = going.select(_DOC), used.select("keeper.id", "keeper.tie")
    n_cut = going.count()
    likely, _ = parted(slim, cut.unionByName(met), _DOC, n_cut + used.count())
    with_wanted = likely.join(wanted, _DOC).select(*_DOC, "text", "wanted")
    bodies = stored(
        with_wanted.mapInArrow(_texts, f"{_PLACE}, first boolean, copies long, body binary"), "line-bodies"
    )
    salts = F.ceil(F.col("copies") / F.lit(salt_rows)).cast("int")
    firsts = bodies.where("first").select(
        "digest", F.col("body").alias("kept"), F.explode(F.sequence(F.lit(0), salts)).alias("salt")
    )
    others = bodies.where("not first").withColumn("salt", F.pmod(F.xxhash64(*_DOC, "span"), salts + 1).cast("int"))
    gone = (
        others.join(firsts.dropDuplicates(["digest", "salt"]), ["digest", "salt"])  # rows may repeat a keeper
        .where("body = kept")
        .groupBy(*_DOC)
        .agg(F.collect_set("span").alias("removed"))
    )
    kept = [f"c{i}" for i in range(len(names))]
    carried = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, kept, strict=True)], *key)
    likely, whole = parted(carried, cut, _DOC, n_cut)
    joined = likely.join(gone, _DOC, "left").select(*kept, "removed")
    joined = joined.unionByName(whole.select(*kept, F.lit(None).cast("array<bigint>").alias("removed")))
    types = [f.dataType.simpleString() for f in docs.schema]
    schema = ", ".join(f"{c} {t}" for c, t in zip(kept, types, strict=True)) + ", n_removed_lines int"
    out = joined.mapInArrow(_rebuilt(names.index(text_col)), schema)
    return out.withColumnsRenamed(dict(zip(kept, names, strict=True)))


def deduped(docs: DataFrame, **options) -> DataFrame:
    """dedup() without the count: the columns of docs, one named n_removed_lines unchanged."""
    aside = {"n_removed_lines": "__n_removed_lines"} if "n_removed_lines" in docs.columns else {}
    out = dedup(docs.withColumnsRenamed(aside), **options).drop("n_removed_lines")
    return out.withColumnsRenamed({v: k for k, v in aside.items()})


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document row: doc_id, the text left, n_removed_lines."""
    return dedup(docs.select("doc_id", "text"), **options)
