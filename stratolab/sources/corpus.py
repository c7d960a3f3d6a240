"""Guideline documents: reading, chunking, identifiers."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("hazard_class", "severity_tier", "region")
FRONT = r"(?s)\A---\s*\n(.*?)\n---\s*\n(.*)\z"


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, metadata, body, skipped) of Markdown files; skipped says why a file is not used."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return parse_documents(text)


def parse_documents(texts: DataFrame, text: str = "text") -> DataFrame:
    front = F.regexp_extract(text, FRONT, 1)
    body = F.regexp_replace(F.regexp_extract(text, FRONT, 2), r"^\s+|\s+$", "")
    lines = F.filter(F.split(front, "\n"), lambda x: x.contains(":"))
    pairs = F.transform(
        lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("value"))
    )
    # Of a repeated key the last line counts.
    kept = F.filter(pairs, lambda p: p["key"] != "")
    metadata = F.aggregate(
        kept,
        F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.map_from_arrays(F.array(p["key"]), F.array(p["value"]))),
    )
    out = texts.withColumns({"metadata": metadata, "body": body})
    lacking = F.filter(F.array(*map(F.lit, REQUIRED)), lambda k: F.coalesce(F.try_element_at("metadata", k), F.lit("")) == "")
    reason = (
        F.when(~F.col(text).rlike(FRONT), F.lit("no front matter"))
        .when(F.size(lacking) > 0, F.concat(F.lit("missing "), F.array_join(lacking, ", ")))
        .when(F.col("body") == "", F.lit("empty body"))
    )
    return out.withColumn("skipped", reason)


def _next_span(text: str, ends: list[int], done: int, size: int, overlap: int) -> tuple[int, int]:
    """Where the chunk after the first `done` characters starts and stops.

    It stops at the last paragraph's end within reach. A paragraph that would fit by
    itself pushes the start forward; a longer one stops at its last space.
    """
    start = max(0, done - overlap)
    reach = bisect_right(ends, start + size)
    if reach and ends[reach - 1] > done:
        return start, ends[reach - 1]
    end = ends[bisect_right(ends, done)]
    begins = text.rfind("\n\n", done, end) + 2 if "\n\n" in text[done:end] else done
    if end - begins <= size:
        return end - size, end
    space = text.rfind(" ", done + 1, start + size + 1)
    return start, space if space > 0 else start + size


def chunk_spans(body: str | None, size: int = 1200, overlap: int = 150) -> tuple[str, list[tuple[int, int]]]:
    """The body with its paragraphs one blank line apart, and where its pieces start and stop."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("the overlap is smaller than the chunk, which is positive")
    paragraphs = [p.strip() for p in re.split(r"\n\s*\n", body or "") if p.strip()]
    text = "\n\n".join(paragraphs)
    ends = list(accumulate(len(p) + 2 * (i > 0) for i, p in enumerate(paragraphs)))
    spans, done = [], 0
    while done < len(text):
        start, done = _next_span(text, ends, done, size, overlap)
        spans.append((start, done))
    return text, spans


def chunk_text(body: str | None, size: int = 1200, overlap: int = 150) -> list[str]:
    """Pieces of at most size characters that cover the body, each from up to overlap characters before the last one's end.

    Paragraphs stand apart by one blank line. A piece ends with a paragraph where it
    can, else at a space, else anywhere. White space at a piece's ends is left out; null and blank bodies have no piece.
    """
    text, spans = chunk_spans(body, size, overlap)
    return [piece for a, b in spans if (piece := text[a:b].strip())]


def chunk_places(documents: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """(document, n, start, stop, text) of documents (document, body), n from 0, places in the body as chunk_spans has it."""

    @F.udtf(returnType="n int, start int, stop int, text string")
    class Chunker:
        def eval(self, body: str):
            text, spans = chunk_spans(body, size, overlap)
            kept = [(a, b, piece) for a, b in spans if (piece := text[a:b].strip())]
            for n, (a, b, piece) in enumerate(kept):
                yield n, a, b, piece

    return documents.lateralJoin(Chunker(F.col("body").outer()))


def chunks(documents: DataFrame, size: int = 1200, overlap: int = 150) -> DataFrame:
    """(document, n, text, metadata) of documents (document, body, metadata), n from 0."""
    return chunk_places(documents, size, overlap).select("document", "n", "text", "metadata")


def chunk_id(document: Column, n: Column) -> Column:
    return F.format_string("%s-%04d", document, n)


def with_chunk_ids(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """rows with chunk_id, and metadata without nulls and with defaults where a key is absent."""
    base = F.create_map(*[F.lit(x) for p in sorted(defaults.items()) for x in p]) if defaults else F.create_map()
    own = F.map_filter("metadata", lambda _, v: v.isNotNull())
    missing = F.map_filter(base.cast("map<string,string>"), lambda k, _: ~F.map_contains_key(own, k))
    return rows.withColumns({"chunk_id": chunk_id(F.col("document"), F.col("n")), "metadata": F.map_concat(own, missing)})
