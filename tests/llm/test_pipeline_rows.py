"""The whole pipeline on odd rows, on columns with clashing names, and on empty tables."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
from stratolab.llm import queries


@pytest.fixture
def folder(spark, sf_dir, tmp_path):
    def write(docs, labels=None):
        docs.write.parquet(f"file://{tmp_path}/documents.parquet")
        (labels if labels is not None else spark.read.parquet(f"{sf_dir}/labels.parquet")).write.parquet(f"file://{tmp_path}/labels.parquet")
        spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
        return f"file://{tmp_path}"

    return write


NAMES = "doc_id long, text string, key string, quality_score double, n_removed_lines int, n_hit long, spans string, ids string, c0 int, __k0 int"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "k", 0.5, 3, 4, "s", "x", 1, 2) for i, t in rows], NAMES)


def library(text):
    tokenizers = pytest.importorskip("tokenizers")
    ids = tokenizers.Tokenizer.from_file(queries.vocabulary_path()).encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_odd_rows_pass_through(spark, sf_dir, folder):
    """Without labels the classifier keeps all, so that odd rows reach every stage."""
    own = "\n".join(" ".join(f"{a}{b}" for b in "klmnopqrst") for a in "abcdefgh")
    other = "\n".join(" ".join(f"{a}{b}" for b in "klmnopqrst") for a in "uvwxyzij")
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, None), (2, ""), (3, " \n "), (4, own), (4, own), (5, other), (None, own), (None, None), (6, f"before {item} after"), (7, "tail " * 60_000)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = corpus_pipeline.run(spark, folder(wide(spark, rows), none)).collect()
    # Rows without words are one group; of the copies of `own` the row without an id comes first and keeps the lines,
    # which leaves id 4 without any; a text that is a benchmark's goes.
    kept = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in got}
    assert 6 not in kept and kept[5] == library(other) and kept[7] == library("tail " * 60_000)
    assert kept[1] == library("") and sorted(kept, key=str) == sorted([None, 1, 5, 7], key=str)
    assert kept[None] == library(own) and len(got) == 4


def test_stages_keep_columns_of_any_name(spark, sf_dir, folder):
    docs = wide(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30).collect()])
    where = folder(docs)
    at = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, where)
        assert at.columns == docs.columns and {tuple(r)[2:6] for r in at.collect()} <= {("k", 0.5, 3, 4)}


def test_empty_tables(spark, folder):
    docs = wide(spark, [])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, folder(docs, none)).count() == 0
