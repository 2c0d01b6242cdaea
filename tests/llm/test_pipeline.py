import subprocess
import sys
from itertools import combinations
from pathlib import Path

import corpus_pipeline
from cardsieve.llm import phrase_index, pii, simhash_ring

from test_near_copies import firsts, shingles

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    step, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, step = step, stage(spark, step, sf)
        assert step.columns == columns and step.count() <= before.count(), name
    ids = {r.doc_id for r in step.collect()}
    texts = {r.doc_id: shingles(r.text) for r in docs.collect()}
    near = [(r.component_id, r.doc_id) for r in simhash_ring.near_duplicates(docs).collect()]
    near += [(a, b) for a, b in combinations(sorted(texts), 2) if 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b])]
    bad = {r.doc_id for r in phrase_index.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").collect()}
    assert ids == firsts(texts, near) - bad
    assert pii.find(step).filter("base <> ''").count() == 0


def test_run_packs_what_is_left(spark, sf):
    pieces = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(pieces.columns) and pieces.count() > 0


def test_the_rest_works_without_this_package(tmp_path):
    """The entry point and the other queries still import when the folders are gone."""
    code = "import re, shutil, sys; shutil.copytree(sys.argv[1], sys.argv[2], ignore=shutil.ignore_patterns('llm', 'corpus_pipeline.py', '.git', 'tests')); sys.path.insert(0, sys.argv[2]); import __spark_entry__ as e; q = e.queries(); assert q and not any(re.match(r'op\\d', n) for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code, str(ROOT), str(tmp_path / "repo")], check=True, cwd=tmp_path)
