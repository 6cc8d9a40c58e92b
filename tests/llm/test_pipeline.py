import zlib
from collections import Counter

import numpy as np
import pytest

from waymark.llm import packing, quality_rules

from .test_line_templates import brute as lines_brute
from .test_near_dedup import brute as near_brute
from .test_packing import PATH
from .test_quality_rules import brute as quality_brute
from .test_quality_rules import features_of
from .test_span_dedup import brute as spans_brute

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, docs_of, sample_texts, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    long_texts = [(i, t) for i, t in sample_texts if t and len(t.split()) >= 50]
    junk = [(2000 + i, " ".join(f"w{i * j % 991}#$%" for j in range(60))) for i in range(40)]
    rows = long_texts + junk + [(3000, None), (None, long_texts[0][1]), (long_texts[0][0], long_texts[0][1])]
    docs_of(rows).write.parquet(f"{top}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in long_texts] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages_hand_documents_on(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True)
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert not any(i is not None and i >= 2000 for i in ids)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).select("doc_id").distinct().count() == len(set(ids))


def test_run_equals_the_stages(spark, sf_dir):
    first = corpus_pipeline.run(spark, sf_dir)
    again = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert first.count() > 0 and first.select(key).exceptAll(again.select(key)).isEmpty()


def test_run_equals_brute_force(spark, docs_of, sample_texts, tmp_path):
    """Every stage by the brute-force version of its operator, the learned rules evaluated row by row."""
    top = str(tmp_path)
    shared = "Subscribe to the weekly letter of this site for free today"
    rows = [(i, f"{shared}\n{t}" if i % 4 == 0 else t) for i, t in sample_texts if t and 50 <= len(t.split()) < 1500]
    rows += [(1000 + i, " ".join(f"w{i * j % 991}#$%" for j in range(60))) for i in range(40)]
    passage = " ".join(f"q{i}" for i in range(60)) + ". "
    rows += [(2000 + i, passage + " ".join(f"own{'abcd'[i]}{j}" for j in range(70))) for i in range(4)]
    docs = docs_of(rows)
    docs.write.parquet(f"{top}/documents.parquet")
    labels = spark.createDataFrame([(i, int(not 1000 <= i < 2000), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{top}/labels.parquet")
    rules = quality_rules.learn_from_labels(docs, labels)
    assert rules.rules
    left = []
    for i, t in rows:
        words, _, _, _, repeat = quality_brute(t)
        if words >= 50 and 100 * repeat <= 50 * words and not rules.rejects(dict(zip(quality_rules.FEATURES, features_of(t), strict=True))):
            left.append((i, t))
    sizes = [len(rows), len(left)]
    left = [(i, t) for i, t, _, dropped in lines_brute(left) if not dropped or t.split()]
    kept = {i for i, _, _, stays in near_brute(left, 5, 80) if stays}
    left = [(i, t) for i, t in left if i in kept]
    sizes.append(len(left))
    before = dict(left)
    left = [(i, t) for i, t, removed in spans_brute(left) if not removed or t.split()]
    changed = sum(before[i] != t for i, t in left)
    own = packing.tokenizer(PATH)
    expected = Counter()
    for i, t in left:
        ids = own.library.encode(t, add_special_tokens=False).ids + [2]
        for k, (start, length) in enumerate(packing.cut(len(ids), 1024)):
            expected[i, k, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())] += 1
    found = corpus_pipeline.run(spark, top).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == expected
    assert sizes[0] > sizes[1] > sizes[2] and changed >= 3
    held = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in h) <= 1024 and sorted(h)[0][0] == 0 for h in held.values())


def test_stages_take_long_texts_and_columns_with_names_of_their_own(spark, sf_dir, docs_of):
    long = " ".join(f"w{i * i % 7919}x{i}" for i in range(30_000))
    rows = [(1, long), (2, None), (3, ""), (4, long + " end")]
    docs = docs_of(rows, ", n_lines string, n_dropped string, spans string, k1 string, row string, kept string, rule string, leaf string")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = {r.doc_id: r.text for r in stage(spark, docs, sf_dir).collect()}
        assert out[1] == long and out[2] is None and out[3] == "", name
    assert {r.doc_id for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()} == {1, 4}
    packed = corpus_pipeline.pack(spark, docs, sf_dir)
    assert {r.doc_id for r in packed.where("length = 1 AND piece = 0").collect()} == {2, 3}


def test_stages_take_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).collect() == []


def test_short_recurring_lines_go(spark, docs_of):
    rows = [(i, f"Les.\n\nand ornd\nown{'abc'[i]} words stand here") for i in range(3)]
    found = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs_of(rows), "").collect()}
    assert found == {0: rows[0][1], 1: "\nownb words stand here", 2: "\nownc words stand here"}
