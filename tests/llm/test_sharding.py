import hashlib
from collections import defaultdict

from waymark.llm import sharding as sh


def brute(rows, limit):
    def bits(doc_id, text):
        inner = hashlib.md5((text or "").encode()).hexdigest()
        key = f"{'' if doc_id is None else doc_id}:{inner}"
        return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)

    sized = [(i, len((t or "").encode()), bits(i, t)) for i, t in rows]
    out = []

    def split(part, depth, prefix):
        total = sum(n for _, n, _ in part)
        if total <= limit or depth == sh.BITS:
            out.extend((i, n, f"{depth}-{prefix}", total, total > limit) for i, n, _ in part)
            return
        for bit in (0, 1):
            half = [r for r in part if r[2] >> (sh.BITS - depth - 1) & 1 == bit]
            if half:
                split(half, depth + 1, 2 * prefix + bit)

    split(sized, 0, 0)
    return sorted(out, key=repr)


def test_equals_splitting_by_hand(docs_of, sample_texts):
    rows = sample_texts + [(None, "a" * 700), (None, "b" * 900), (77, "same " * 400), (77, "same " * 400)]
    for limit in (10**9, 3000, 500):
        found = sh.sharded(docs_of(rows, ", shard string, bits string"), limit).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.shard, r.shard_bytes, r.oversized) for r in found), key=repr) == brute(rows, limit)
    assert sh.sharded(docs_of(rows).limit(0), 100).collect() == []


def test_written_shards_hold_every_row(spark, docs_of, sample_texts, tmp_path):
    docs = docs_of(sample_texts)
    sh.write_shards(docs, 4000, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(sample_texts, key=repr)
    sizes = defaultdict(list)
    for r in back.collect():
        sizes[r.shard].append(len((r.text or "").encode()))
    assert all(sum(v) <= 4000 or len(v) == 1 for v in sizes.values())
