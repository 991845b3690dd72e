import random
import zlib

import numpy as np
import pytest

from meshwright.llm import sharding


def test_difference_beats_greedy_spread():
    rng = random.Random(4)
    sizes = [rng.randint(1, 1000) for _ in range(400)]
    parts = [np.array([s, 0, 0, 0], np.int64) for s in sizes]
    fate = sharding.difference(parts, 4)
    sums = [sum(s for s, f in zip(sizes, fate, strict=True) if f[0] == k) for k in range(4)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 2
    # whole partial partitions: every part of one goes to a shard of its own
    halves = [np.array(sorted(rng.randint(1, 99) for _ in range(4)), np.int64) for _ in range(30)]
    assert all(sorted(f) == [0, 1, 2, 3] for f in sharding.difference(halves, 4))


@pytest.mark.parametrize(("bucket", "fan"), [(4096, 512), (16, 3)])
def test_shards(spark, monkeypatch, bucket, fan):
    monkeypatch.setattr(sharding, "BUCKET", bucket)
    monkeypatch.setattr(sharding, "FAN", fan)
    rng = random.Random(2)
    texts = ["é" * rng.randint(0, 300) + str(i % 150) for i in range(400)] + [None, ""] + ["same"] * 60
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(7, texts[7], 0)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, shard int"), shards=5).collect()
    assert len(got) == len(rows)
    by, homes = {}, {}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
        homes.setdefault(raw, set()).add(r.shard)
    assert all(sorted(x.slot for x in rows) == list(range(len(rows))) for rows in by.values())
    assert all(len(h) == 1 for h in homes.values())
    sums = [sum(x.size for x in by.get(k, [])) for k in range(5)]
    assert max(sums) - min(sums) <= 0.02 * sum(sums)


def test_empty(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_its_law(spark, data):
    """Every row once, equal texts together, slots gapless, and the shards as near as whole groups allow."""
    import zlib

    from meshwright.llm.queries import op10_kk_sharding

    rows = {r.doc_id: (r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = op10_kk_sharding(spark, data).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    shards, slots, place = [0] * 40, [[] for _ in range(40)], {}
    for r in got:
        raw = rows[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert place.setdefault(raw, r.shard) == r.shard
        shards[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    groups = {}
    for t in rows.values():
        groups[t] = groups.get(t, 0) + len(t.encode()) + 16
    # the plain greedy of largest first is no better
    plain = [0] * 40
    for b in sorted(groups.values(), reverse=True):
        k = plain.index(min(plain))
        plain[k] += b
    assert max(shards) - min(shards) <= max(plain) - min(plain) + 64
