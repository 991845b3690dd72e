import hashlib
import re

from meshwright.llm.exact_dedup import DigestIndex, exact_dedup

DOCS = [(5, "a  b\t c"), (2, "a b c"), (2, "a b c"), (9, None), (8, ""), (7, "x"), (None, "x"), (None, "only"), (11, "long " * 5000)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "kept", 1) for i, t in rows], "doc_id long, text string, keep_id string, _digest int")


def test_decisions(spark):
    got = DigestIndex.temporary(spark, 4).admit(docs(spark, DOCS)).collect()
    by = {}
    for r in got:
        by.setdefault(bytes(r._digest), []).append(r)
    for text, ids, keep in (("a b c", 3, 2), ("", 2, 8), ("x", 2, 7), ("only", 1, None)):
        rows = by[hashlib.sha256(text.encode()).digest()]
        assert len(rows) == ids == rows[0].group_size and sum(r.kept for r in rows) == 1
        assert {r.keep_id for r in rows} == {keep} and next(r for r in rows if r.kept).doc_id == keep


def test_later_batches(spark):
    index = DigestIndex.temporary(spark, 4)
    first = exact_dedup(docs(spark, DOCS), index)
    assert first.columns == ["doc_id", "text", "keep_id", "_digest"]
    assert sorted(re.sub(r"\s+", " ", r.text or "")[:9] for r in first.collect()) == ["", "a b c", "long long", "only", "x"]
    again = index.admit(docs(spark, [(1, "a b c"), (3, "new")]))
    assert {(r.doc_id, r.keep_id, r.kept) for r in again.collect()} == {(1, 2, False), (3, 3, True)}
    assert index.rows().count() == 6
    assert index.admit(docs(spark, [])).count() == 0


def test_query(same_rows):
    same_rows("op1_exact_dedup")


def test_compaction_keeps_the_index(spark):
    index = DigestIndex.temporary(spark, buckets=3)
    batches = [spark.createDataFrame([(10 * k + i, f"text {i * (k + 1)}") for i in range(9)], "doc_id long, text string") for k in range(3)]
    for b in batches[:2]:
        index.admit(b).count()
    before = sorted(map(tuple, index.rows().collect()))
    index.compact()
    assert sorted(map(tuple, index.rows().collect())) == before
    again = index.admit(batches[0])
    index.drop()
    assert again.where("kept").count() == 0 and again.count() == 9
