import hashlib

import pytest
from flowscope.llm.common import new_path
from flowscope.llm.exact_dedup import DigestIndex, deduplicated, op5


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_op5_against_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    groups = {}
    for r in docs:
        groups.setdefault(hashlib.sha256(fold(r.text).encode()).hexdigest(), []).append(r.doc_id)
    want = sorted((d, max(g), len(g), d == max(g), h) for h, g in groups.items() for d in g)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op5(spark, tiny).collect())
    assert got == want


def test_second_batch_keeps_what_the_first_brought(spark):
    path = new_path(spark, "idx")
    index = DigestIndex(spark, path, 4)
    first = spark.createDataFrame([(1, "Ab"), (2, "aB"), (3, "x")], "doc_id long, text string")
    second = spark.createDataFrame([(9, "AB"), (10, "new"), (11, "NEW")], "doc_id long, text string")
    assert {r.doc_id for r in index.ingest(first, "a").collect() if r.kept} == {2, 3}
    got = {r.doc_id: r for r in DigestIndex(spark, path, 4).ingest(second, "b").collect()}
    assert [got[9].keep_id, got[9].kept, got[10].kept, got[11].kept] == [2, False, False, True]
    again = {r.doc_id: r.kept for r in index.ingest(second, "b").collect()}
    assert again == {9: False, 10: False, 11: True} and index.read().count() == 3


def test_odd_rows(spark):
    rows = [(None, None, "q"), (1, "", "q"), (1, "", "q"), (5, "É", "a"), (6, "é", "b"), (7, "tie", None), (7, "TIE", "z"), (8, "w " * 30000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    out = deduplicated(docs, DigestIndex(spark, new_path(spark, "idx"), 2), "b").collect()
    assert sorted(r.doc_id for r in out) == [1, 5, 6, 7, 8] and out[0].asDict().keys() == {"doc_id", "text", "digest"}
    empty = docs.filter("false")
    assert deduplicated(empty, DigestIndex(spark, new_path(spark, "idx"), 2), "b").count() == 0


def test_an_index_that_can_not_be_read_is_no_empty_one(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "idx"), 2)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert index.read().count() == 0
    index.ingest(docs, "one")
    for f in (tmp_path / "idx").glob("part-*"):
        f.write_bytes(b"no parquet")
    for f in (tmp_path / "idx").glob(".part-*"):
        f.unlink()
    with pytest.raises(Exception):
        index.ingest(docs, "two").count()
