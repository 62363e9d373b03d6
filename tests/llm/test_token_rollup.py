import pytest
from flowscope.llm.common import new_path
from flowscope.llm.token_rollup import PATTERN, Counter, TokenRollup, changes, op2, token_counts

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
with open(PATH, "rb") as f:
    RANKS = f.read()


def test_counts_equal_the_encoder(spark, tiny):
    counter = Counter(RANKS, PATTERN, most=50)
    texts = [r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()] + ["", None, " \n\n x", "it's 123", "é" * 500]
    assert [counter.count(t) for t in texts] == [len(counter.encode(t or "")) for t in texts]


def test_op2_totals(spark, tiny):
    encode, want = Counter(RANKS, PATTERN).encode, {}
    for r in spark.read.parquet(f"{tiny}/documents.parquet").collect():
        t = want.setdefault((r.source, r.lang, "byte_bpe_50k/1"), [0, 0, 0])
        for i, x in enumerate((1, len(encode(r.text)), len(r.text))):
            t[i] += x
    assert {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens, r.chars] for r in op2(spark, tiny).collect()} == want


def test_deltas_and_retries(spark):
    cols = "source string, lang string, tokenizer string, tokens long, chars long"
    a = spark.createDataFrame([("s", "en", "v", 10, 50), ("s", None, "v", 5, 20), ("s", "en", "v", 1, 2)], cols)
    b = spark.createDataFrame([("s", "en", "v", 12, 50)], cols)
    store = TokenRollup(spark, new_path(spark, "rollup"))
    assert store.totals().count() == 0
    assert store.commit("1", changes(None, a)) and not store.commit("1", changes(None, a))
    assert store.commit("2", changes(a.filter("tokens = 10"), b)) and store.commit("3", changes(a.filter("lang is null"), None))
    want = {("s", "en", "v", 2, 13, 52)}
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact()
    assert {tuple(r) for r in store.totals().collect()} == want and len(store.parts()) == 1
    assert not store.commit("2", changes(None, b)) and store.commit("4", changes(None, b.filter("false")))
    store.compact()
    assert {tuple(r) for r in TokenRollup(spark, store.path).totals().collect()} == want and not store.commit("1", changes(None, a))


@pytest.mark.parametrize("n", [0, 2])
def test_odd_rows(spark, n):
    docs = spark.createDataFrame([(None, None, None, None), (1, "x y", "s", "en")][:n], "doc_id long, text string, source string, lang string")
    assert sorted(r.tokens for r in token_counts(docs, PATH, PATTERN, "v").collect()) == [0, 2][:n]


def test_very_long_text(spark):
    texts = ["word " * 200_000, "9" * 200_000, "\n" * 200_000]
    docs = spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    encode = Counter(RANKS, PATTERN).encode
    assert [r.tokens for r in token_counts(docs, PATH, PATTERN, "v").orderBy("doc_id").collect()] == [len(encode(t)) for t in texts]


def test_commits_do_not_rest_on_marker_files_of_spark(spark):
    rows = spark.createDataFrame([("s", "en", "v", 10, 50)], "source string, lang string, tokenizer string, tokens long, chars long")
    store = TokenRollup(spark, new_path(spark, "rollup"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        assert store.commit("1", changes(None, rows)) and store.totals().count() == 1
        store.compact()
        assert store.totals().count() == 1
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    changes(None, rows).groupBy("source").count().write.parquet(f"{store.path}/batch-broken")  # without our mark
    assert len(store.parts()) == 1
