from itertools import permutations

import duckdb
from flowscope.llm import queries
from flowscope.llm.filter_audit import audit, op13, word_counts
from pyspark.sql import functions as F


def plain(rows, labels):
    """The report by loops: each order applied to each document."""
    texts = [(d, t or "", lang or "") for d, t, lang in rows]
    first = {}
    for d, t, _ in texts:
        if d is not None:
            first[t] = min(d, first.get(t, d))
    docs = []
    for d, t, part in texts:
        words = [w for w in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if w]
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t)]
        fails += [any(c in t for c in "#$%&*|"), d is not None and d > first[t]]
        of = [x for x in labels if x[0] is not None and x[0] == d]
        docs.append((part, {k for k, f in zip("ABCDE", fails, strict=True) if f}, any(x[1] == 1 for x in of), any(x[2] == 1 for x in of)))
    out, sums = {}, {}
    for part in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in mine) - len(gone)
                left = [x for x in left if f not in x[1]]
                sums[part, f] = sums.get((part, f), 0) + len(gone)
                counts = (len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone))
                out[part, "".join(order), step] = counts
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def as_dict(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_whole_table_equals_sql(spark, tiny):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()["op13_filter_audit"])
    cols = want.columns
    assert {(r[0], r[1], r[2]): r[3:] for r in want.fetchall()} == as_dict(op13(spark, tiny).select(*cols))


def test_odd_rows_against_loops(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(1, "a b a", "en"), (2, "a b a", "en"), (None, "a b a", "en"), (3, "a b a", None), (4, long, "en"), (5, long, "de"), (5, long, "de")]
    rows += [(6, None, "en"), (7, "", "en"), (8, " \t\x0b\n", ""), (9, "x " * 60_000, "en"), (10, long + " LOUD", "fr"), (11, long + " $", "fr"), (11, "a b a", "fr")]
    rows += [(12, " nbsp is no white", "en"), (13, long.upper(), "en"), (None, None, None), (6, None, "en")]
    labels = [(4, 1, 0), (4, 0, 1), (9, None, 1), (None, 1, 1), (10, 1, None), (2, 1, 1), (77, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs = docs.withColumns({"word": F.lit(1), "quality": F.lit(1), "part": F.lit("p"), "text_hash": F.lit("h"), "digest": F.lit(0)})
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    assert as_dict(audit(docs, said)) == plain(rows, labels)
    assert audit(docs.filter("false"), said).count() == 0
    assert as_dict(audit(docs, said.filter("false"))) == plain(rows, [])


def test_counts_of_words(spark):
    rows = [(1, "b a b"), (1, "b a b"), (1, "B"), (None, " x\r\nx y "), (None, ""), (2, None), (3, "\x00 \x00")]
    got = {(r.doc_id, r.words, r.distinct_words) for r in word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 3, 2), (1, 1, 1), (None, 3, 2), (None, 0, 0), (2, 0, 0), (3, 2, 1)}


def test_texts_are_shuffled_once_and_words_never(spark, tiny):
    plan = word_counts(spark.read.parquet(f"{tiny}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
