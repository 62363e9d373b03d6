import random

import numpy as np
from flowscope.llm import decontaminate
from flowscope.llm.decontaminate import ItemIndex, Words, batch_words, decontaminated, distance, leaks, op4

import pyarrow as pa


def naive(item, words):
    """Full table: least edit distance of item to any stretch of words."""
    rows = [[0] * (len(words) + 1)]
    for i, w in enumerate(item, 1):
        row = [i]
        for j, v in enumerate(words, 1):
            row.append(min(rows[-1][j - 1] + (v != w), rows[-1][j] + 1, row[j - 1] + 1))
        rows.append(row)
    return min(rows[-1])


def test_distance_against_full_table():
    rng = random.Random(2)
    for _ in range(50):
        item = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 9))], np.uint64)
        words = np.array([rng.randrange(4) for _ in range(rng.randrange(0, 15))], np.uint64)
        assert distance(item, words)[0] == naive(item.tolist(), words.tolist())


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        p, kind = rng.randrange(len(w)), rng.randrange(3)
        w[p : p + 1] = [] if kind == 0 else [f"new{rng.randrange(10**6)}"] if kind == 1 else [w[p], f"new{rng.randrange(10**6)}"]
    return w


def test_recall_with_a_fifth_edited():
    """Of every length from five words on: random edits, and words exchanged at even distances; and of walks alone."""
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "to", "in"] * 40 + [f"word{i}" for i in range(3000)]
    for size in (5, 6, 7, 8, 9, 10, 12, 14, 16, 20, 24, 28, 31, 32, 33, 36, 40, 45, 50, 60, 100):
        items = [(i, " ".join(rng.choices(vocabulary, k=size))) for i in range(60)]
        index, walks, memo = ItemIndex(items), ItemIndex(items), Words()
        walks.pieces = {}
        for even in (False, True):
            texts, n = [], int(0.2 * size)
            for _, t in items:
                w, first = t.split(), rng.randrange(5)
                if even:
                    for j in range(n):
                        w[min(size - 1, first + 5 * j)] = f"new{rng.randrange(10**6)}"
                else:
                    w = edited(w, n, rng)
                texts.append(" ".join(rng.choices(vocabulary, k=80) + w + rng.choices(vocabulary, k=80)))
            words, bounds = batch_words(pa.array(texts), memo)
            recall = lambda x: np.mean([d in {d for d, i, *_ in x.leaks(words, bounds) if d == i} for d in range(len(items))])  # noqa: E731, B023
            assert recall(index) >= (0.9 if size >= 32 else 1.0), (size, even)
            assert size < 16 or recall(walks) >= 0.8, (size, even)
            assert all(d == i for d, i, *_ in index.leaks(words, bounds)) or size < 8


def test_what_a_batch_holds_beside_a_text_does_not_matter():
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(40))) for i in range(20)]
    texts = [" ".join([*t.split()[:38], "x"]) for _, t in items] + ["", "a", " ".join(f"w{rng.randrange(200)}" for _ in range(400))]
    index, memo = ItemIndex(items), Words()
    alone = [[x[1:] for x in index.leaks(*batch_words(pa.array([t]), memo))] for t in texts]
    words, bounds = batch_words(pa.array(texts), memo)
    assert [[x[1:] for x in index.leaks(words, bounds) if x[0] == d] for d in range(len(texts))] == alone


def test_op4_against_brute_force(spark, tiny):
    items = {r.item_id: Words().of(r.text.encode()) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{tiny}/documents.parquet").collect():
        w = Words().of(r.text.encode())
        for i, x in items.items():
            shared = np.isin(w, x)
            if shared.sum() * 2 >= len(x) and distance(x, w)[0] <= int(0.2 * len(x)):
                want.add((r.doc_id, i))
    assert want and {(r.doc_id, r.item_id) for r in op4(spark, tiny).collect()} == want


def test_odd_rows(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "lone pair"), (None, item)], "item_id long, text string")
    rows = [(1, None, "x"), (2, "", "x"), (3, "so ALPHA beta gamma delta... epsilon zeta eta theta iota kappa lambda mu!", "x"), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", None), (None, "a lone pair", "y"), (5, "lone other pair", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    got = sorted(((r.doc_id or -1, r.item_id, r.distance, r.start, r.end) for r in leaks(docs, bench).collect()), key=str)
    assert got == sorted([(-1, 4, 0, 1, 3), (3, 1, 0, 1, 13), (3, None, 0, 1, 13), (3, 1, 1, 0, 11), (3, None, 1, 0, 11)], key=str)
    assert sorted(r.doc_id for r in decontaminated(docs, bench).collect()) == [1, 2, 5]
    assert leaks(docs, bench.filter("false")).count() == 0 and decontaminated(docs.filter("false"), bench).count() == 0


def test_short_items_are_found_without_loss():
    rng = random.Random(8)
    for size in range(5, 32):
        item = [f"i{size}x{j}" for j in range(size)]
        index, memo, texts = ItemIndex([(1, " ".join(item))]), Words(), []
        for p in range(size):  # each single edit, the entry words' too
            for new in ([], ["other"], [item[p], "other"]):
                texts.append(" ".join(["so", *item[:p], *new, *item[p + 1 :], "on"]))
        texts += [" ".join(edited(item, int(0.2 * size), rng)) for _ in range(100)]
        words, bounds = batch_words(pa.array(texts), memo)
        got = {d for d, *_ in index.leaks(words, bounds)}
        assert got == set(range(len(texts)))


def test_many_items_go_block_by_block(spark, tiny, monkeypatch):
    docs, items = (spark.read.parquet(f"{tiny}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {tuple(r) for r in leaks(docs, items).collect()}
    kept = {r.doc_id for r in decontaminated(docs, items).collect()}
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (15, 8_000_000))
    assert want and {tuple(r) for r in leaks(docs, items).collect()} == want
    assert {r.doc_id for r in decontaminated(docs, items).collect()} == kept


def test_very_long_text(spark):
    item = " ".join(f"i{j}" for j in range(40))
    text = "so " * 400_000 + item + " on" * 400_000
    docs = spark.createDataFrame([(1, text), (2, "x" * 3_000_000)], "doc_id long, text string")
    assert [tuple(r) for r in leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()] == [(1, 7, 0, 400_000, 400_040)]
