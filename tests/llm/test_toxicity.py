import math
import random
import re
import zlib

import numpy as np
from flowscope.llm.toxicity import accepted, fit, fit_logistic, op7, ruzzo_tompa, scored, training_rows


def every_maximal(x):
    """By definition: recursively, the best segment (leftmost, shortest) and the same on both sides of it."""
    def go(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += x[b]
                if total > 1e-12 and (best is None or total > best[2] + 1e-9):
                    best = (a, b + 1, total)
        return [] if best is None else [*go(lo, best[0]), best, *go(best[1], hi)]

    return go(0, len(x))


def test_segments_equal_the_definition():
    rng = random.Random(3)
    for _ in range(400):
        x = np.array([rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 7 for _ in range(rng.randrange(0, 18))])
        got, want = ruzzo_tompa(x), every_maximal(x)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_op7_on_held_out_rows(spark, small):
    rows = {r.doc_id: r for r in op7(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for d, r in rows.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [(rows[d].score, y) for d, y in labels.items() if rows[d].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.85
    assert np.mean([n < 0.5 for n in neg]) > 0.95


def test_odd_rows(spark):
    words = ["fine", "plain", "good", "word"]
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choices(words, k=20) + ["nasty"] * (i % 3 == 0))) for i in range(60)]
    docs = spark.createDataFrame([*texts, (100, None), (100, ""), (None, "nasty nasty"), (101, "12 !! 34"), (102, "good " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, int(i % 3 == 0), 1) for i in range(60)), (7, None, 1), (None, 1, 1), (5, 0, 0)], "doc_id long, toxic int, extra int")
    model = fit(docs, labels)
    got = scored(docs, model).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[None].score > 0.5 > by[102].score and [(p.start, p.end) for p in by[None].passages] == [(0, 11)]
    left = {r.doc_id for r in accepted(docs, model).collect()}
    assert None not in left and {1, 2, 100, 101, 102} <= left
    none = fit(docs, labels.filter("false"))
    assert {r.score for r in scored(docs, none).collect()} == {0.5}
    assert scored(docs.filter("false"), model).count() == 0


def test_scores_against_plain_loops(spark, tiny):
    """The whole of op7 again: counts, posterior rates, extreme values, curve and scores, by dictionaries and loops."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{tiny}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.doc_id in docs}
    folds = {r.doc_id: r.fold for r in training_rows(spark.read.parquet(f"{tiny}/labels.parquet"), 20_000, 5).collect()}
    assert folds.keys() == labels.keys()
    words = {d: [w for w in re.findall(r"[^\W\d_]+", docs[d].lower())] for d in docs}
    counts = {}
    for d, y in labels.items():
        for w in words[d]:
            for t in (w, w[:5] + "*"):
                c = counts.setdefault(t, {})
                c[folds[d], y] = c.get((folds[d], y), 0) + 1
    counts = {t: c for t, c in counts.items() if sum(c.values()) > 1}

    def learned(of):
        n = [sum(len(words[d]) for d, y in labels.items() if y == k and folds[d] in of) for k in (0, 1)]
        part = [2 * n[k] / (n[0] + n[1]) for k in (0, 1)]
        get = lambda t, k: sum(counts[t].get((f, k), 0) for f in of)

        def scores(tokens, lean):
            alpha = {t: (4.0 * part[0] * (1 - lean[t]), 4.0 * part[1] * lean[t]) for t in tokens}
            total = [sum(a[k] for a in alpha.values()) for k in (0, 1)]
            return {t: math.log((get(t, 1) + alpha[t][1]) / (n[1] + total[1])) - math.log((get(t, 0) + alpha[t][0]) / (n[0] + total[0])) for t in tokens}

        prefix = scores([t for t in counts if t.endswith("*")], dict.fromkeys(counts, 0.5))
        word = scores([t for t in counts if not t.endswith("*")], {t: 1 / (1 + math.exp(-prefix.get(t[:5] + "*", 0.0))) for t in counts})
        return {t: x - 0.5 for t, x in {**prefix, **word}.items()}

    weigh = lambda table, d: np.array([table.get(w, table.get(w[:5] + "*", -0.5)) for w in words[d]])
    best = lambda x: max([s for *_, s in every_best(x)], default=0.0)
    by_fold = [learned([1]), learned([0])]
    plain = [weigh(by_fold[folds[d]], d) for d, y in labels.items() if not y]
    flat = np.concatenate([*plain, [-0.5, 0.25]])
    lo, hi = 1e-3, 20.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.mean(np.exp(np.minimum(mid * flat, 500))) < 1 else (lo, mid)
    ln_k = np.mean([lo * best(x) - math.log(len(x)) for x in plain if len(x)]) - np.euler_gamma

    def facts(x):
        floor = ln_k + math.log(len(x) + 1)
        over = [lo * s - floor for *_, s in every_best(x)]
        return [min(max(over, default=-floor), 60.0), math.log1p(sum(v for v in over if v > -math.log(0.01)))]

    beta = fit_logistic(np.array([facts(weigh(by_fold[folds[d]], d)) for d in labels]), np.array([float(labels[d]) for d in labels]))
    table = learned([0, 1])
    for r in op7(spark, tiny).collect():
        f = facts(weigh(table, r.doc_id))
        assert abs(r.score - 1 / (1 + math.exp(-(beta[0] + beta[1] * f[0] + beta[2] * f[1])))) < 0.01, r.doc_id


def every_best(x):
    """Segments by the definition's recursion, the best of a stretch found from running sums."""
    out, todo = [], [(0, len(x))]
    total = np.concatenate([[0.0], np.cumsum(x)])
    while todo:
        lo, hi = todo.pop()
        low, top = lo, (0.0, 0, 0)
        for b in range(lo + 1, hi + 1):
            if total[b] - total[low] > top[0] + 1e-9:
                top = (total[b] - total[low], low, b)
            if total[b] < total[low]:
                low = b
        if top[0] > 1e-9:
            out.append((top[1], top[2], top[0]))
            todo += [(lo, top[1]), (top[2], hi)]
    return out
