import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from flowscope.llm import hmm
from flowscope.llm.hmm import Model, class_column, expected_counts, log_likelihoods, scored, stretches, word_class
from pyspark.sql import functions as F


def model_of(states, symbols, seed):
    rng = np.random.default_rng(seed)
    some = lambda *n: rng.dirichlet(np.ones(n[-1]), n[:-1] or None)
    return Model(some(states), some(states, states), some(states, symbols).T.copy())


def paths(m, s):
    """Every path of states with its joint probability with the sequence."""
    for path in itertools.product(range(len(m.start)), repeat=len(s)):
        p = m.start[path[0]] * m.emit[s[0], path[0]]
        for t in range(1, len(s)):
            p *= m.turn[path[t - 1], path[t]] * m.emit[s[t], path[t]]
        yield path, p


SEQUENCES = [np.array(x, np.int32) for x in ([0], [1, 2, 0], [3, 3, 1, 2, 0], [2, 0], [1, 1, 1, 0], [3, 0])]


def test_likelihoods_are_sums_over_all_paths():
    m = model_of(3, 4, 1)
    want = [math.log(sum(p for _, p in paths(m, s))) for s in SEQUENCES]
    assert np.allclose(log_likelihoods(m, SEQUENCES), want, atol=1e-12)


def test_likelihoods_do_not_depend_on_blocks_of_time(monkeypatch):
    rng, m = np.random.default_rng(2), model_of(4, 6, 3)
    sequences = [rng.integers(0, 6, n).astype(np.int32) for n in (1, 700, 3, 40, 40, 41, 2)]
    whole = log_likelihoods(m, sequences)
    monkeypatch.setattr(hmm, "TOKENS", 5)
    assert np.allclose(log_likelihoods(m, sequences), whole)
    assert np.allclose([log_likelihoods(m, [s])[0] for s in sequences], whole)


def test_expected_counts_are_sums_over_all_paths():
    m = model_of(3, 4, 4)
    start, turn, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3))
    for s in SEQUENCES:
        total = sum(p for _, p in paths(m, s))
        for path, p in paths(m, s):
            start[path[0]] += p / total
            for t, k in enumerate(path):
                emit[s[t], k] += p / total
                if t:
                    turn[path[t - 1], k] += p / total
    got = expected_counts(m, SEQUENCES)
    assert np.allclose(got[0], start) and np.allclose(got[1], turn) and np.allclose(got[2], emit)


def test_rounds_never_lower_the_likelihood():
    rng, rates = np.random.default_rng(5), np.full(5, 0.2)
    sequences = [rng.choice(5, 30, p=p).astype(np.int32) for p in ([0.6, 0.3, 0.1, 0, 0], [0, 0, 0.2, 0.3, 0.5]) for _ in range(20)]
    m, last = Model.first(rates, 3), -math.inf
    for _ in range(15):
        now = log_likelihoods(m, sequences).sum()
        assert now > last - 1e-9
        start, turn, emit = expected_counts(m, sequences)
        m, last = Model((start + 1e-12) / start.sum(), turn / turn.sum(1, keepdims=True), emit / emit.sum(0)), now
    assert last > 30 * 40 * math.log(0.2) + 100  # the two kinds of text are told apart


def test_stretches_hold_every_token():
    for n in (1, 1023, 1024, 1025, 5000):
        parts = stretches(np.arange(n))
        assert np.array_equal(np.concatenate(parts), np.arange(n)) and max(map(len, parts)) <= hmm.STRETCH


def test_classes_in_tasks_and_in_columns(spark):
    words = [b"", b"a", b"ab", "ouè".encode(), "日".encode(), b"word.", b"\xf0"]
    rows = spark.createDataFrame([(bytearray(w),) for w in words], "word binary").select("word", class_column().alias("k")).collect()
    assert {bytes(r.word): r.k for r in rows} == {w: word_class(w) for w in words}


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


@pytest.mark.parametrize("bounds", [(), (300, 500)])
def test_op11_against_plain_loops(spark, tiny, monkeypatch, bounds):
    """Every column again by dictionaries and loops; the model's own score from its tables, a word at a time."""
    fitted = []
    monkeypatch.setattr(hmm, "fit", lambda coded, words, states, f=hmm.fit: fitted.append((words, f(coded, words, states))) or fitted[0][1])
    table = spark.read.parquet(f"{tiny}/documents.parquet")
    rows = {r.doc_id: r for r in (scored(table, *bounds) if bounds else hmm.op11(spark, tiny)).collect()}
    docs = {r.doc_id: tokens(r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in docs}
    count = Counter(w for d in docs if not held[d] for w in docs[d])
    n, v = sum(count.values()), len(count)
    words, m = fitted[0]
    assert (words.total, words.distinct) == (n, v) and rows.keys() == docs.keys()
    assert not bounds or (0 < len(words.words) <= 300 and 0 < len(words.at_hand) <= 500 and len(count) > 2000)
    rare = {w: c for w, c in count.items() if w and w.encode() not in words.words}
    within = Counter(), Counter()
    for w, c in rare.items():
        within[0][word_class(w.encode())] += c
        within[1][word_class(w.encode())] += 1
    for d, text in docs.items():
        r, alpha, score = rows[d], None, 0.0
        for w in text:
            s = words.words.get(w.encode(), 0) if w else 0
            if w and not s:
                k = word_class(w.encode())
                s = words.first_class + k
                score += math.log10((rare.get(w, 0) + 0.1) / (within[0][k] + 0.1 * (within[1][k] + 1)))
            alpha = (m.start if alpha is None else alpha @ m.turn) * m.emit[s]
            score += math.log10(alpha.sum())
            alpha = alpha / alpha.sum()
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(text), sum(w in count for w in text), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
    assert sum(rows[d].score - rows[d].base_score for d in docs if held[d]) > 0
    assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.turn.sum(1), 1) and np.isclose(m.start.sum(), 1)


def test_odd_rows(spark):
    rows = [(i, "One two  three\tFOUR " * 3, 1) for i in range(30)] + [(100, None, 1), (100, "", 1), (None, "two two", 1), (7, "One two", 1), (7, "One two", 1)]
    rows += [(101, "zwei \x00  x " * 40_000, 1), (102, " \n ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumn("row", F.lit("x")).withColumn("symbols", F.lit(1))
    got = scored(docs).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.score < 0 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[102].n_tokens == 1 and by[101].n_tokens == 120_001 and not by[None].held_out
    assert len({(r.score, r.base_score) for r in got if r.doc_id == 7}) == 2 or len([r for r in got if r.doc_id == 7]) == 3
    assert scored(docs.filter("false")).count() == 0
    only = scored(docs.filter(hmm.held_out())).collect()  # nothing to learn from
    assert only and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in only)
