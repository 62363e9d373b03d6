import numpy as np
from flowscope.llm import mixing
from flowscope.llm.mixing import BUCKETS, NO_TOPIC, POWERS, SHARES, Bags, calibrated, clusters, fit_topics, op9, sampled, with_topics


def raked(cells, targets, total, rounds=50):
    """Plain loops over {cell: tokens}."""
    scale = total / sum(cells.values())
    want = {c: n * scale for c, n in cells.items()}
    for _ in range(rounds):
        for i, share in enumerate(targets):
            now = {}
            for c, w in want.items():
                now[c[i]] = now.get(c[i], 0.0) + w
            want = {c: w * share.get(c[i], 0.0) * total / now[c[i]] if now[c[i]] > 0 else w for c, w in want.items()}
        want = {c: min(w, cells[c]) for c, w in want.items()}
    return want


def shares(cells, i, power, named):
    m = {}
    for c, n in cells.items():
        m[c[i]] = m.get(c[i], 0) + n
    m = {k: v for k, v in m.items() if v > 0}
    rest = {k: v**power for k, v in m.items() if k not in named}
    left = max(0.0, 1 - sum(named[k] for k in m if k in named))
    out = {k: named[k] if k in named else left * rest[k] / sum(rest.values()) for k in m}
    return {k: v / sum(out.values()) for k, v in out.items()}


def test_op9_against_plain_loops(spark, small):
    rows = op9(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    cells = {}
    for r in rows:
        k = (r.source, r.lang, r.topic)
        cells[k] = cells.get(k, 0) + r.tokens
    dims = ("source", "lang", "topic")
    targets = [shares(cells, i, POWERS.get(d, 1.0), SHARES.get(d, {})) for i, d in enumerate(dims)]
    want = raked(cells, targets, 0.5 * sum(cells.values()))
    for r in rows:
        k = (r.source, r.lang, r.topic)
        assert abs(r.probability - (want[k] / cells[k] if cells[k] else 0.5)) < 1e-4
    lang = {}
    for c, w in want.items():
        lang[c[1]] = lang.get(c[1], 0) + w / sum(want.values())
    assert abs(lang["en"] - 0.55) < 0.02
    # the residual is the worst of a row's margins
    reached = [{} for _ in dims]
    for c, w in want.items():
        for i in range(3):
            reached[i][c[i]] = reached[i].get(c[i], 0.0) + w / (0.5 * sum(cells.values()))
    for r in rows:
        off = max(abs(reached[i].get(r[d], 0.0) - targets[i].get(r[d], 0.0)) for i, d in enumerate(dims))
        assert not cells[r.source, r.lang, r.topic] or abs(r.residual - off) < 1e-4


def test_both_ways_to_rake_agree(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    a = {r.doc_id: r.probability for r in calibrated(docs, powers=POWERS, shares=SHARES, rounds=4).collect()}
    b = {r.doc_id: r.probability for r in calibrated(docs, powers=POWERS, shares=SHARES, rounds=4, on_driver=0).collect()}
    assert a.keys() == b.keys() and np.allclose([a[k] for k in a], [b[k] for k in a], atol=1e-9)


def test_odd_rows(spark):
    rows = [(1, None, None, None, "p"), (1, None, None, None, "p"), (None, "a b", "en", "s", "p"), (3, "", "en", "s", "p"), (4, "w " * 40000, "de", "t", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, probability string")
    got = calibrated(docs, powers=POWERS, shares=SHARES).collect()
    assert len(got) == 5 and all(0 <= r.probability <= 1 for r in got)
    out = sampled(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "probability", "mix_probability"] and out.count() == sum(r.sampled for r in got)
    assert all(r.probability == "p" and 0 < r.mix_probability <= 1 for r in out.collect())
    assert calibrated(docs.filter("false")).count() == 0 and sampled(docs.filter("false")).count() == 0
    assert {r.sampled for r in got if r.doc_id == 1} in ({True}, {False})


def test_unnamed_and_null_languages_keep_a_share(spark):
    langs = [*["en"] * 40, *["de"] * 20, *["fr"] * 20, *["es"] * 10, *["it"] * 6, *[None] * 4]
    docs = spark.createDataFrame([(i, "w " * 50, x, "s") for i, x in enumerate(langs)], "doc_id long, text string, lang string, source string")
    for on_driver in (50_000, 0):
        got = calibrated(docs, powers=POWERS, shares=SHARES, on_driver=on_driver).collect()
        want = {}
        for r in got:
            assert r.probability > 0
            want[r.lang] = want.get(r.lang, 0) + r.probability * r.tokens
        total = sum(want.values())
        # the four named ones share what "it" and null leave of their part of the tokens
        assert all(abs(want[k] / total - s) < 0.01 for k, s in {"it": 0.06, "": 0.04, "de": 0.135, "fr": 0.135}.items())
    some = {r.lang for seed in range(6) for r in sampled(docs, seed=seed).select("lang").distinct().collect()}
    assert some >= {"it", None}


def test_topics_tell_subjects_apart_and_repeat(spark):
    """Held-out texts of three subjects, whose words they share in part."""
    rng = np.random.default_rng(4)
    subjects = [[f"s{k}w{i}" for i in range(60)] for k in range(3)]
    common = [f"c{i}" for i in range(40)]
    text = lambda k: " ".join(rng.choice(subjects[k] + common, 80))
    docs = spark.createDataFrame([(i, text(i % 3)) for i in range(300)] + [(None, None), (900, " \n"), (901, "")], "doc_id long, text string")
    model = fit_topics(docs.filter("doc_id < 150 or doc_id >= 900"), topics=3)
    got = {r.doc_id: r.topic for r in with_topics(docs, model).collect()}
    assert {got[None], got[900], got[901]} == {NO_TOPIC}
    named = [{got[i] for i in range(k, 300, 3)} for k in range(3)]
    assert all(len(n) == 1 for n in named) and len(set.union(*named)) == 3
    again = fit_topics(docs.repartition(7).filter("doc_id < 150 or doc_id >= 900"), topics=3)
    assert np.allclose(model.centres, again.centres)
    assert len(fit_topics(docs.filter("false")).centres) == 0
    rows = np.eye(BUCKETS)[:2]
    assert len(clusters(rows, 8)) == 2 and Bags().of(b"A a b").sum() == 2**0.5 + 1


def test_topics_are_learned_from_every_row(spark):
    """A small subject that a sample of thousands would miss has a topic, and centres are those of plain k-means over all rows."""
    n, rare = 9000, [17, 4003, 8101]
    text = lambda i: " ".join(f"rare{j}" if i in rare else f"s{i % 3}w{(i + j) % 14}" for j in range(12))
    texts = {i: text(i) for i in range(n)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = fit_topics(docs, topics=4)
    got = {r.doc_id: r.topic for r in with_topics(docs, model).collect()}
    assert len({got[i] for i in rare}) == 1 and got[17] not in {t for i, t in got.items() if i not in rare}
    bags = np.array([Bags().of(t.encode()) for t in texts.values()])
    weights = np.log((1 + n) / (1 + (bags > 0).sum(0)))
    assert np.allclose(model.weights, weights)
    rows = bags * weights
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    unit = model.centres / np.linalg.norm(model.centres, axis=1, keepdims=True)
    own = np.argmax(rows @ unit.T, axis=1)
    for c in range(4):  # a fixed point of the rounds over all rows
        mean = rows[own == c].sum(0)
        assert np.allclose(mean / np.linalg.norm(mean), unit[c], atol=1e-4)
    again = fit_topics(docs.repartition(5), topics=4)
    assert (again.centres == model.centres).all()


def test_the_pipelines_sample_draws_by_topics_of_every_row(spark):
    """A row's chance in ``sampled`` is its own in ``calibrated`` with topics of all rows, also of a subject of two rows."""
    rare = (3, 4)  # a draw of 4,000 of these rows by their hash misses both
    text = lambda i: " ".join(f"s{i % 3 if i not in rare else 9}w{(i + j) % 14}" for j in range(12))
    docs = spark.createDataFrame([(i, text(i), "en", "s") for i in range(9000)], "doc_id long, text string, lang string, source string")
    want = {r.doc_id: r.probability for r in calibrated(docs, powers=POWERS, shares=SHARES, model=fit_topics(docs)).collect() if r.sampled}
    got = {r.doc_id: r.probability for r in sampled(docs).collect()}
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()))
    topics = {r.doc_id: r.topic for r in calibrated(docs, powers=POWERS, shares=SHARES).collect()}
    assert {topics[i] for i in rare}.isdisjoint({topics[i] for i in range(9000) if i not in rare})


def test_rounds_read_unit_vectors_many_in_a_row(spark, monkeypatch):
    """Bags become vectors once: one read for the weights and one for them, whatever the number of rounds."""
    texts = [*(" ".join(f"w{(i * j) % 40}" for j in range(1, 9)) for i in range(700)), "", None]
    bags = mixing.bagged(spark.createDataFrame([(t,) for t in texts], "text string")).localCheckpoint()
    weights = np.linspace(0.5, 2, BUCKETS)
    weights[3] = 0
    rows = mixing.vectors(bags.coalesce(1), weights)
    assert rows.count() == 2  # 512 bags and the rest
    got = []
    for sizes, at, v in mixing.flat_parts([b for b in rows.toArrow().to_batches()]):
        for a, b in zip(np.split(at, np.cumsum(sizes)[:-1]), np.split(v, np.cumsum(sizes)[:-1]), strict=True):
            out = np.zeros(BUCKETS)
            out[a] = b
            got.append(out)
    want = np.array([Bags().of(t.encode()) * weights for t in texts if t])
    want = np.rint(want / np.linalg.norm(want, axis=1, keepdims=True) * mixing.STEPS)
    assert np.abs(np.array(sorted(map(tuple, got))) - np.array(sorted(map(tuple, want)))).max() <= 1
    centres = np.vstack([want[0], want[1], np.zeros(BUCKETS)])
    flat = [np.flatnonzero(x) for x in want]
    products = mixing.products(np.array([len(x) for x in flat]), np.concatenate(flat), np.concatenate([w[x] for w, x in zip(want, flat, strict=True)]), centres)
    assert (products == want @ centres.T).all()
    read = []
    monkeypatch.setattr(mixing, "summed", lambda rows, *a, f=mixing.summed: read.append(rows.columns) or f(rows, *a))
    mixing.fit(bags, topics=3)
    assert read[0] == ["at", "n"] and len(read) > 2 and all(c == ["sizes", "at", "v"] for c in read[1:])
