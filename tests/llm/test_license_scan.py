import random
import re

import pytest
from flowscope.llm.license_scan import FAMILIES, TEMPLATES, common, increasing, licenses, load_templates, op3, patience


def lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_alignment_is_a_common_subsequence_and_near_the_longest():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 25))]
        b = [rng.randrange(1, 30) for _ in range(rng.randrange(0, 25))]
        for pairs in (patience(a, b), common(a, b)):
            assert all(a[i] == b[j] for i, j in pairs)
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(common(a, b)) == lcs(a, b)
    assert increasing([(0, 5), (1, 1), (2, 3), (3, 2), (4, 4)]) == [(1, 1), (3, 2), (4, 4)]
    a = list(range(50))
    assert patience(a, a[:20] + [99, 98] + a[25:]) == [(i, i) for i in range(20)] + [(i, i - 3) for i in range(25, 50)]


def test_op3_finds_the_notices(spark, small):
    """Word for word, and with words of punctuation or numbers between, as in a text whose words are marked."""
    names = ("MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "CC-BY-NC-4.0-notice")
    folded = lambda t: [x for x in (w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~") for w in re.split(r"\s+", t)) if x]
    want = set()
    docs = {r.doc_id: folded(r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for d, w in docs.items():
        for name in names:
            t = folded(TEMPLATES[name])
            if any(w[i : i + len(t)] == t for i in range(len(w) - len(t) + 1)):
                want.add((d, name))
    rows = [r for r in op3(spark, small).collect() if r.license in names and r.coverage == 1]
    exact = {(r.doc_id, r.license) for r in rows}
    assert want and want <= exact
    for r in rows:
        assert lcs(folded(TEMPLATES[r.license]), docs[r.doc_id][r.start : r.end]) == len(folded(TEMPLATES[r.license]))


def test_edited_long_text_and_odd_rows(spark):
    w = TEMPLATES["MIT"].split()
    edited = " ".join(["so"] * 30 + w[:20] + ["really"] + w[22:60] + w[61:] + ["end"] * 10)
    rows = [(1, edited, 1), (2, None, 1), (None, "released UNDER the mit license", 1), (4, "", 2), (5, "a license for the under mit", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license int")
    got = {(r.doc_id, r.license): r for r in licenses(docs).collect()}
    assert set(got) == {(1, "MIT"), (None, "MIT-notice")}
    assert abs(got[1, "MIT"].coverage - (len(w) - 3) / len(w)) < 0.02 and got[1, "MIT"].start == 30
    assert licenses(docs.filter("false")).count() == 0


def test_whole_texts_two_ways(spark):
    """Places found are those of a search of every window by longest common subsequences; coverage below 1 too."""
    rng = random.Random(6)
    words = lambda t: [x for x in (w.lower().strip("!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~") for w in t.split()) if x]
    rows, names = [], ["ISC", "Zlib", "MIT-notice", "All-rights-reserved"]
    for i in range(24):
        w = TEMPLATES[names[i % 4]].split()
        cut = rng.choice([0, 0.05, 0.15, 0.3])
        kept = [x if rng.random() > cut / 2 else rng.choice(["other", ""]) for x in w if rng.random() > cut / 2]
        noise = lambda: [rng.choice(["so", "it", "the", "of", "license"]) for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(noise() + kept + noise())))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in licenses(docs, {n: TEMPLATES[n] for n in names}).collect():
        got.setdefault((r.doc_id, r.license), []).append(r)
    for i, text in rows:
        t = words(text)
        for n in names:
            w = words(TEMPLATES[n])
            best = max((lcs(w, t[a : a + len(w) * 3 // 2 + 1]) for a in range(0, len(t), 3)), default=0) / len(w)
            places = got.get((i, n), [])
            assert bool(places) == (best >= 0.8) or abs(best - 0.8) < 0.06, (i, n, best)
            for p in places:
                assert abs(p.coverage * len(w) - lcs(w, t[p.start : p.end])) <= 0.03 * len(w) + 1e-9 and p.coverage <= best + 1e-9 + 3 / len(w)


def test_long_templates_from_files(spark, tmp_path):
    text = " ".join(f"clause{i} the {i % 7} of" for i in range(1500))
    (tmp_path / "Long-1.0.txt").write_text(text)
    (tmp_path / "Short").write_text("Made freely by all.")
    templates = load_templates(spark, str(tmp_path))
    assert set(templates) == {"Long-1.0", "Short"}
    w = text.split()
    docs = spark.createDataFrame([(1, "x " * 3000 + " ".join(w[:2500] + w[2700:]) + " y" * 3000), (2, text + " " + text), (3, " ".join(w[:3000]))], "doc_id long, text string")
    got = sorted((r.doc_id, r.start, r.end, round(r.coverage, 2)) for r in licenses(docs, templates).collect())
    assert got == [(1, 3000, 8800, 0.97), (2, 0, 6000, 1.0), (2, 6000, 12000, 1.0)]
    with pytest.raises(ValueError, match="at most"):
        load_templates(spark, str(tmp_path), most=100)


def test_halved_tables_give_a_longest_subsequence():
    rng = random.Random(7)
    for _ in range(60):
        a, b = ([rng.randrange(1, 9) for _ in range(rng.randrange(0, 40))] for _ in range(2))
        pairs = common(a, b, cells=20)
        assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_other_licences_are_not_mistaken(spark):
    texts = [
        "Released under the BSD License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 2.",
        "This work is licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the Apache License, Version 1.1.", "It was released in May under strict rules the license", "all the rights he never had were reserved",
        "released to us under some terms that the old MIT file had, as a license", "Released under the X11 License.", "Licensed under CC BY-NC 3.0.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert licenses(docs).collect() == []
    right = ["so it is released under the mit license now", "Licensed under the Apache License Version 2.0", "licensed under CC BY-NC 4.0", "All Rights Reserved"]
    right += ["this work is licensed under the gnu general public license version 3"]
    got = licenses(spark.createDataFrame(list(enumerate(right)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == list(enumerate(["MIT-notice", "Apache-2.0-notice", "CC-BY-NC-4.0-notice", "All-rights-reserved", "GPL-3.0-notice"]))


def test_licences_of_a_family_compete(spark):
    names = [n for f in FAMILIES for n in f if n not in ("MIT-notice",)]
    docs = spark.createDataFrame([(i, f"so {TEMPLATES[n]} so") for i, n in enumerate(names)], "doc_id long, text string")
    got = licenses(docs).collect()
    assert sorted((r.doc_id, r.license) for r in got) == list(enumerate(names))
    both = spark.createDataFrame([(1, TEMPLATES["BSD-2-Clause"] + " so " + TEMPLATES["BSD-3-Clause"])], "doc_id long, text string")
    assert sorted(r.license for r in licenses(both).collect()) == ["BSD-2-Clause", "BSD-3-Clause"]
