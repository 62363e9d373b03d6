import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
from flowscope.llm import divergence, queries
from flowscope.llm.divergence import audit, compared, op12, run_lengths, share, terms_of
from pyspark.sql import functions as F


def plain(rows):
    """The report by loops over all terms of all pairs."""
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in d[2])
        kept = sorted((t for t in held if held[t] >= 3), key=lambda t: t.encode())
        groups = {s: sum((d[2] for d in mine if d[1] == s), Counter()) for s in {d[1] for d in mine}}
        of = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        size = {s: sum(groups[s][t] for t in kept) for s in groups}
        whole = {t: sum(groups[s][t] for s in groups) for t in kept}
        q = {t: of(whole[t], sum(whole.values())) for t in kept}
        p = {s: {t: of(groups[s][t], size[s]) for t in kept} for s in groups}
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, 200)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)}
    return out


def as_set(df):
    return {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()}


def test_whole_table_equals_sql(spark, tiny):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tiny}/documents.parquet')")
    want = con.sql(queries.oracle_sql()["op12_source_divergence"]).fetchall()
    got = as_set(op12(spark, tiny))
    assert len(want) == len(got) and set(want) == got


def test_odd_rows_against_loops(spark):
    rng = random.Random(1)
    words = ["the", "The", "of", "Été", "été", "日本", "x1y", "naïve", " ", "rare"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None])) for _ in range(120)]
    rows += [(None, "en", "silent"), ("", "xx", "a"), ("1 2 3", "xx", "b"), ("once", "yy", "a"), ("the " * 30_000, "en", "a")] + [("same same", "en", "b")] * 4
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "key", "row", "n", "group", "item")})
    want = plain(rows)
    assert as_set(audit(docs)) == want and {x[2] for x in want} == {"pair", "term"}
    assert audit(docs.filter("false")).count() == 0


def test_two_hundred_leaders_in_order(spark):
    names = ["".join(chr(97 + int(d)) for d in f"{i:03d}") for i in range(450)]
    rows = [(" ".join(f"t{n} " * (i % 7 + 1) for i, n in enumerate(names)), "en", "a")] * 3 + [("other", "en", "b")] * 3
    got = as_set(audit(spark.createDataFrame(rows, "text string, lang string, source string")))
    assert got == plain(rows) and sum(x[1] == "a" and x[2] == "term" for x in got) == 200


def test_terms_of_bytes():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aAzZ@[`{é日\x00\x7f 09-\u0085 ") for _ in range(rng.randrange(40)))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        assert [t for ts in terms_of(text.encode()) for t in ts] == [x.encode() for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)]


def test_runs_over_batches_of_any_size(monkeypatch):
    rng = random.Random(3)
    rows = sorted((f"l\0{rng.choice('abcde')}\0{rng.choice('xyz')}".encode(), rng.randrange(1, 4), rng.randrange(4, 9)) for i in range(60))
    for size in (1, 2, 7, 60):
        monkeypatch.setattr(divergence, "RECORDS", size)
        batches = [pa.RecordBatch.from_pydict({c: [r[k] for r in rows[i : i + size]] for k, c in enumerate(("key", "docs", "n"))}) for i in range(0, 60, size)]
        out = pa.Table.from_batches(list(run_lengths(batches))).to_pylist()
        runs = {}
        for key, d, n in rows:
            at = tuple(key[2:].decode().split("\0"))
            docs, total = runs.get(at, (0, 0))
            runs[at] = docs + d, total + n
        assert {(r["term"], r["source"]): (r["docs"], r["n"]) for r in out} == runs
        assert {r["term"] for r in out if r["open"]} == {"a", "e"} and [r["lang"] for r in out] == ["l"] * len(out)
        assert all(r["total"] == sum(n for (t, _), (_, n) in runs.items() if t == r["term"]) for r in out if not r["open"])
    assert list(run_lengths([])) == [] and list(compared([])) == []


def test_comparisons_over_batches_of_any_size(monkeypatch):
    rng = random.Random(4)
    zero = {g: rng.randrange(1, 50) for g in range(9)}
    rows = [(t, "l", g, rng.randrange(1, 10**9), zero[g], rng.randrange(1, 10**9)) for t in "abcdefgh" for g in rng.sample(range(9), rng.randrange(1, 10))]
    names = ["term", "lang", "group", "p", "zero", "q"]

    def totals():
        batches = [pa.RecordBatch.from_pydict({n: [r[i] for r in rows[k : k + 4]] for i, n in enumerate(names)}) for k in range(0, len(rows), 4)]
        pairs, terms = Counter(), {}
        for r in (r for b in compared(batches) for r in b.to_pylist()):
            if r["b"] is None:
                terms.setdefault(r["a"], []).append((-r["v"], r["term"]))
            else:
                pairs[r["a"], r["b"]] += r["v"]
        return pairs, {g: sorted(x)[:2] for g, x in terms.items()}

    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for x in rows:
        for y in rows:
            if x[0] == y[0] and x[2] != y[2]:
                want[x[2], y[2]] += f(x[3], y[3]) - f(x[3], y[4]) - f(x[4], y[3]) + f(x[4], y[4])
    tops = {g: sorted((-f(r[3], r[5]), r[0]) for r in rows if r[2] == g and r[3] > r[5])[:2] for g in zero}
    monkeypatch.setattr(divergence, "LEADERS", 2)
    for sizes in ((200_000, 10**6, 10**6), (7, 5, 11), (1, 1, 1), (3, 100, 90)):
        for name, n in zip(("RECORDS", "PAIRS", "PARTIAL"), sizes, strict=True):
            monkeypatch.setattr(divergence, name, n)
        assert totals() == (want, {g: x for g, x in tops.items() if x})


def test_shares_are_exact_beyond_long(spark):
    rows = [(5 * 10**12, 7 * 10**12, 10**6), (0, 0, 1), (9 * 10**15 - 1, 9 * 10**15 - 2, 1), (3, 10, 4)]
    got = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", share("c", "n", "v").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (c + 1) // (n + v) for c, n, v in rows]
    assert spark.range(1).select(share("0L", "0L", "0L").alias("p")).head().p is None


def test_common_terms_and_single_sources_are_no_hot_spots(spark):
    docs = spark.range(4000).select(F.lit("ok").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    assert divergence.records(docs).count() <= docs.rdd.getNumPartitions() and as_set(audit(docs)) == set()
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    docs = spark.createDataFrame([(" ".join(words), "en", f"s{i}") for i in range(40)], "text string, lang string, source string")
    bounds = divergence.drawn_bounds(docs, 8)
    sizes = [r[1] for r in divergence.records(docs, bounds).groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8


def test_languages_with_zero_bytes(spark):
    rows = [("b c c", lang, source) for lang in ("a", "a\0b", "a\1", "\1\2", "\0") for source in ("c", "d", "\0", "c\0d")] * 3
    assert as_set(audit(spark.createDataFrame(rows, "text string, lang string, source string"))) == plain(rows)
