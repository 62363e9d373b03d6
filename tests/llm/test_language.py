import random
import re
import time

import numpy as np
import pytest
from flowscope.llm.language import TextModel, buckets, document_rows, fit_text, identified, op8, page_rows, plain, without_tags


def test_likelihoods_one_by_one_and_in_a_batch():
    rng = np.random.default_rng(1)
    model = TextModel(["a", "b"], rng.integers(0, 50, (2, 1 << 14)).astype(float))
    texts = [b"some text here", b"", b"x", "é longer text, ".encode() * 40]
    both = model.likelihoods(texts)
    for i, t in enumerate(texts):
        assert np.allclose(both[i], model.likelihoods([t])[0], rtol=1e-4)
    h, _ = buckets([b"ab"])
    assert np.allclose(both.shape, (4, 2)) and len(h) >= 2
    assert plain(b"<p>a<script>var t='</p>';</script>b<!-- c -->&amp;d</p>").split() == [b"a", b"b", b"d"]


def test_op8_is_right_about_documents_and_pages(spark, small):
    rows = op8(spark, small).collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    mine = {r.doc_id: r.lang for r in rows if r.page_id is None}
    assert mine.keys() == docs.keys() and np.mean([mine[d] == x for d, x in docs.items()]) > 0.98
    pages = [r for r in rows if r.page_id is not None]
    assert len(pages) == spark.read.parquet(f"{small}/pages.parquet").count() and np.mean([r.lang == r.declared for r in pages]) > 0.95


def test_evidence_beyond_text(spark, small):
    model = fit_text(spark.read.parquet(f"{small}/documents.parquet"))
    french = "Les la de éeau que qui dans pour avec une " * 5
    html = [(i, f"http://h{i % 3}.site.fr/x", f'<html lang="fr"><p>{french}</p>', "e") for i in range(60)] + [(100, "http://h1.site.fr/", "<p></p>", "e"), (101, None, None, "e"), (101, None, None, "e"), (None, "no url", '<html lang="fr">', None)]
    pages = spark.createDataFrame(html, "page_id long, url string, html string, ll string")
    got = identified(page_rows(pages), model).collect()
    assert len(got) == 64 and all(0 < r.confidence <= 1 + 1e-9 for r in got)
    assert {r.lang for r in got if r.page_id in (0, 59, 100)} == {"fr"}
    assert identified(page_rows(pages.filter("false")), model).count() == 0
    none = fit_text(spark.createDataFrame([], "doc_id long, text string, lang string, source string"))
    assert {r.lang for r in identified(page_rows(pages), none).collect()} == {None}
    assert identified(document_rows(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")), model).count() == 1


def test_held_out_documents(spark, small):
    """Fitted on one half, judged on the other."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = fit_text(docs.filter("doc_id % 2 = 0"))
    rest = docs.filter("doc_id % 2 = 1")
    want = {r.doc_id: r.lang for r in rest.collect()}
    got = {r.doc_id: r.lang for r in identified(document_rows(rest), model).collect()}
    assert np.mean([got[d] == x for d, x in want.items()]) > 0.97


def test_fusion_against_plain_loops(spark, small):
    model = fit_text(spark.read.parquet(f"{small}/documents.parquet"))
    rng = np.random.default_rng(3)
    french, english = "Les la de que qui dans pour avec une ", "the of and with for that which are "
    html = [(i, f"http://h{rng.integers(4)}.s{rng.integers(3)}.{rng.choice(['fr', 'com', 'de'])}/x", f'<html lang="{rng.choice(["fr", "en", "de"])}"><p>{(french if rng.random() < 0.5 else english) * int(rng.integers(0, 3))}</p>') for i in range(80)]
    rows = page_rows(spark.createDataFrame([*html, (99, None, None), (98, None, None)], "page_id long, url string, html string"))
    langs, k = model.languages, len(model.languages)
    data = rows.collect()
    ll = model.likelihoods([plain((r.text or "").encode()) for r in data])
    p = np.exp(ll - ll.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    base = (p.sum(0) + 1) / (len(data) + k)
    sums = lambda test: sum((p[i] for i, r in enumerate(data) if test(r)), np.zeros(k))
    want = []
    for i, r in enumerate(data):
        logs = ll[i] + np.log(base)
        if r.host is not None:
            own, all_ = sums(lambda x: x.host == r.host), sums(lambda x: x.domain == r.domain)  # noqa: B023
            n = sum(x.host == r.host for x in data)
            dn = sum(x.domain == r.domain for x in data)
            prior = 5.0 * np.maximum(1e-9, (all_ + 5.0 * base - own) / (dn + 5.0 - n))
            logs = ll[i] + np.log((np.maximum(0.0, own - p[i]) + prior) / (n - 1 + 5.0))
        for col in ("declared", "suffix"):
            if r[col] is not None:
                mine, some = sums(lambda x: x[col] == r[col]), sums(lambda x: x[col] is not None)  # noqa: B023
                part = sum(x[col] == r[col] for x in data) / sum(x[col] is not None for x in data)  # noqa: B023
                logs = logs + np.log((mine + 20.0 * part) / (some + 20.0))
        post = np.exp(logs - logs.max())
        want.append((r.page_id, langs[int(np.argmax(post))], post.max() / post.sum()))
    got = {r.page_id: r for r in identified(rows, model).collect()}
    assert all(got[i].lang == x and abs(got[i].confidence - c) < 1e-4 for i, x, c in want)


def test_markup_is_taken_out_as_by_a_pattern_and_in_linear_time():
    pattern = re.compile(rb"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
    rng = random.Random(5)
    bits = [b"<", b">", b"<!--", b"-->", b"<script", b"</script>", b"</Script >", b"<style a>", b"</style>", b"a", b" b", b"<p>", b"</p>"]
    for _ in range(3000):
        html = b"".join(rng.choices(bits, k=rng.randrange(12)))
        assert without_tags(html).split() == pattern.sub(b" ", html).split(), html
    began = time.process_time()
    for unit in (b"<script ", b"<", b"<!--", b"<style>", b"</script"):
        without_tags(unit * 200_000)
    assert time.process_time() - began < 20


def test_ties_many_languages_and_long_texts(spark):
    model = TextModel(["a", "b"], np.ones((2, 1 << 14)))
    rows = document_rows(spark.createDataFrame([(1, "x y z", None), (2, "word " * 300_000, "s"), (2, "word " * 300_000, "s")], "doc_id long, text string, source string"))
    got = identified(rows, model).collect()
    assert len(got) == 3 and {r.lang for r in got} == {"a"} and all(abs(r.confidence - 0.5) < 1e-6 for r in got)
    many = spark.range(1500).selectExpr("id AS doc_id", "concat('l', id) AS lang", "'some text' AS text")
    with pytest.raises(ValueError, match="languages"):
        fit_text(many)
    assert fit_text(many, languages=["l1", "l7"]).languages == ["l1", "l7"]
    assert len(fit_text(many.filter("doc_id < 150")).languages) == 150


def test_domains_of_hosts(spark):
    urls = {"http://a.b.co.uk/x": "b.co.uk", "https://u@news.google.de:80/": "google.de", "http://co.uk": "co.uk", "http://x.y.com.br?q": "y.com.br", "http://host/": "host", "http://example.com": "example.com", "none": None}
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert [r.domain or None for r in page_rows(pages).orderBy("page_id").collect()] == list(urls.values())
