"""Language identification by Bayesian fusion of evidence.

log P(language | evidence) is the sum of a prior and of independent likelihoods: the text's byte trigrams (naive Bayes),
the declared markup language and the address suffix. The prior of a row comes from the other rows of its host, smoothed
towards those of its domain, and these towards the whole table: soft counts from grouped aggregation. The likelihoods of
declarations and suffixes are counted the same way, so a misleading declaration weighs only as much as it is right.

The trigram model is fitted on about ``per_language`` documents a language, drawn by a hash; its tables have a fixed size.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscope.llm.common import bounded, join_counted, pieces, written

BUCKETS = 1 << 14
#: More languages are refused: a model takes 64 kB for each. Name the ones to tell apart then.
MOST_LANGUAGES = 1000
#: Trigrams overlap and repeat: n of them count as n / (1 + n / EFFECTIVE).
EFFECTIVE = 40.0
#: Weight of the domain's distribution in a host's, and of the whole table's in a domain's, in rows.
SMOOTH = 5.0
#: Rows of evidence below which a declaration or suffix says little.
PSEUDO = 20.0

_ENTITY = re.compile(rb"&[#\w]+;")
_OPEN = re.compile(rb"(script|style)\b", re.I)
_CLOSE = {k: re.compile(rb"</" + k + rb"\s*>", re.I) for k in (b"script", b"style")}


def without_tags(html: bytes) -> bytes:
    """No comments, scripts, styles and tags; what isn't closed: a script is its tag only, a tag is text. Linear: no end is looked for twice."""
    out, at, missing = [], 0, set()

    def end_of(kind, find) -> int:
        if kind in missing:
            return -1
        end = find()
        if end < 0:
            missing.add(kind)
        return end

    start = html.find(b"<")
    while start >= 0:
        end = -1
        if html.startswith(b"<!--", start):
            end = end_of("comment", lambda s=start: html.find(b"-->", s + 4) + 3 if html.find(b"-->", s + 4) >= 0 else -1)
        elif m := _OPEN.match(html, start + 1):
            name = m.group(1).lower()
            end = end_of(name, lambda s=m.end(), name=name: x.end() if (x := _CLOSE[name].search(html, s)) else -1)
        if end < 0:
            end = end_of("tag", lambda s=start: html.find(b">", s) + 1 or -1)
        if end < 0:
            break
        out.append(html[at:start])
        at, start = end, html.find(b"<", end)
    return b" ".join([*out, html[at:]])


def plain(html: bytes) -> bytes:
    """Text of a page: no comments, scripts, styles, tags or entities."""
    return _ENTITY.sub(b" ", without_tags(html))


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Trigram buckets of all texts, one after the other, and where each begins; a text is framed by spaces.

    Places whose trigram would run into the next text have the bucket BUCKETS.
    """
    framed = [b" %b " % t.lower() if t else b"" for t in texts]
    starts = np.cumsum([0, *map(len, framed)])
    raw = np.frombuffer(b"".join(framed) + b"  ", np.uint8).astype(np.uint32)
    h = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA6B)) ^ (raw[2:] * np.uint32(0xC2B2AE35))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    out = (h >> np.uint32(18)).astype(np.int64)
    ends = starts[1:][np.diff(starts) > 0]
    out[ends - 1] = BUCKETS
    out[ends - 2] = BUCKETS
    return out, starts


class TextModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        logs = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS))
        self.table = np.column_stack([logs, np.zeros(len(counts))]).astype(np.float32)

    def likelihoods(self, texts: list[bytes]) -> np.ndarray:
        """log-likelihood of each text in each language, discounted; zeros for an empty one."""
        return np.concatenate([np.zeros((0, len(self.languages))), *(self._likelihoods(texts[p]) for p in pieces(list(map(len, texts))))])

    def _likelihoods(self, texts: list[bytes]) -> np.ndarray:
        h, starts = buckets(texts)
        n = np.diff(starts)
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(n > 0)
        if len(full):
            for k in range(len(self.languages)):
                out[full, k] = np.add.reduceat(self.table[k][h], starts[full], dtype=np.float64)
        return out / (1 + n / EFFECTIVE)[:, None]


def fit_text(docs: DataFrame, per_language: int = 2000, languages: list[str] | None = None) -> TextModel:
    """From the ``lang`` of documents, about ``per_language`` rows of each, drawn by a hash of doc_id.

    All languages that occur, or those named. Rows without a language or text don't count; rows with a null doc_id share
    one draw; repeated rows count as often as they are drawn. No rows: a model of no language.
    """
    if languages is not None:
        docs = docs.filter(F.col("lang").isin(languages))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "text").filter("lang is not null and lang <> '' and length(text) > 0")
    sizes = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: name those to tell apart")
    languages = sorted(r["lang"] for r in sizes)
    share = {r["lang"]: min(1.0, per_language / r["count"]) for r in sizes}
    if not languages:
        return TextModel([], np.zeros((0, BUCKETS)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    place = {x: i for i, x in enumerate(languages)}
    limit = F.coalesce(*[F.when(F.col("lang") == k, F.lit(v)) for k, v in share.items()], F.lit(0.0))

    def run(batches):
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        for batch in bounded(batches, 1):
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            h, starts = buckets(batch.column(1).cast(pa.binary()).to_pylist())
            keys, n = np.unique((np.repeat(lang, np.diff(starts)) * BUCKETS + h)[h < BUCKETS], return_counts=True)
            total[keys] += n
        keys = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(total[keys])], ["k", "n"])

    got = rows.filter(draw < limit).select("lang", "text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(languages) * BUCKETS)
    counts[got["k"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return TextModel(languages, counts.reshape(len(languages), BUCKETS))


def text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows (doc_id, page_id, markup, text, host, domain, suffix, declared) with ``ll`` in place of markup and text."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    keep = ["doc_id", "page_id", "host", "domain", "suffix", "declared"]

    def run(batches):
        for batch in bounded(batches, 7, 4 << 20):
            marked = batch.column(6).to_pylist()
            texts = [plain(t.as_py() or b"") if m else t.as_py() or b"" for m, t in zip(marked, batch.column(7).cast(pa.binary()), strict=True)]
            ll = shipped.value.likelihoods(texts)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(6)), pa.array(list(ll), pa.list_(pa.float64()))], [*keep, "ll"])

    return rows.select(*keep, "markup", "text").mapInArrow(run, "doc_id long, page_id long, host string, domain string, suffix string, declared string, ll array<double>")


def _normal(logs):
    """Probabilities from an array of logs."""
    top = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(top, lambda x: x / F.aggregate(top, F.lit(0.0), lambda a, b: a + b))


def identified(rows: DataFrame, model: TextModel) -> DataFrame:
    """(doc_id, page_id, lang, confidence, text_lang, declared) of every row.

    A row without text is decided by its other evidence; with none at all by the whole table's distribution. Null hosts,
    suffixes and declarations are no evidence. Repeated rows count as often as they occur. Ties go to the first language
    by name. If no language is known lang is null.
    """
    langs = model.languages
    if not langs:
        null = F.lit(None).cast("string")
        return rows.select("doc_id", "page_id", null.alias("lang"), F.lit(0.0).alias("confidence"), null.alias("text_lang"), "declared")
    k = len(langs)
    soft = written(text_evidence(rows, model).withColumn("p", _normal(F.col("ll"))), "evidence")
    each = lambda f: F.array(*(f(i) for i in range(k)))
    sums = lambda: [*(F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k)), F.count("*").alias("n")]
    whole = soft.agg(*sums()).head()
    n = whole["n"] or 0
    base = [((whole[f"s{i}"] or 0.0) + 1) / (n + k) for i in range(k)]

    def likelihood(col):
        """(value, n, log P(value | language)) by soft counts; as an array over the languages."""
        m = soft.filter(F.col(col).isNotNull()).groupBy(col).agg(*sums())
        some = m.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k)), F.sum("n").alias("n")).head()
        total = float(some["n"] or 0)
        overall = F.col("n") / F.lit(max(total, 1.0))
        logs = each(lambda i: F.log((F.col(f"s{i}") + PSEUDO * overall) / (float(some[f"s{i}"] or 0) + PSEUDO)))
        return written(m.select(col, F.col("n").alias(f"n_{col}"), logs.alias(f"ll_{col}")), f"by-{col}"), int(total)

    hosts = written(soft.filter("host is not null").groupBy("host", "domain").agg(*sums()), "host-sums")
    parts = [(F.sum(f"s{i}") + SMOOTH * base[i]).alias(f"d{i}") for i in range(k)]
    domain = written(hosts.groupBy("domain").agg(*parts, (F.sum("n") + SMOOTH).alias("dn"), F.count("*").alias("hosts")), "domain-sums")
    host = join_counted(hosts, domain, "domain", "hosts", hosts.count())  # a domain may have most hosts
    # a domain's part without the host's own rows, so that nothing counts twice
    smooth = lambda i: SMOOTH * F.greatest(F.lit(1e-9), (F.col(f"d{i}") - F.col(f"s{i}")) / (F.col("dn") - F.col("n")))
    host = written(host.select("host", F.col("n").alias("n_host"), each(lambda i: F.col(f"s{i}")).alias("h_sum"), each(smooth).alias("h_prior")), "by-host")

    out = soft
    prior = F.array(*(F.lit(float(b)) for b in base))
    out = _looked_up(out, host, "host", "n_host", soft.filter("host is not null").count())
    own = F.transform(F.arrays_zip("h_sum", "h_prior", "p"), lambda x: F.log((F.greatest(F.lit(0.0), x["h_sum"] - x["p"]) + x["h_prior"]) / (F.col("n_host") - 1 + SMOOTH)))
    logs = F.zip_with(F.coalesce(own, F.transform(prior, lambda x: F.log(x))), F.col("ll"), lambda a, b: a + b)
    for col in ("declared", "suffix"):
        table, total = likelihood(col)
        out = _looked_up(out, table, col, f"n_{col}", total)
        logs = F.zip_with(logs, F.coalesce(f"ll_{col}", F.array_repeat(F.lit(0.0), k)), lambda a, b: a + b)
    names = F.array(*map(F.lit, langs))
    first = lambda a: F.get(names, (F.array_position(a, F.array_max(a)) - 1).cast("int"))
    out = out.withColumn("post", _normal(logs))
    text_lang = F.when(F.array_max("ll") < 0, first(F.col("ll")))
    return out.select("doc_id", "page_id", first(F.col("post")).alias("lang"), F.array_max("post").alias("confidence"), text_lang.alias("text_lang"), "declared")


def _looked_up(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Left join to the counts of a value, safe if one value has most rows."""
    found = join_counted(rows.filter(F.col(key).isNotNull()), table, key, n, total)
    return found.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


#: The domain of a host: its last two labels, or three where the last but one is a country's own class of domains.
DOMAIN = r"([^.]*\.)?((co|com|org|net|gov|edu|ac|ne|or|go)\.[a-z]{2}|[^.]*)$"


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages: the host's last two labels are the domain, three where the last but one is general (``co.uk``), the last is the
    suffix; the html element declares the language."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    some = lambda c: F.when(c != "", c)
    host = some(F.lower(F.regexp_extract(url, r"^[^/?#]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    declared = some(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1)))
    null = F.lit(None).cast("bigint")
    return pages.select(null.alias("doc_id"), F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), F.regexp_extract(host, DOMAIN, 0).alias("domain"), some(F.regexp_extract(host, r"\.([a-z]+)$", 1)).alias("suffix"), declared.alias("declared"), F.lit(True).alias("markup"), html.alias("text"))


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents: the source stands for the host; nothing is declared."""
    null = F.lit(None)
    source = F.concat(F.lit("source "), F.col("source").cast("string"))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), null.cast("bigint").alias("page_id"), source.alias("host"), F.when(source.isNotNull(), F.lit("sources")).alias("domain"), null.cast("string").alias("suffix"), null.cast("string").alias("declared"), F.lit(False).alias("markup"), F.col("text").alias("text"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page and document."""
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages"))
    return identified(page_rows(pages).unionByName(document_rows(docs)), fit_text(docs))
