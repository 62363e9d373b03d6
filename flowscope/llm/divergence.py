"""How the sources of a language differ in their words, and by which.

A task counts the terms of its texts by language and source, which leaves one record for a term's stretch of documents there;
no term can have more than one record a stretch, however common it is. Records are dealt by ranges of (lang, term, source)
and sorted by (lang, term, source, first document) within a task. One pass over the sorted records measures runs: documents
and occurrences of a term in a source. A term that lies between two others of the same task is complete; the two at a task's
ends may go on in the next, and only those are summed by a shuffle.

Shares are smoothed, so terms that neither of two sources uses count too. For those a source's constant share stands: what
a pair's sum owes to terms in one of both sources follows from how many terms it uses once, twice, ...; only terms of both
sources are compared one by one, in a second pass over runs, which emits partial sums of pairs and partial leaders of terms.
All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowscope.llm.common import bounded, partitions, white_cut, written

MIN_DOCS, LEADERS, SEED = 3, 200, 12
#: Shares are counted in steps of 1000 to this power.
SCALE_STEPS = 3
#: Records, pairs and partial results that a task works on at a time.
RECORDS, PAIRS, PARTIAL = 200_000, 1_000_000, 2_000_000
#: Bytes as terms have them: A-Z lower-cased, other ASCII than letters as spaces.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
_RUNS = pa.schema([("key", pa.binary()), ("docs", pa.int64()), ("n", pa.int64())])
#: Terms that a task holds before it emits their records; documents, at about, that ranges are drawn from (they only balance
#: tasks), and bytes of a key by which it is dealt.
HELD, SAMPLE, PREFIX = 400_000, 2000, 64


def terms_of(text: bytes | None):
    """Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of a text in UTF-8, with A-Z lower-cased, in lists of bounded size."""
    for part in white_cut((text or b"").translate(_FOLD)):
        yield part.split()


def escaped(lang: bytes) -> bytes:
    """Without zero bytes, which separate the parts of a key; in the same order."""
    return lang.replace(b"\1", b"\1\2").replace(b"\0", b"\1\1")


def unescaped(lang: bytes) -> bytes:
    return lang.replace(b"\1\1", b"\0").replace(b"\1\2", b"\1")


def records(docs: DataFrame, bounds: list[bytes] = (), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(part, key, row, docs, n): a term's documents and occurrences in a stretch of a source's documents; row is the first of them.

    The key is language, term and source with zero bytes between. A document is a row of ``docs``. Null texts, languages and
    sources count as empty. Part is the number of ``bounds`` up to the key.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).cast("binary")
    cols = docs.select(
        blank(lang).alias("lang"), blank(source).alias("source"), F.monotonically_increasing_id().alias("row"), F.col(text).cast("binary").alias("text")
    )
    edges = np.array([b[:PREFIX] for b in bounds], f"S{PREFIX}")

    def run(batches):
        held: dict[tuple[bytes, bytes], tuple[int, Counter, Counter]] = {}

        def out():
            for (lang, source), (row, docs, n) in held.items():
                head, tail = escaped(lang) + b"\0", b"\0" + source
                keys = [head + t + tail for t in n]
                part = np.searchsorted(edges, np.array([k[:PREFIX] for k in keys], f"S{PREFIX}"), "right")
                counts = (np.fromiter(c, np.int64, len(keys)) for c in (map(docs.__getitem__, n), n.values()))
                columns = [pa.array(part, pa.int32()), pa.array(keys, pa.binary()), pa.array(np.full(len(keys), row)), *map(pa.array, counts)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "key", "row", "docs", "n"])
            held.clear()

        size = 0
        for batch in bounded(batches, 3):
            for lang, source, row, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.get((lang, source))
                if own is None:
                    own = held[lang, source] = (row, Counter(), Counter())
                before, once = len(own[2]), set()
                for words in terms_of(body):
                    own[2].update(words)
                    once.update(words)
                own[1].update(once)
                size += len(own[2]) - before
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    return cols.mapInArrow(run, "part int, key binary, row long, docs long, n long")


def drawn_bounds(docs: DataFrame, parts: int) -> list[bytes]:
    """Keys that cut the records of about SAMPLE documents in ``parts`` ranges of like size; how rows are dealt changes no result."""
    some = records(docs.sample(min(1.0, SAMPLE / max(docs.count(), 1)), SEED)).repartitionByRange(parts, "key")
    firsts = some.groupBy(F.spark_partition_id().alias("at")).agg(F.min(F.substring("key", 1, PREFIX)).alias("key")).collect()
    return sorted(bytes(r.key) for r in firsts)[1:]


def starts_of(*columns) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
    for c in columns if n > 1 else ():
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def gathered(batches, most: int):
    """Record batches in tables of about ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str):
    """A column of a table as one array."""
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def sums(values, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values.to_numpy(zero_copy_only=False), starts) if len(starts) else np.empty(0, np.int64)


def run_lengths(batches):
    """Sorted records -> (lang, term, source, docs, n, total, first, open): a row for each run of a term's source.

    Terms in fewer than MIN_DOCS documents are left out unless they are open: the first and the last of the task. ``total``
    is the number of a term's occurrences, and ``first`` marks one row of each term that isn't open.
    """
    carry, begun = _RUNS.empty_table(), False
    for part in chain(gathered(batches, RECORDS), [None]):
        table = carry if part is None else pa.concat_tables([carry, part.select(_RUNS.names)]).combine_chunks()
        key = column(table, "key")
        starts = starts_of(key)
        docs, n = sums(column(table, "docs"), starts), sums(column(table, "n"), starts)
        key = key.take(pa.array(starts))
        names = pc.split_pattern(key, b"\0", max_splits=2).flatten()
        lang, term, source = (names.take(pa.array(np.arange(i, len(names), 3))) for i in range(3))
        terms = starts_of(lang, term)
        if part is not None:  # the last term may go on
            cut = int(terms[-1])
            carry = pa.Table.from_arrays([key[cut:], pa.array(docs[cut:]), pa.array(n[cut:])], schema=_RUNS)
            lang, term, source, docs, n, terms = lang[:cut], term[:cut], source[:cut], docs[:cut], n[:cut], terms[:-1]
        if not len(terms):
            continue
        open_ = np.zeros(len(terms), bool)
        open_[0], begun = not begun, True
        if part is None:
            open_[-1] = True
        sizes = np.diff(np.append(terms, len(term)))
        rows = np.repeat(open_ | (np.add.reduceat(docs, terms) >= MIN_DOCS), sizes)
        is_first = np.zeros(len(term), bool)
        is_first[terms] = True
        kept, total = pa.array(rows), np.repeat(np.add.reduceat(n, terms), sizes)
        langs = lang.filter(kept).dictionary_encode()
        plain = pa.array([unescaped(x).decode() for x in langs.dictionary.to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays(
            [
                plain.take(langs.indices), term.filter(kept).cast(pa.string()), source.filter(kept).cast(pa.string()),
                pa.array(docs[rows]), pa.array(n[rows]), pa.array(total[rows]), pa.array(is_first[rows]), pa.array(np.repeat(open_, sizes)[rows]),
            ],
            ["lang", "term", "source", "docs", "n", "total", "first", "open"],
        )


def sorted_records(docs: DataFrame) -> DataFrame:
    """The records in ranges of the key, in order within each."""
    parts = partitions(docs.sparkSession)
    bounds = drawn_bounds(docs, parts)
    return records(docs, bounds).repartitionById(parts, "part").sortWithinPartitions("key", "row").select("key", "docs", "n")


def kept_terms(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, total, first) of each kept term in each source that has it."""
    kind = "lang string, term string, source string, docs long, n long, total long, first boolean, open boolean"
    runs = written(sorted_records(docs).mapInArrow(run_lengths, kind), "runs")
    parts = runs.filter("open").groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    whole = parts.groupBy("lang", "term").agg(F.sum("docs").alias("all_docs"), F.sum("n").alias("total"), F.min("source").alias("least"))
    joined = parts.join(whole.filter(F.col("all_docs") >= MIN_DOCS), ["lang", "term"]).withColumn("first", F.col("source") == F.col("least"))
    cols = ["lang", "term", "source", "n", "total", "first"]
    return runs.filter("not open").select(*cols).unionByName(joined.select(*cols))


def share(count: str, total: str, terms: str):
    """1 + floor(10^9 (count + 1) / (total + terms)) by long division, exact up to 9 * 10^15 occurrences."""
    below, rest, digits = f"nullif({total} + {terms}, 0)", f"({count} + 1)", []
    for _ in range(SCALE_STEPS):
        digits.append(f"({rest} * 1000) div {below}")
        rest = f"(({rest} * 1000) % {below})"
    return F.expr(f"1 + 1000000 * ({digits[0]}) + 1000 * ({digits[1]}) + ({digits[2]})")


def excess(p: str, q: str) -> str:
    """floor((p - q)^2 / q) as SQL."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def group_table(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(group, lang, source, own_n, lang_n, terms, zero): each occurring lang and source; ``zero``: its share of a term it lacks."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    there = docs.select(blank("lang"), blank("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    whole = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("first").alias("terms"))
    out = there.join(own, ["lang", "source"], "left").join(whole, "lang", "left").fillna(0, ["own_n", "lang_n", "terms"])
    return written(out.select(F.monotonically_increasing_id().alias("group"), "*", share("0L", "own_n", "terms").alias("zero")), "groups")


def summed(code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their values."""
    codes, at = np.unique(code, return_inverse=True)
    out = np.zeros(len(codes), np.int64)
    np.add.at(out, at, value)
    return codes, out


def excess_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(group, p, zero, starts):
    """Of rows grouped by term: (a, b, v) with what both sources' terms change, as blocks of partial sums."""
    sizes = np.diff(np.append(starts, len(group)))
    width, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    names, local = np.unique(group, return_inverse=True)
    ends = np.cumsum(width)
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        w = width[at:to]
        left = np.repeat(np.arange(at, to), w)
        right = np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[at:to], w)
        own = left != right
        left, right = left[own], right[own]
        v = excess_of(p[left], p[right]) - excess_of(p[left], zero[right]) - excess_of(zero[left], p[right]) + excess_of(zero[left], zero[right])
        code = local[left] * len(names) + local[right]
        if len(names) ** 2 <= PARTIAL:
            table = np.zeros(len(names) ** 2, np.int64)
            np.add.at(table, code, v)
            code = np.flatnonzero(table)
            v = table[code]
        else:
            code, v = summed(code, v)
        yield names[code // len(names)], names[code % len(names)], v
        at = to


def merged_pairs(parts):
    """Partial sums with each pair once."""
    a, b, v = (np.concatenate(x) for x in zip(*parts, strict=True))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    code, v = summed(at[: len(a)] * len(names) + at[len(a) :], v)
    return names[code // len(names)], names[code % len(names)], v


def leaders(group, value, term):
    """The LEADERS rows of each group with the largest values; of equal ones those that come first."""
    order = np.lexsort((np.arange(len(group)), -value, group))
    ranked = group[order]
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, int)
    place = np.arange(len(ranked)) - np.repeat(begin, np.diff(np.append(begin, len(ranked))))
    left = np.sort(order[place < LEADERS])  # as they came: in order of the term
    return group[left], value[left], term.take(pa.array(left))


def compared(batches):
    """(term, lang, group, p, zero, q) sorted by term and lang -> partial sums (a, b, v) of pairs, partial leaders (a, term, v)."""
    pairs, tops, n_pairs, n_tops = [], [], 0, 0
    rest = None

    def out_pairs(a, b, v):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.string()), pa.array(v)], ["a", "b", "term", "v"])

    def out_tops(g, v, term):
        return pa.RecordBatch.from_arrays([pa.array(g), pa.nulls(len(g), pa.int64()), term, pa.array(v)], ["a", "b", "term", "v"])

    def best():
        return leaders(np.concatenate([x[0] for x in tops]), np.concatenate([x[1] for x in tops]), pa.concat_arrays([x[2] for x in tops]))

    for part in chain(gathered(batches, RECORDS), [None]):
        table = rest if part is None else part if rest is None else pa.concat_tables([rest, part]).combine_chunks()
        if table is None or not table.num_rows:
            continue
        term = column(table, "term")
        starts = starts_of(term, column(table, "lang"))
        if part is not None:  # the last term may go on
            cut = int(starts[-1])
            rest, table, term, starts = table.slice(cut), table.slice(0, cut), term[:cut], starts[:-1]
        if not len(starts):
            continue
        group, p, zero, q = (column(table, c).to_numpy(zero_copy_only=False) for c in ("group", "p", "zero", "q"))
        for x in pair_sums(group, p, zero, starts):
            pairs.append(x)
            n_pairs += len(x[0])
            if n_pairs > PARTIAL:
                pairs = [merged_pairs(pairs)]
                n_pairs = len(pairs[0][0])
                if 2 * n_pairs > PARTIAL:
                    yield out_pairs(*pairs[0])
                    pairs, n_pairs = [], 0
        over = np.flatnonzero(p > q)
        tops.append((group[over], excess_of(p[over], q[over]), term.take(pa.array(over))))
        n_tops += len(over)
        if n_tops > PARTIAL:
            tops = [best()]
            n_tops = len(tops[0][0])
            if 2 * n_tops > PARTIAL:
                yield out_tops(*tops[0])
                tops, n_tops = [], 0
    if pairs:
        yield out_pairs(*merged_pairs(pairs))
    if tops:
        yield out_tops(*best())


def shares(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, term, group, p, zero, q) of each kept term in each source that has it; q is the language's share."""
    joined = kept.join(groups, ["lang", "source"])
    return joined.select("lang", "term", "group", share("n", "own_n", "terms").alias("p"), "zero", share("total", "lang_n", "terms").alias("q"))


def pair_values(groups: DataFrame, rows: DataFrame, both: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of a language's sources."""
    tally = rows.groupBy("group", "p").agg(F.count("*").alias("h")).groupBy("group").agg(F.collect_list(F.struct("p", "h")).alias("tally"))
    one = groups.join(tally, "group", "left").select("lang", "group", "source", "zero", "terms", "tally")
    a = one.withColumnsRenamed({"group": "a", "source": "source", "zero": "zero_a", "tally": "tally_a"})
    b = one.drop("terms").withColumnsRenamed({"group": "b", "source": "item", "zero": "zero_b", "tally": "tally_b"})
    neither = excess("zero_a", "zero_b")
    over = f"aggregate(coalesce({{}}, array()), 0L, (x, t) -> x + t.h * ({{}} - {neither}))"
    value = F.expr(
        f"coalesce(terms * {neither} + {over.format('tally_a', excess('t.p', 'zero_b'))} + {over.format('tally_b', excess('zero_a', 't.p'))}, 0L)"
    )
    there = a.join(b, "lang").filter("a <> b").select("lang", "source", "item", "a", "b", value.alias("least"))
    shared = both.groupBy("a", "b").agg(F.sum("v").alias("v"))
    return there.join(shared, ["a", "b"], "left").select("lang", "source", "item", (F.col("least") + F.coalesce("v", F.lit(0))).alias("value"))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair``, the distance to each other source; part ``term``, what stands out.

    ``docs`` needs text, lang and source; nulls count as empty; other columns don't matter. Each row is a document, repeated
    ones too. A source whose texts have no kept term still has its pairs, with value 0 where the language keeps none. Equal
    values are ranked by the item's bytes. An empty table gives no rows.
    """
    kept = kept_terms(docs)
    groups = group_table(docs, kept)
    rows = shares(kept, groups)
    dealt = rows.repartition("term", "lang").sortWithinPartitions("term", "lang")
    partial = written(dealt.mapInArrow(compared, "a long, b long, term string, v long"), "partial-divergence")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, rows, partial.filter("b is not null")).withColumn("rank", F.row_number().over(by_value))
    terms = partial.filter("b is null").select(F.col("a").alias("group"), F.col("term").alias("item"), F.col("v").alias("value"))
    best = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("value"), "item"))
    terms = terms.withColumn("rank", best).filter(F.col("rank") <= LEADERS).join(groups, "group")
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(terms, "term"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), e AS (
  SELECT lang, source, row, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*)::HUGEINT AS total FROM e GROUP BY ALL HAVING count(DISTINCT row) >= 3
), v AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n FROM e JOIN k USING (lang, term) GROUP BY ALL
), z AS (
  SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT z.lang, z.source, k.term, coalesce(c.n, 0) AS count, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (z.n + v.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (v.n + v.v) AS q
  FROM z JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = z.lang AND c.source = z.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE count > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 200
"""
