"""Source divergence audit: in-mapper stripes from terms to document frequency and source counts.

Each task folds whole documents into stripes: per language, a term's number of documents and its occurrences by source.
When the stripes of a task reach ``spill`` cells they are written out and the fold begins anew. Stripes are dealt by
(language, term), sorted, and merged as a stream, one stripe in memory at a time; a term brings one row per spill, not
one per occurrence. Terms in fewer than ``min_docs`` documents of their language go here.

The merged stripes emit the divergences directly: with p = 1 + floor(10⁹ · (count + 5) / (N + 5 · V)) per group and term,
a bucket of stripes adds |p - q| for every pair of a language's sources and keeps each source's highest terms. A bucket
holds about ``bucket_terms`` stripes and ``block`` sources, so no task grows with a language or its number of sources.
All arithmetic is in integers.

Defined results: null text, lang and source count as ''; a group without terms, and a language of which no term is
kept, still have their pairs (p then is the smoothing alone, or 0 over no terms); repeated rows count as documents of
their own; an empty table gives no row; other columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from trialweave.llm import query
from trialweave.llm.common import shuffle_width, table
from trialweave.runtime import pin

TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
SCALE_STEPS = 3  # times 1000 each
STRIPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
STRIPE_DDL = "lang string, term string, df bigint, sources array<string>, counts array<bigint>"


def pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in parts that no term crosses."""
    start = 0
    while start < len(text):
        cut = GAP.search(text, start + size)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


class Stripes:
    """A task's stripes; ``cells`` is how many numbers they hold."""

    def __init__(self) -> None:
        self.df: dict[str, Counter] = {}
        self.counts: dict[tuple[str, str], Counter] = {}

    def fold(self, lang: str, source: str, text: bytes) -> None:
        seen: set[bytes] = set()
        own = self.counts.setdefault((lang, source), Counter())
        for part in pieces(text.lower()):  # bytes: A-Z only
            terms = TERM.findall(part)
            own.update(terms)
            seen.update(terms)
        self.df.setdefault(lang, Counter()).update(seen)

    @property
    def cells(self) -> int:
        return sum(map(len, self.df.values())) + sum(map(len, self.counts.values()))

    def rows(self, most: int = 50_000) -> Iterator[pa.RecordBatch]:
        for lang, frequency in self.df.items():
            number = {t: i for i, t in enumerate(frequency)}
            own = [(source, c) for (at, source), c in self.counts.items() if at == lang]
            term = np.concatenate([np.fromiter(map(number.__getitem__, c), np.int64, len(c)) for _, c in own])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for _, c in own])
            source = np.repeat(np.arange(len(own)), [len(c) for _, c in own])
            order = np.argsort(term, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(number)))])
            names = pa.array([s for s, _ in own], pa.string())
            terms, df = list(frequency), np.fromiter(frequency.values(), np.int64, len(frequency))
            for start in range(0, len(terms), most):
                part = terms[start : start + most]
                edges = ends[start : start + len(part) + 1]
                cells, offsets = order[edges[0] : edges[-1]], pa.array((edges - edges[0]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, x) for x in (names.take(pa.array(source[cells])), pa.array(count[cells]))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string()), pa.array(df[start : start + len(part)]), *lists], schema=STRIPE)


def fold_documents(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", spill: int = 2_000_000) -> DataFrame:
    """(lang, term, df, sources, counts): every task's stripes, spilled at about ``spill`` cells."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, read = Stripes(), 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3))):
                raw = text.as_py()
                held.fold(lang.as_py(), source.as_py(), raw)
                read += len(raw)
                if read > spill:  # a cell takes a byte at least, so counting waits for that many
                    read = 0
                    if held.cells > spill:
                        yield from held.rows()
                        held = Stripes()
        yield from held.rows()

    return rows.mapInArrow(run, STRIPE_DDL)


def merge_stripes(stripes: DataFrame, min_docs: int) -> DataFrame:
    """One stripe per (lang, term) in ``min_docs`` documents or more, merged from sorted rows as they stream by."""
    dealt = stripes.repartition(shuffle_width(stripes), "lang", "term").sortWithinPartitions("lang", "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, df, total = None, 0, Counter()  # the stripe that may go on in the next batch
        for batch in batches:
            out = []
            if not batch.num_rows:
                continue
            lang, term, n = (batch.column(i) for i in range(3))
            same = pc.and_(pc.equal(lang[1:], lang[:-1]), pc.equal(term[1:], term[:-1])).to_numpy(zero_copy_only=False).astype(bool)
            edges = np.append(np.concatenate([[0], np.flatnonzero(~same) + 1]), batch.num_rows)
            sums = np.add.reduceat(n.to_numpy(), edges[:-1])
            for i in np.flatnonzero((sums >= min_docs) | np.isin(np.arange(len(sums)), (0, len(sums) - 1))):
                # rare stripes inside the batch are never opened; the first and the last may go on from or into another batch
                own = (lang[int(edges[i])].as_py(), term[int(edges[i])].as_py())
                if own != key:
                    if key is not None and df >= min_docs:
                        out.append((key, df, total))
                    key, df, total = own, 0, Counter()
                df += int(sums[i])
                for k in range(edges[i], edges[i + 1]):
                    total.update(dict(zip(batch.column(3)[k].as_py(), batch.column(4)[k].as_py())))
            if out:
                yield _stripe_batch(out)
        if key is not None and df >= min_docs:
            yield _stripe_batch([(key, df, total)])

    return dealt.mapInArrow(run, STRIPE_DDL)


def _stripe_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"lang": k[0], "term": k[1], "df": n, "sources": list(c), "counts": list(c.values())} for k, n, c in rows], schema=STRIPE)


def smoothed(count: np.ndarray, total: np.ndarray, terms: int, add: int) -> np.ndarray:
    """1 + floor(10⁹ · (count + add) / (total + add · terms)), by long division so that nothing overflows."""
    below = total + add * terms
    rest, quotient = count + add, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        quotient = quotient * 1000 + rest // below
        rest = rest % below
    return quotient + 1


def _tables(docs: DataFrame, lang_col: str, source_col: str, merged: DataFrame) -> DataFrame:
    """Per lang: its sources with their totals over kept terms, in order, its own total, and the number of kept terms."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source")))).distinct()
    each = merged.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    sized = groups.join(each, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("s"))
    terms = merged.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    return sized.join(terms, "lang", "left").select("lang", F.col("s.source").alias("names"), F.col("s.n").alias("totals"), F.coalesce("v", F.lit(0)).alias("v"))


def divergences(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 30, add: int = 5, top: int = 50, bucket_terms: int = 20_000, block: int = 256) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source's distance, and the ``top`` terms of each source."""
    merged = pin(merge_stripes(fold_documents(docs, lang_col, source_col, text_col), min_docs))
    langs = pin(_tables(docs, lang_col, source_col, merged).withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("v") / bucket_terms)).cast("int")))
    blocks = F.sequence(F.lit(0), ((F.size("names") - 1) / block).cast("int"))
    tables = langs.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1))).withColumn("part", F.explode(blocks)).drop("buckets")
    places = langs.select("lang", "buckets", blocks.alias("_blocks"))
    stripes = merged.join(places, "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int")).withColumn("part", F.explode("_blocks"))
    stripes = stripes.select("lang", "bucket", "part", "term", "sources", "counts")
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("kind", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def emit(left: pa.Table, right: pa.Table) -> pa.Table:
        lang, names, totals, v, _, part = (c[0].as_py() for c in right.columns)
        totals = np.array(totals, np.int64)
        place = {s: i for i, s in enumerate(names)}
        low, high = part * block, min((part + 1) * block, len(names))
        terms = left.column("term").to_pylist()
        sources = left.column("sources").to_pylist()
        count_lists = left.column("counts").to_pylist()
        sums = np.zeros((high - low, len(names)), np.int64)
        found: list[list[tuple[int, str]]] = [[] for _ in range(high - low)]
        step = max(1, 2_000_000 // len(names))
        for start in range(0, len(terms), step):
            n = min(step, len(terms) - start)
            count = np.zeros((n, len(names)), np.int64)
            for i in range(n):
                count[i, [place[s] for s in sources[start + i]]] = count_lists[start + i]
            p = smoothed(count, totals[None, :], v, add)
            q = smoothed(count.sum(axis=1), np.int64(totals.sum()), v, add)
            for j in range(low, high):
                sums[j - low] += np.abs(p - p[:, j, None]).sum(axis=0)
                more = np.flatnonzero((count[:, j] > 0) & (p[:, j] > q))
                f = (p[:, j] - q)[more]
                best = found[j - low] + [(-int(f[k]), terms[start + int(more[k])]) for k in np.flatnonzero(f >= _least(f, top))]
                found[j - low] = sorted(best, key=lambda x: (x[0], x[1].encode()))[:top]
        out = [(names[j], "pair", names[k], int(sums[j - low, k])) for j in range(low, high) for k in range(len(names)) if k != j]
        out += [(names[j], "term", t, -f) for j in range(low, high) for f, t in found[j - low]]
        columns = list(zip(*out)) if out else [(), (), (), ()]
        return pa.Table.from_arrays([pa.array([lang] * len(out), pa.string()), *(pa.array(list(c), t) for c, t in zip(columns, schema.types[1:]))], schema=schema)

    keys = ["lang", "bucket", "part"]
    right = tables.select("lang", "names", "totals", "v", "bucket", "part")
    parts = stripes.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(emit, "lang string, source string, kind string, item string, value bigint")
    added = parts.groupBy("lang", "source", F.col("kind").alias("part"), "item").agg(F.sum("value").alias("value"))
    ranked = added.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))).cast("int"))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def _least(values: np.ndarray, top: int) -> int:
    """The ``top``-th highest value, or the lowest of fewer."""
    if len(values) <= top:
        return int(values.min()) if len(values) else 0
    return int(np.partition(values, len(values) - top)[len(values) - top])


SQL = r"""
WITH docs AS MATERIALIZED (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents),
occ AS MATERIALIZED (
    SELECT lang, source, doc, term, count(*) AS n FROM (SELECT lang, source, doc, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(*) >= 30),
cnt AS (SELECT lang, source, term, sum(n)::BIGINT AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM docs),
vs AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
tot AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total FROM grp g LEFT JOIN cnt c USING (lang, source) GROUP BY ALL),
ltot AS (SELECT lang, sum(total) AS total FROM tot GROUP BY lang),
p AS MATERIALIZED (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * vs.v) AS p
    FROM tot t JOIN kept k USING (lang) JOIN vs USING (lang) LEFT JOIN cnt c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
q AS (
    SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (sum(c.n) + 5)) // (any_value(l.total) + 5 * any_value(vs.v)) AS q
    FROM kept k JOIN cnt c USING (lang, term) JOIN ltot l USING (lang) JOIN vs USING (lang) GROUP BY k.lang, k.term),
pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) d
      ON d.lang = a.lang AND d.s = a.source AND d.o = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
    FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op11_source_divergence", SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))
