"""URL filters: a Bloom filter cascade over the hosts or addresses of the corpus, under a short list of host and path rules.

The key universe is every distinct host (or host and path) of the corpus, so membership can be made exact: level 1 encodes the listed
keys, level 2 the unlisted keys that level 1 lets through, level 3 the listed keys that level 2 lets through, and so
on until a level lets nothing through. A key's answer is the parity of the first level that refuses it.
Keys are dealt to shards by hash so that one shard's bit arrays stay small (``shard_keys`` keys at ``bits_per_key``);
a page meets its shard's row of bit arrays, never a list of keys. One shard's row is broadcast when the planner sees a
small table and is otherwise joined by shard number, where adaptive execution splits a shard with a hot host.

Defined results: null urls and urls without ``://`` have an empty host and path and match no rule; listed keys that
are not in the universe change nothing; a key repeated in either table counts once; null keys count as the empty key;
empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trialweave.llm import query
from trialweave.llm.common import UPPER, ascii_lower, free_name, table
from trialweave.runtime import pin

HASHES = 4


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting (verdict, host, path) rule, else null. The list is short and fixed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int")


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.shiftrightunsigned(F.xxhash64(F.lit(level), F.lit(j), key), 64 - int(log2(bits))) for j in range(HASHES)]


def _passes(key: Column, words: Column, level: int, bits: int) -> Column:
    """Whether all of a key's bits are set in one level's array of 64-bit words."""
    out = F.lit(True)
    for at in _positions(key, level, bits):
        word = F.get(words, F.shiftright(at, 6).cast("int"))
        out = out & (F.getbit(word, (at % 64).cast("int")) == 1)
    return out


class Cascade:
    """Levels of sharded bit arrays: ``frame`` has (shard, words_1, …, words_n), one row per shard."""

    def __init__(self, frame: DataFrame | None, bits: list[int], shards: int):
        self.frame, self.bits, self.shards = frame, bits, shards

    def contains(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with a boolean column: whether the key is listed. Exact for every key of the universe."""
        if not self.bits:
            return df.withColumn(name, F.lit(False))
        shard, words = free_name(df, "_shard"), [free_name(df, f"_words_{i + 1}") for i in range(len(self.bits))]
        joined = df.withColumn(shard, _shard(key, self.shards)).join(self.frame.toDF(shard, *words), shard, "left")
        answer = F.lit(len(self.bits) % 2 == 1)  # passing every level: a member of the set the last level encodes
        for level in reversed(range(1, len(self.bits) + 1)):
            answer = F.when(~_passes(key, F.col(words[level - 1]), level, self.bits[level - 1]), F.lit(level % 2 == 0)).otherwise(answer)
        return joined.withColumn(name, F.when(F.col(words[0]).isNull(), False).otherwise(answer)).drop(shard, *words)  # a shard without a row lists nothing


def _level(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One level's bit arrays, (shard, words): partial bit-or before the shuffle, then a dense array per shard."""
    words = (
        keys.select("shard", F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("at"))
        .groupBy("shard", F.shiftright("at", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS INT))")).alias("set"))
    )
    packed = words.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("word", "set"))).alias("sparse"))
    return packed.select("shard", F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda i: F.coalesce(F.try_element_at("sparse", i), F.lit(0).cast("bigint"))).alias(f"words_{level}"))


def build_cascade(universe: DataFrame, listed: DataFrame, shard_keys: int = 1 << 18, bits_per_key: int = 8, max_levels: int = 64) -> Cascade:
    """Cascade for ``listed`` within ``universe`` (each with a string column ``key``). A level that fails to shrink raises."""
    flags = universe.select(F.coalesce("key", F.lit("")).alias("key"), F.lit(0).alias("yes"))
    flags = flags.unionByName(listed.select(F.coalesce("key", F.lit("")).alias("key"), F.lit(1).alias("yes")))
    marked = flags.groupBy("key").agg(F.max("yes").alias("yes"), F.min("yes").alias("known")).where("known = 0")
    marked = pin(marked.select("key", "yes"))
    n = marked.where("yes = 1").count()
    if n == 0:
        return Cascade(None, [], 1)
    shards = max(1, ceil(n / shard_keys))
    marked = marked.withColumn("shard", _shard(F.col("key"), shards))
    encode, against = marked.where("yes = 1").drop("yes"), marked.where("yes = 0").drop("yes")
    frame, bits = None, []
    for level in range(1, max_levels + 1):
        width = 1 << max(6, ceil(log2(bits_per_key * max(1, n / shards))))
        arrays = pin(_level(encode, level, width))
        bits.append(width)
        frame = arrays if frame is None else frame.join(arrays, "shard", "left")
        through = pin(against.join(arrays, "shard").where(_passes(F.col("key"), F.col(f"words_{level}"), level, width)).select("key", "shard"))
        n = through.count()
        if n == 0:
            break
        encode, against = through, encode
    else:
        raise RuntimeError(f"the cascade does not end within {max_levels} levels")
    # a shard without keys at some level refuses everything there
    empty = [F.coalesce(F.col(f"words_{i + 1}"), F.array_repeat(F.lit(0).cast("bigint"), b // 64)).alias(f"words_{i + 1}") for i, b in enumerate(bits)]
    return Cascade(pin(frame.select("shard", *empty)), bits, shards)


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = (), id_col: str = "page_id", url_col: str = "url", addresses: bool = False) -> DataFrame:
    """id, host, path, rule, verdict, listed: the longest fitting rule decides, else block for listed keys and allow for others.

    ``listed`` has a string column ``key`` of host names, or of ``addresses``: host and path together.
    """
    urls = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    key = F.concat("host", "path") if addresses else F.col("host")
    cascade = build_cascade(urls.select(key.alias("key")), listed)
    out = cascade.contains(urls, key, "listed").withColumn("_m", rule_match(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("_m.verdict", F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select(id_col, "host", "path", F.col("_m.rule").alias("rule"), verdict.alias("verdict"), "listed")


#: The query's rules (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def tracked_addresses(pages: DataFrame) -> DataFrame:
    """The query's block list: every address (host and path) that a page has with a tracking parameter."""
    url = F.col("url")
    tracked = url.contains("utm_source=") | url.contains("ref=")
    return pages.where(tracked).select(F.concat(url_host(url), url_path(url)).alias("key")).distinct()


@query(
    "op2_url_filters",
    rf"""
    WITH u AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host,
                      coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    listed AS (SELECT DISTINCT host || path AS address FROM u WHERE url LIKE '%utm_source=%' OR url LIKE '%ref=%'),
    r AS (SELECT page_id, host, path, host || path IN (SELECT address FROM listed) AS listed,
                 CASE WHEN '.' || host LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
                      WHEN '.' || host LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
                      WHEN '.' || host LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
                      WHEN '.' || host LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
                      WHEN '.' || host LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule FROM u)
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
           listed
    FROM r
    """,
)
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, tracked_addresses(pages), RULES, addresses=True)
