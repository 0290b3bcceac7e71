"""URL filters: a blocked Bloom filter of listed canonical URLs, and an exact hash join for what it lets through.

A list holds entries (host, path, exact, verdict). A prefix entry (``exact`` false) fits its host and all subdomains where the
path begins with the entry's; an exact entry fits one canonical URL. The longest prefix entry that fits decides, then an
exact entry, then the default.

Both kinds are looked up by equality. An URL has few keys that a list could hold: its canonical form, and each suffix of
its host with each beginning of its path, of the label counts and path lengths that the list has. The filter holds
256 bits a block, of which an entry sets eight; it is a table of blocks, joined by block number. Keys that pass it meet the
list in an exact join. The filter is broadcast while it has at most ``MAX_BLOCKS`` blocks, which the list's count tells
beforehand; a longer list is joined without it, with the same result. Everything runs on distinct URLs, so an URL
that fills a third of the table is looked up once.

Nulls: a null url, or one without ``://``, has an empty host and path, fits nothing and gets the default. An entry with a
null host or path is none. Repeated pages are rows of their own; repeated entries count once, and of contradicting ones
``block`` holds. Ties: of two prefix entries of one length the longer host wins. Texts are read whole, however long. Extra columns of the
input are left out. An empty table gives an empty result, an empty list the default throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialise

#: Bits that the filter spends on an entry (about one key in 2000 passes wrongly), and the bits of a block.
BITS_PER_ENTRY, BLOCK_BITS, WORDS = 16, 256, 4
#: Blocks of a filter that is broadcast: 40 bytes each.
MAX_BLOCKS = 1 << 20
#: Query parameters that tell where a visitor came from, not what they see.
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slashes, and the sorted query without tracking
    parameters; null without a host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """The eight bits of a key, two in each word of its block."""
    bits = F.xxhash64(F.lit("bits"), key)
    one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int"))
    return [one(2 * i).bitwiseOR(one(2 * i + 1)) for i in range(WORDS)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 ... w3) of the blocks that any of ``keys`` (key) sets bits in."""
    masks = keys.select(_block(F.col("key"), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return masks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def possible_hits(rows: DataFrame, keys: DataFrame, entries: int) -> DataFrame:
    """The ``rows`` whose ``key`` the filter of ``keys`` holds, perhaps wrongly; all of them if the filter would be too
    large to broadcast."""
    blocks = max(1, -(-entries * BITS_PER_ENTRY // BLOCK_BITS))
    if blocks > MAX_BLOCKS:
        return rows
    probed = rows.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(bloom_filter(keys, blocks)), "block")
    for i, m in enumerate(_masks(F.col("key"))):
        probed = probed.where(F.col(f"w{i}").bitwiseAND(m) == m)
    return probed.select(rows.columns)


def _prefix_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("p "), host, F.lit(" "), path)


def _exact_key(canonical: Column) -> Column:
    return F.concat(F.lit("u "), canonical)


def prefix_rules(rules: DataFrame) -> DataFrame:
    """List entries of ``rules`` (host, path, verdict)."""
    host, path = lower_ascii(F.col("host")), F.col("path")
    return rules.where("host is not null and path is not null").select(
        _prefix_key(host, path).alias("key"), F.concat(host, path).alias("rule"), "verdict", F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("long")
    )


def exact_urls(urls: DataFrame, verdict: str = "block") -> DataFrame:
    """List entries of the canonical forms of ``urls`` (url)."""
    listed = urls.select(canonical_url(F.col("url")).alias("c")).where("c is not null").distinct()
    none = F.lit(None)
    return listed.select(_exact_key(F.col("c")).alias("key"), none.cast("string").alias("rule"), F.lit(verdict).alias("verdict"), none.cast("int").alias("labels"), none.cast("int").alias("long"))


def judge_urls(pages: DataFrame, entries: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of ``pages`` (page_id, url) under list ``entries`` (of ``prefix_rules`` and
    ``exact_urls``, united)."""
    # contradicting entries: 'block' is the greater word
    entries = materialise(entries.groupBy("key").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict"), F.max("labels").alias("labels"), F.max("long").alias("long")), "url-list")
    # one row; lengths differ at most as often as an entry has characters
    count, labels, lengths = entries.agg(F.count("*"), F.coalesce(F.max("labels"), F.lit(0)), F.sort_array(F.collect_set("long"))).first()
    urls = pages.select("url").where("url is not null").distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical_url(F.col("url")).alias("canonical")).where("canonical is not null")
    parts = F.least(F.size(F.split("host", r"\.")), F.lit(labels))
    suffixes = F.when(parts > 0, F.transform(F.sequence(F.lit(1), parts), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))).otherwise(F.array().cast("array<string>"))
    begins = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.flatten(F.transform(suffixes, lambda h: F.transform(begins, lambda n: _prefix_key(h, F.substring(F.col("path"), F.lit(1), n)))))
    asked = urls.select("url", F.explode(F.concat(prefixes, F.array(_exact_key(F.col("canonical"))))).alias("key"))
    hits = possible_hits(asked, entries.select("key"), count).join(entries.hint("shuffle_hash"), "key")
    strength = F.struct(F.col("rule").isNotNull().alias("prefix"), F.length("rule").alias("n"), "labels")
    best = hits.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), strength).alias("best"))
    judged = pages.select("page_id", "url").join(best, "url", "left")
    return judged.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
