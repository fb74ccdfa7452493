"""URL rules and a blocklist, with DataFrame functions only.

Rules (host, path, verdict) are a short list of settings; the longest that fits decides. Other URLs are judged by a list:
a blocked Bloom filter of the listed canonical URLs (a block of 64 bits for each URLS_PER_BLOCK of them, 4 bits a URL, all in
the block that the URL's hash names) passes possible hits on to an exact hash join with the list, which removes false
positives. The number of blocks follows the list's length, so about one unlisted URL in a hundred is let through. Up to
BROADCAST_BLOCKS blocks of 16 bytes are broadcast; those of a longer list meet the URLs by their numbers.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end.
Null URLs and those without `://` have an empty host and path, fit no rule and are on no list: allow. The canonical URL is
host, without a leading `www.` or `m.`, and path, without a closing `.html` or `/`. Null page_ids and repeated rows are judged like any
other row. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curriq.llm.common import cut, shared_dir, table

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
BITS, URLS_PER_BLOCK = 4, 4
LEAST_BLOCKS, BROADCAST_BLOCKS = 1 << 10, 1 << 20


def url_host(url: str) -> Column:
    after = F.expr(f"substring({url}, char_length(substring_index({url}, '://', 1)) + 4)")
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    return F.when(F.contains(F.col(url), F.lit("://")), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def url_path(url: str) -> Column:
    after = F.expr(f"substring({url}, char_length(substring_index({url}, '://', 1)) + 4)")
    return F.when(F.contains(F.col(url), F.lit("://")), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):  # longer rules are asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def blocks_for(listed_urls: int) -> int:
    """The number of blocks, a power of 2, of a list of so many URLs."""
    return max(LEAST_BLOCKS, 1 << max(0, (listed_urls - 1) // URLS_PER_BLOCK).bit_length())


def _bloom(url: str, blocks: int) -> tuple[Column, Column]:
    """(block, mask) of a URL: one hash names the block, another the bits in it."""
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(1, {url}), {6 * i}) & 63 as int))"))
    return F.pmod(F.xxhash64(F.col(url)), F.lit(blocks)), mask


def filtered(urls: DataFrame, own: DataFrame, listed_urls: int) -> DataFrame:
    """urls with a column `maybe`: does the filter of own (canonical) pass the URL? True for every listed one."""
    blocks = blocks_for(listed_urls)
    block, mask = _bloom("canonical", blocks)
    bloom = own.groupBy(block.alias("block")).agg(F.bit_or(mask).alias("bits"))
    bloom = F.broadcast(bloom) if blocks <= BROADCAST_BLOCKS else bloom
    tried = urls.withColumn("block", block).withColumn("mask", mask).join(bloom, "block", "left")
    return tried.withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))).drop("block", "bits", "mask")


def listed_hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """urls with a column `listed`: is the canonical URL in the table listed(canonical)?"""
    own = cut(listed.select("canonical").where("canonical <> ''").distinct(), shared_dir(urls.sparkSession), "listed")
    tried = filtered(urls, own, own.count())
    hits = tried.where("maybe").join(own.withColumn("found", F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce("found", F.lit(False))).drop("maybe", "found")
    return hits.unionByName(tried.where("NOT maybe").drop("maybe").withColumn("listed", F.lit(False)))


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, canonical, rule and the rule's verdict."""
    urls = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", url_host("url").alias("host"), url_path("url").alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    return urls.select("page_id", "host", "path", canonical(F.col("host"), F.col("path")).alias("canonical"), rule.alias("rule"), said.alias("said"))


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed."""
    urls = parsed(pages, rules)
    return listed_hits(urls, listed).select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def repeated_urls(pages: DataFrame) -> DataFrame:
    """The list of the query: canonical URLs that two or more pages have, under whatever host prefix, ending or query."""
    return parsed(pages).where("canonical <> ''").groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1").select("canonical")


def op9_bloom_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, repeated_urls(pages))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
c AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') AS canonical,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM u),
listed AS (SELECT canonical FROM c WHERE canonical <> '' GROUP BY canonical HAVING count(*) > 1)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict,
  canonical IN (SELECT canonical FROM listed) AS listed
FROM c
"""
