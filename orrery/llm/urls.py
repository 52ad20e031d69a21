"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Each listed URL sets one bit in each of the eight 64-bit words of one 512-bit block. The filter is a table of blocks,
built by a grouped bit-wise or; it is broadcast while its size, which is known beforehand, is small, and else joined
by block. Only URLs whose eight bits are set go on to the exact hash join with the list, which takes out false hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import materialise, table

# The rules (host and path, verdict).
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
# Names of hosts whose pages make up the list, and query parameters that carry no content.
LISTED_HOSTS = "(^|\\.)(spam-farm|cheap-pills|casino-win|ads-track|free-bets)\\."
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

WORDS = 8
BITS_PER_URL = 16
BLOCK_BYTES = 64
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first `://`; empty where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host, path without an ending slash, and the sorted parameters that carry content; null without a host."""
    query = F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), "^[^?#]*\\?([^#]*)", 1)
    parameters = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    text = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise(""))
    return F.when(host(url) != "", text)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    return rule, verdict


def _bits(url: Column) -> list[Column]:
    """The bit of each word of the block."""
    chosen = F.xxhash64(url, F.lit("bits"))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(chosen, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(WORDS)]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """block and its words w0 to w7, of a table with a column `listed`."""
    set_bits = listed.select(_block(F.col("listed"), blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("listed")))))
    return set_bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def in_list(urls: DataFrame, key: str, listed: DataFrame) -> DataFrame:
    """`urls` with `is_listed`: whether the canonical URL in column `key` is in `listed`, a table with that column.

    Null keys are not listed. Rows keep their number, also repeated ones; an empty list lists nothing.
    """
    listed = materialise(listed.where("listed is not null").distinct())
    count = listed.count()
    blocks = max(1, -(-count * BITS_PER_URL // (8 * BLOCK_BYTES)))
    filter_table = bloom_blocks(listed, blocks)
    if blocks * BLOCK_BYTES <= BROADCAST_BYTES:
        filter_table = F.broadcast(filter_table)
    keyed = urls.withColumn("__block", _block(F.col(key), blocks))
    probed = keyed.join(filter_table, keyed["__block"] == filter_table["block"], "left")
    hit = reduce(lambda a, b: a & b, (F.col(f"w{i}").bitwiseAND(b) != 0 for i, b in enumerate(_bits(F.col(key)))))
    probed = probed.withColumn("__maybe", F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull())
    sure = probed.where(~F.col("__maybe")).select(*urls.columns, F.lit(False).alias("is_listed"))
    possible = probed.where("__maybe").select(*urls.columns)
    checked = possible.join(listed, possible[key] == listed["listed"], "left").select(*urls.columns, F.col("listed").isNotNull().alias("is_listed"))
    return sure.unionByName(checked)


def judge_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row (page_id, url): the rule's, else block if listed, else allow.

    A null url, or one without `://`, has an empty host and path and is allowed. Other columns are ignored.
    """
    url = F.col("url")
    parts = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("ruled"))
    # What a rule decides needs no look at the list.
    by_rule = ruled.where("rule is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"))
    rest = in_list(ruled.where("rule is null").drop("ruled"), "canonical", listed)
    by_list = rest.select("page_id", "host", "path", "rule", F.when(F.col("is_listed"), "block").otherwise("allow").alias("verdict"))
    return by_rule.unionByName(by_list)


def listed_pages(pages: DataFrame) -> DataFrame:
    """The default list: the canonical URLs of the pages of hosts with listed names."""
    return pages.select(host(F.col("url")).alias("host"), canonical(F.col("url")).alias("listed")).where(F.col("host").rlike(LISTED_HOSTS)).select("listed")


def list_of_urls(urls: DataFrame) -> DataFrame:
    """The list of judge_urls() from any table with a column `url`, such as a published block list; repeats are one."""
    return urls.select(canonical(F.col("url")).alias("listed")).where("listed is not null").distinct()


def op8_urls(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every row of `pages`."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, listed_pages(pages))


def _rule_sql(column: int) -> str:
    cases = []
    for text, decision in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        name, _, start = text.partition("/")
        cases.append(f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{start}') THEN '{(text, decision)[column]}'")
    return f"CASE {' '.join(cases)} END"


SQL = f"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))) AS parameters FROM rests
), canon AS (
  SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || CASE WHEN len(parameters) > 0 THEN '?' || array_to_string(parameters, '&') ELSE '' END END AS canonical FROM parts
), ruled AS (
  SELECT page_id, host, path, canonical, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS ruled FROM canon
)
SELECT page_id, host, path, rule,
  coalesce(ruled, CASE WHEN canonical IN (SELECT canonical FROM canon WHERE canonical IS NOT NULL AND regexp_matches(host, '{LISTED_HOSTS}')) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""
