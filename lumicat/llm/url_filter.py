"""URL filters: a blocked Bloom filter of listed keys in front of an exact hash join.

Listed keys are of two kinds: rules, ``host + path prefix``, which fit the host and all its
subdomains, and canonical URLs, which fit one page. A page's candidate keys are its canonical URL
and every suffix of its host at a label joined to every prefix of its path as long as some rule's
path. The filter is split into blocks of eight 64-bit words; a key sets one bit in each word of
one block, so a test reads one row. Keys that pass (possible hits) go to an exact join with the
list, which removes false positives. The blocks are broadcast while their number is under a
bound; beyond it they are joined by block number. The distinct lengths of rule paths and the rules'
own number are configuration; the list of canonical URLs may be of any size.

Defined results: null urls and urls without ``://`` have an empty host and path, meet no rule
and get the default verdict; repeated rows each get their row; an empty list blocks nothing;
columns beside page_id and url are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumicat.llm.common import LOWER, UPPER, materialise

WORDS = 8
BITS_PER_KEY = 24
BROADCAST_BLOCKS = 1 << 16

#: Rules as (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: What the listed canonical URLs are made of, which are all combinations with page numbers below LISTED_PAGES.
PREFIXES = ("", "m.", "blog.")
LISTED_SITES = ("casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x")
DOMAINS = (".example.com", ".example.net", ".example.org")
FOLDERS = ("/en/", "/de/", "/fr/", "/es/")
ENDINGS = ("", ".html")
LISTED_PAGES = 1000

#: Query parameters that a canonical URL leaves out.
TRACKING = r"(?:utm_[^=&]*|ref|fbclid|gclid)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without a final slash, and the query without tracking parameters; no fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^{TRACKING}(=|$)")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), tail)


def rule_list(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [(f"r:{h}{p}", f"{h}{p}", v, len(h) + len(p)) for h, p, v in rules]
    return spark.createDataFrame(rows, "key string, rule string, verdict string, weight int")


def url_list(urls: DataFrame, column: str = "url", verdict: str = "block") -> DataFrame:
    """List entries of distinct canonical URLs; they rank below every rule."""
    return (
        urls.select(F.concat(F.lit("u:"), canonical(F.col(column))).alias("key")).where(F.length("key") > 2).distinct()
        .select("key", F.lit(None).cast("string").alias("rule"), F.lit(verdict).alias("verdict"), F.lit(-1).alias("weight"))
    )


def _bit(h: Column, j: int) -> Column:
    return F.shiftrightunsigned(h, 6 * j).bitwiseAND(F.lit(63)).cast("int")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks)).cast("int")


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the filter, as one row for each block with a key, OR-ed map-side first."""
    hashed = keys.select(_block(F.col("key"), blocks).alias("block"), F.xxhash64("key").alias("h"))
    words = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {6 * j}) & 63 as int))")).alias(f"w{j}") for j in range(WORDS)]
    return hashed.groupBy("block").agg(*words)


def candidate_keys(url: Column, path_lengths: list[int]) -> Column:
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in path_lengths)), lambda p: p.isNotNull())
    rule_keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("r:"), s, p))))
    return F.when(host != "", F.array_append(rule_keys, F.concat(F.lit("u:"), canonical(url))))


def possible_hits(pages: DataFrame, listed: DataFrame, path_lengths: list[int], bits_per_key: int = BITS_PER_KEY, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """(url, key): the candidate keys of distinct urls that pass the filter."""
    n = listed.count()
    blocks = max(1, -(-n * bits_per_key // (64 * WORDS)))
    bloom = bloom_blocks(listed, blocks).withColumnRenamed("block", "b_block")
    urls = pages.select("url").where("url is not null").distinct()
    keys = (
        urls.select("url", F.explode(candidate_keys(F.col("url"), path_lengths)).alias("key"))
        .withColumn("block", _block(F.col("key"), blocks)).withColumn("h", F.xxhash64("key"))
    )
    side = F.broadcast(bloom) if blocks <= broadcast_blocks else bloom
    possible = keys.join(side, keys.block == side.b_block)
    for j in range(WORDS):
        possible = possible.where(F.expr(f"getbit(w{j}, cast(shiftrightunsigned(h, {6 * j}) & 63 as int)) = 1"))
    return possible.select("url", "key")


def filter_urls(pages: DataFrame, listed: DataFrame, path_lengths: list[int], default: str = "allow",
                bits_per_key: int = BITS_PER_KEY, broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; the longest rule decides, then the list.

    ``path_lengths``: the distinct lengths of the rules' paths.
    """
    listed = materialise(listed, "url-list")
    hits = possible_hits(pages, listed, path_lengths, bits_per_key, broadcast_blocks).join(listed, "key")
    best = hits.groupBy(F.col("url").alias("b_url")).agg(F.max(F.struct("weight", "rule", "verdict")).alias("best"))
    out = pages.select("page_id", "url").join(best, F.col("url") == F.col("b_url"), "left")
    return out.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.col("best.weight").eqNullSafe(F.lit(-1)).alias("listed"),
    )


def listed_urls(spark: SparkSession, pages: int = LISTED_PAGES) -> DataFrame:
    """(url): the list that the query judges by, made from its parts, without a look at the judged pages."""
    out = spark.range(pages).select(F.col("id").cast("string").alias("no"))
    for name, values in (("a", PREFIXES), ("s", LISTED_SITES), ("d", DOMAINS), ("f", FOLDERS), ("e", ENDINGS)):
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.select(F.concat(F.lit("https://"), "a", "s", "d", "f", "no", "e").alias("url"))


def judge_pages(pages: DataFrame, rules=RULES, urls: DataFrame | None = None) -> DataFrame:
    """Every page under the rules and a list of URLs (column url), any spelling of which is met by its canonical form."""
    spark = pages.sparkSession
    listed = rule_list(spark, rules).unionByName(url_list(listed_urls(spark) if urls is None else urls))
    return filter_urls(pages, listed, sorted({len(p) for _, p, _ in rules}))
