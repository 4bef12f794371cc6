"""URL filters: a sort-merge range join of URLs with nested host rules.

A host is written label by label from the right ("www.example.net" becomes
"net.example.www."), so that a rule for a host and all its subdomains is the interval of
keys that start with the rule's key: from "net.example." up to "net.example/" ("/" is the
byte after "."). Intervals of that kind nest and never cross. The sweep over sorted keys
therefore has a stack of active rules which changes only at an interval's start or end:
at a start it holds the rules of the host and of all hosts above it, at an end those of
the hosts above. These boundaries are sorted among the URLs, and each URL takes the stack
of the last boundary before it; path prefixes are tested on that stack.

URLs and boundaries are dealt out by ranges of (key, row), so a host with a third of all
URLs spreads over many tasks. What a range inherits from the ranges before it is one stack
for each range.

Defined results: a null URL or one without "://" has an empty host and path, fits no rule
and gets the default verdict; repeated rows and ids each keep their own row; no rules or no
URLs give the default verdict or no rows; further columns of the URL table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STACK = "array<struct<rule:string,path:string,verdict:string,size:int>>"


def url_host(url: Column) -> Column:
    """From the first "://" to "/", "?", "#" or the end; A-Z in lower case."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to "?", "#" or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(host_labels(host), "."), F.lit("."))


def _boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): the active rules from each interval's start or end on."""
    r = rules.select(
        host_key(F.col("host")).alias("key"),
        host_labels(F.col("host")).alias("labels"),
        F.struct(
            F.concat("host", "path").alias("rule"), F.col("path"), F.col("verdict"),
            F.length(F.concat("host", "path")).alias("size"),
        ).alias("entry"),
    )
    above = r.groupBy("key").agg(F.first("labels").alias("labels")).select(
        "key",
        F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("depth"),
        F.size("labels").alias("depths"),
        "labels",
    ).select(
        "key", (F.col("depth") == F.col("depths")).alias("own"),
        F.concat(F.array_join(F.slice("labels", F.lit(1), F.col("depth")), "."), F.lit(".")).alias("up"),
    )
    on_host = r.groupBy(F.col("key").alias("up")).agg(F.collect_set("entry").alias("entries"))
    stacks = above.join(on_host, "up", "left").groupBy("key").agg(
        F.flatten(F.collect_list("entries")).alias("inside"),
        F.flatten(F.collect_list(F.when(~F.col("own"), F.col("entries")))).alias("after"),
    )
    end = F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/"))
    return stacks.select(F.col("key"), F.col("inside").cast(STACK).alias("stack")).unionByName(
        stacks.select(end.alias("key"), F.col("after").cast(STACK).alias("stack"))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """The longest rule that fits each URL, and its verdict.

    rules: host, path and verdict. Returns id_col, host, path, rule (null if none fits)
    and verdict.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    urls = pages.select(
        F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), host_key(host).alias("key"),
        F.lit(1).alias("is_url"), F.lit(None).cast(STACK).alias("stack"),
    )
    events = urls.unionByName(_boundaries(rules).withColumn("is_url", F.lit(0)), allowMissingColumns=True)
    dealt = stash(
        events.repartitionByRange("key", "is_url", "id", "path").withColumn("part", F.spark_partition_id()), "url-sweep"
    )
    # One row for each range, so the window without a partition is as short as the list of tasks.
    latest = dealt.groupBy("part").agg(
        F.max_by("stack", F.when(F.col("is_url") == 0, F.col("key"))).alias("latest")
    )
    carried = latest.select(
        "part",
        F.last("latest", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"),
    )
    sweep = Window.partitionBy("part").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    active = dealt.join(F.broadcast(carried), "part").select(
        "id", "host", "path", "is_url",
        F.coalesce(F.last("stack", ignorenulls=True).over(sweep), F.col("carried")).alias("active"),
    )
    fits = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["size"], r["rule"], r["verdict"])))
    return active.where("is_url = 1").withColumn("best", best).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"))


SQL = r"""
with parts as (
  select page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from (select page_id,
               case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest
        from pages)
), judged as (
  select *, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/'
  end as rule from parts
)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' else 'allow' end as verdict
from judged
"""
