"""URL filters over time: an as-of join of captures with dated list entries.

A list is a history of dated entries that add or remove a domain. Consecutive entries of a domain become
validity intervals, and a capture is blocked if, at its fetch time, an interval of its host or of a parent
domain is open; the longest such domain is reported. Intervals of a domain do not overlap, so each (host
suffix, time) meets at most one.

Hosts and times are made distinct before they are joined, and the join is an equality on the domain with the interval as a
residual: a host with a third of all captures is a skewed key, which adaptive execution splits. The list is joined like
any table, whatever its size.

Cases: of entries for a domain at the same time the removal counts; adding what is listed already or removing what is
not changes nothing; a null or unreadable URL has no host and is never blocked; entries with a null domain, action or time, and
captures without a fetch time, meet nothing. Domains are compared in lower case without a port or a closing dot. Repeated rows get
the same answer; further columns of captures pass through, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.llm.common import sifted

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)"


def host_of(url: str = "url") -> Column:
    host = F.lower(F.regexp_replace(F.regexp_extract(F.col(url), HOST, 1), r"\.$", ""))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, valid_from, valid_to) from (domain, action, dated): add or remove. valid_to is null while it lasts."""
    daily = (
        entries.where("domain is not null and action in ('add', 'remove') and dated is not null")
        .groupBy(F.lower("domain").alias("domain"), "dated")
        .agg(F.min((F.col("action") == "add").cast("int")).alias("listed"))
    )
    by_domain = Window.partitionBy("domain").orderBy("dated")
    changes = daily.withColumn("before", F.coalesce(F.lag("listed").over(by_domain), F.lit(0))).where("listed <> before")
    until = changes.withColumn("valid_to", F.lead("dated").over(by_domain))
    return until.where("listed = 1").select("domain", F.col("dated").alias("valid_from"), "valid_to")


def block(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched_at) with host, blocked, matched_domain and listed_since."""
    kept = captures.drop("host", "blocked", "matched_domain", "listed_since").withColumn("host", host_of())
    asked = kept.select("host", F.col("fetched_at").alias("__at")).where("host is not null and __at is not null").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    listed = intervals(entries)
    # Suffixes of one label, the hot ones, and all others that are on no list at all stop at a sieve of fixed size before the join.
    keys = sifted(asked.withColumn("domain", F.explode(suffixes)), F.col("domain"), listed.select("domain")).where("__may").drop("__may")
    met = keys.join(listed, "domain").where((F.col("valid_from") <= F.col("__at")) & (F.col("valid_to").isNull() | (F.col("__at") < F.col("valid_to"))))
    best = met.groupBy(F.col("host").alias("__host"), "__at").agg(F.max(F.struct(F.length("domain").alias("n"), "domain", "valid_from")).alias("__best"))
    answered = kept.join(best, (F.col("host") == F.col("__host")) & (F.col("fetched_at") == F.col("__at")), "left")
    return answered.withColumns(
        {"blocked": F.col("__best").isNotNull(), "matched_domain": F.col("__best.domain"), "listed_since": F.col("__best.valid_from")}
    ).drop("__host", "__at", "__best")


def _number(text: Column | str, start: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, 6), 16, 10).cast("long")


def captures_of(pages: DataFrame) -> DataFrame:
    """pages with a fetch time within 2024, derived from page_id."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(366 * 24 * 60))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + minute * 60).alias("fetched_at"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A list history derived from the pages: up to four dated entries for some of their hosts and domains."""
    host = host_of()
    names = pages.select(F.explode(F.array(host, F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1))).alias("domain")).where("domain <> ''").distinct()
    listed = names.where(_number("domain", 1) % 3 == 0)
    dated = F.timestamp_seconds(F.lit(1704067200) + (_number(F.concat_ws(":", "domain", "k"), 7) % 360) * 86400)
    return listed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).select("domain", F.when(F.col("k") % 2 == 0, "add").otherwise("remove").alias("action"), dated.alias("dated"))


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = block(captures_of(pages), entries_of(pages))
    clock = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("page_id", "url", "host", clock("fetched_at"), "blocked", "matched_domain", clock("listed_since"))


OP10_SQL = r"""
with c as (select page_id, url, nullif(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:\[]+)', 1), '\.$', '')), '') as host,
                  timestamp '2024-01-01' + to_minutes(page_id * 7919 % 527040) as fetched_at from pages),
n as (select distinct domain from (select host as domain from c union all select regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) from c) where domain <> ''),
e as (select domain, k % 2 = 0 as listed, timestamp '2024-01-01' + to_days((('0x' || substr(md5(domain || ':' || k), 7, 6))::bigint % 360)::int) as dated
      from n, (values (0), (1), (2), (3)) t(k) where ('0x' || substr(md5(domain), 1, 6))::bigint % 3 = 0),
s as (select domain, dated, min(listed::int) as listed from e group by 1, 2),
v as (select domain, dated, listed, coalesce(lag(listed) over (partition by domain order by dated), 0) as before from s),
i as (select domain, dated as valid_from, listed, lead(dated) over (partition by domain order by dated) as valid_to from v where listed <> before),
m as (select c.page_id, i.domain, i.valid_from, row_number() over (partition by c.page_id order by length(i.domain) desc) as nth
      from c join i on i.listed = 1 and (c.host = i.domain or ends_with(c.host, '.' || i.domain))
       and i.valid_from <= c.fetched_at and (i.valid_to is null or c.fetched_at < i.valid_to))
select c.page_id, c.url, c.host, strftime(c.fetched_at, '%Y-%m-%d %H:%M:%S') as fetched_at, m.domain is not null as blocked,
       m.domain as matched_domain, strftime(m.valid_from, '%Y-%m-%d %H:%M:%S') as listed_since
from c left join m on m.page_id = c.page_id and m.nth = 1
"""
