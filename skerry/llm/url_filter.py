"""URL filter: path rules first, else the empirical-Bayes reputation of the host (DataFrame functions only).

Labelled page outcomes (good or bad) are counted per host. Each level of the address (suffix, registered domain, host)
has a beta prior whose mean is the posterior mean of the level above and whose strength is fitted by the method of moments
for beta-binomial counts. A page is allowed if the lower posterior bound of its host's share of good pages reaches the
threshold.

Defined results: a null url, or one without ``://``, has an empty host and path, which no rule fits; hosts without labels
get their domain's prior; without any labels the global share is one half. Outcomes that are null are ignored; of several
outcomes of one page the worst counts. An empty table gives an empty table; extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import ascii_lower, checkpointed, table

#: Rules of the production query: verdict and host/path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Suffixes of more than one label, so that their registered domain has one label more (a parameter).
LONG_SUFFIXES = ("co.uk", "com.au", "co.jp", "com.br")


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    long = F.substring_index(host, ".", -2).isin(*long_suffixes)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def address_suffix(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. The rules are a short driver-side list, so they become
    one expression: no join, no shuffle."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(groups: DataFrame, mean: Column) -> DataFrame:
    """One row: the prior strength k of a level, by moments; groups has n, s (trials and successes) and the prior mean."""
    p = F.col("s") / F.col("n")
    m = groups.filter("n > 0").select("n", p.alias("p"), mean.alias("m"))
    a = m.agg(
        F.sum("n").alias("nn"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count(F.lit(1)).alias("kk"),
        F.sum(F.col("n") * F.pow(F.col("p") - F.col("m"), 2) / F.greatest(F.col("m") * (1 - F.col("m")), F.lit(1e-9))).alias("q"),
    )
    free = F.col("nn") - F.col("n2") / F.col("nn") - (F.col("kk") - 1)
    rho = F.when(free > 0, (F.col("q") - (F.col("kk") - 1)) / free).otherwise(F.lit(0.0))
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1e-3)), F.lit(0.5))
    return a.select(((1 - rho) / rho).alias("k"))


def host_reputation(host_counts: DataFrame, long_suffixes: Sequence[str] = LONG_SUFFIXES, z: float = 1.645) -> DataFrame:
    """(host, n, s) -> (host, n, s, mean, bound): posterior mean and lower bound of the share of good pages.

    All tables here have one row per host or fewer; the one-row strengths join as scalars of proven size.
    """
    hosts = host_counts.select("host", "n", "s", registered_domain(F.col("host"), long_suffixes).alias("domain"),
                               address_suffix(F.col("host"), long_suffixes).alias("suffix"))
    total = hosts.agg(F.coalesce(F.sum("s") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.5)).alias("p0"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(F.broadcast(total))
    k = _strength(suffixes, F.col("p0"))
    suffixes = suffixes.join(F.broadcast(k)).select("suffix", ((F.col("s") + F.col("k") * F.col("p0")) / (F.col("n") + F.col("k"))).alias("up"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).join(suffixes, "suffix")
    k = _strength(domains, F.col("up"))
    domains = domains.join(F.broadcast(k)).select("domain", ((F.col("s") + F.col("k") * F.col("up")) / (F.col("n") + F.col("k"))).alias("prior"))
    hosts = hosts.join(domains, "domain")
    k = _strength(hosts, F.col("prior"))
    a, b = F.col("s") + F.col("k") * F.col("prior"), F.col("n") - F.col("s") + F.col("k") * (1 - F.col("prior"))
    out = hosts.join(F.broadcast(k)).select("host", "n", "s", a.alias("a"), b.alias("b"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    spread = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    return out.select("host", "n", "s", mean.alias("mean"), (mean - z * spread).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5,
               z: float = 1.645, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """pages (page_id, url) and outcomes (page_id, good boolean) -> page_id, host, path, rule, verdict, bound."""
    seen = outcomes.filter(F.col("good").isNotNull()).groupBy("page_id").agg(F.min(F.col("good").cast("long")).alias("good"))
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # the host with a third of all pages is summed up before the shuffle
    counts = urls.join(seen, "page_id", "left").groupBy("host").agg(
        F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("s"))
    # one narrow row for each host, used at three levels: checkpointed, so that the pages are read once for it
    reputation = host_reputation(checkpointed(counts), long_suffixes, z).select("host", "bound")
    out = urls.withColumn("hit", rule_match(F.col("host"), F.col("path"), rules)).join(reputation, "host", "left")
    own = F.when(F.col("bound") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "host", "path", F.col("hit.rule").alias("rule"),
                      F.coalesce(F.col("hit.verdict"), own).alias("verdict"), "bound")


def labelled_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page's outcome is the label of the document that its address names: good if of quality and not toxic; labels without a quality say
    nothing, a null for toxic counts as no."""
    named = pages.select("page_id", F.try_to_number(F.regexp_extract(url_path(F.col("url")), r"/(\d{1,18})(?:\.\w+|/)?$", 1), F.lit("9" * 18)).cast("long").alias("doc_id"))
    good = labels.filter("quality is not null").select("doc_id", ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("good"))
    return named.join(good, "doc_id").select("page_id", "good")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = labelled_outcomes(pages, table(spark, sf_dir, "labels"))
    return judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def _strength_sql(name: str, groups: str, mean: str) -> str:
    return f"""{name} as (
  select (1 - rho) / rho as k from (
    select least(greatest(coalesce(case when nn - n2 / nn - (kk - 1) > 0 then (q - (kk - 1)) / (nn - n2 / nn - (kk - 1)) else 0.0 end, 0.0), 1e-3), 0.5) as rho
    from (select sum(n)::double as nn, sum(n * n)::double as n2, count(*)::double as kk,
            sum(n * pow(s / n - {mean}, 2) / greatest({mean} * (1 - {mean}), 1e-9)) as q
          from {groups} where n > 0)))"""


OP3_SQL = rf"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages
), good as (
  select doc_id, min(case when quality = 1 and coalesce(toxic, 0) = 0 then 1 else 0 end) as good from labels where quality is not null group by doc_id
), seen as (
  select u.page_id, min(good) as good
  from u join good on good.doc_id = try_cast(regexp_extract(path, '/(\d{{1,18}})(?:\.\w+|/)?$', 1) as bigint) group by 1
), h as (
  select host, count(good)::double as n, coalesce(sum(good), 0)::double as s,
    case when array_to_string(string_split(host, '.')[-2:], '.') in ({", ".join(f"'{x}'" for x in LONG_SUFFIXES)}) then array_to_string(string_split(host, '.')[-3:], '.')
      else array_to_string(string_split(host, '.')[-2:], '.') end as domain,
    case when array_to_string(string_split(host, '.')[-2:], '.') in ({", ".join(f"'{x}'" for x in LONG_SUFFIXES)}) then array_to_string(string_split(host, '.')[-2:], '.')
      else string_split(host, '.')[-1] end as suffix
  from u left join seen using (page_id) group by host
), t as (select coalesce(sum(s) / nullif(sum(n), 0), 0.5) as p0 from h),
s1 as (select suffix, sum(n) as n, sum(s) as s, any_value(p0) as p0 from h, t group by suffix),
{_strength_sql("k1", "s1", "p0")},
s2 as (select suffix, (s + k * p0) / (n + k) as up from s1, k1),
d1 as (select domain, suffix, sum(n) as n, sum(s) as s, any_value(up) as up from h join s2 using (suffix) group by domain, suffix),
{_strength_sql("k2", "d1", "up")},
d2 as (select domain, (s + k * up) / (n + k) as prior from d1, k2),
h1 as (select h.*, prior from h join d2 using (domain)),
{_strength_sql("k3", "h1", "prior")},
ab as (select host, s + k * prior as a, n - s + k * (1 - prior) as b from h1, k3),
bound as (select host, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) as bound from ab),
r as (
  select u.*, case
    when (host = 'example.net' or host like '%.example.net') and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or host like '%.net') and starts_with(path, '/') then 'net/' end as rule
  from u)
select page_id, r.host, path, rule, case when rule in ('example.net/en/', 'org/fr/') then 'allow' when rule is not null then 'block'
  when bound >= 0.5 then 'allow' else 'block' end as verdict
from r left join bound using (host)
"""
