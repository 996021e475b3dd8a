"""URL filters (7): host-suffix / path-prefix expressions against a rule table.  Native.

Each distinct (host, path) is expanded into the expressions a rule could be written as:
every suffix of the host with at most as many labels as the longest rule host, times every
path prefix of a length that some rule path has.  Expressions and rules meet in an equi-join
on a short prefix of their digest; the full digest confirms the match, and the longest rule
wins.  Everything is JVM-side SQL functions.

Defined results: a null url or one without ``://`` has empty host and path and fits no rule;
no rule fits an empty host (unless a rule host is empty); ties in length go to the longer
rule host; among equal rules (same host and path) block wins; repeated pages each keep their
row; an empty table gives no rows.  Columns besides ``page_id`` and ``url`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict): the rules of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Verdict for a page that no rule fits.
DEFAULT_VERDICT = "allow"
#: Hex digits of the digest that the equi-join uses.
PREFIX_DIGITS = 8


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # the length keeps (host, path) pairs apart that concatenate to the same text
    return F.sha2(F.concat_ws(":", F.length(host), host, path), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page row."""
    bounds = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("len"))
    most = bounds.agg(F.max("labels")).first()[0] or 0
    # as many as the longest rule path has characters, at most
    lengths = sorted(r[0] for r in bounds.select("len").distinct().collect())
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                            F.lit(default).alias("verdict"))

    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n))
    exprs = (parts.select("host", "path").distinct()
             .withColumn("x_host", F.explode(suffixes))
             .withColumn("x_path", F.explode(prefixes))
             .withColumn("x_digest", _digest(F.col("x_host"), F.col("x_path")))
             .withColumn("x_key", F.substring("x_digest", 1, PREFIX_DIGITS)))
    keyed = (rules.groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path"))
             .agg(F.max("verdict").alias("r_verdict"))          # 'block' > 'allow'
             .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
             .withColumn("r_key", F.substring("r_digest", 1, PREFIX_DIGITS)))
    fits = exprs.join(keyed, (F.col("x_key") == F.col("r_key")) & (F.col("x_digest") == F.col("r_digest")))
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"),
                       F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    return (parts.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every page of ``pages`` judged by ``RULES``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


SQL = """
WITH rules(rh, rp, rv) AS (VALUES %s),
p AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS k FROM pages),
q AS (SELECT page_id, CASE WHEN k = 0 THEN '' ELSE substr(url, k + 3) END AS rest FROM p),
r AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS rid FROM q),
m AS (SELECT rid, rh || rp AS rule, rv, row_number() OVER (PARTITION BY rid ORDER BY length(rh || rp) DESC) AS n
      FROM r JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, '%s') AS verdict
FROM r LEFT JOIN (SELECT * FROM m WHERE n = 1) m USING (rid)
""" % (", ".join(str(r) for r in RULES), DEFAULT_VERDICT)
