"""Public suffixes as a table of rules, and the registrable domain of hosts by a longest-match join.

A rule is text as in the public suffix list: labels, a wildcard for one label (*.ck), or an exception to one (!www.ck). Of the rules that end a host an exception wins, else the one with most
labels; without any, the last label is the suffix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.fixed import COUNTRY_SUFFIXES, PRIVATE_SUFFIXES, SUFFIX_EXCEPTIONS, WILDCARD_COUNTRIES

#: rules that are sent to all tasks; a longer table is shuffled
MOST_RULES = 50_000


def own_rules(spark: SparkSession) -> DataFrame:
    """(rule, section): the rules that ``urls.registrable_domain`` goes by."""
    icann = [f"{second}.{country}" for country, seconds in COUNTRY_SUFFIXES.items() for second in seconds.split()]
    icann += [f"*.{country}" for country in WILDCARD_COUNTRIES] + [f"!{host}" for host in SUFFIX_EXCEPTIONS]
    return spark.createDataFrame([(r, "icann") for r in icann] + [(r, "private") for r in PRIVATE_SUFFIXES], "rule string, section string")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, section) of a file in the format of the public suffix list: a rule a line up to the first blank, comments behind //, and a mark where private domains begin."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("lines"))
    mark = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("===BEGIN PRIVATE DOMAINS==="))), True)
    rows = lines.select(mark.alias("mark"), F.posexplode("lines").alias("n", "line"))
    rule = F.lower(F.regexp_extract("line", r"^\s*+(?!//)(\S+)", 1))
    section = F.when((F.col("mark") > 0) & (F.col("n") >= F.col("mark")), "private").otherwise("icann")
    return rows.select(rule.alias("rule"), section.alias("section")).filter("rule <> ''").groupBy("rule").agg(F.min("section").alias("section"))


def registrable(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, suffix, section, domain) of the different hosts of (host).

    domain: the suffix with one more label; of addresses and of hosts that are a suffix themselves, the host. section: icann, private, or none where no rule ends the host. Hosts are read in
    lower case, without brackets and a point at the end; names beyond ASCII match rules in the same writing only. Null hosts are left out.
    """
    once = hosts.select("host").filter("host is not null").distinct()
    name = F.regexp_replace(F.lower("host"), r"^\[|\]$|\.$", "")
    rows = once.select("host", name.alias("name"), urls.is_ip(name).alias("ip")).withColumn("labels", F.split("name", r"\."))
    ends = rows.filter("not ip").select("host", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("n")).withColumn("end", F.array_join(F.slice("labels", F.size("labels") - F.col("n") + 1, F.col("n")), "."))
    one = lambda rule, exception: F.struct(rule.alias("rule"), F.lit(exception).alias("exception"))
    tried = F.array(one(F.col("end"), False), one(F.concat(F.lit("*."), F.regexp_replace("end", r"^[^.]*\.", "")), False), one(F.concat(F.lit("!"), "end"), True))
    asked = ends.select("host", "n", F.explode(tried).alias("t")).select("host", "n", "t.rule", "t.exception").filter("n > 1 or rule not like '*.%'")
    small = rules.limit(MOST_RULES + 1).count() <= MOST_RULES
    met = asked.join(F.broadcast(rules) if small else rules, "rule")
    best = met.groupBy("host").agg(F.max(F.struct("exception", "n", "section")).alias("b")).select("host", (F.col("b.n") - F.col("b.exception").cast("int")).alias("size"), "b.section")
    out = rows.join(best, "host", "left").withColumn("size", F.when(~F.col("ip"), F.coalesce("size", F.lit(1))))
    end = lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), ".")
    domain = F.when(F.col("ip") | (F.size("labels") <= F.col("size")), F.col("name")).otherwise(end(F.col("size") + 1))
    return out.select("host", F.when(~F.col("ip"), end(F.col("size"))).alias("suffix"), "section", domain.alias("domain"))
