"""Operator 6: URL filters by hashed host-suffix and path-prefix expressions.

Every URL is expanded into the expressions that a rule could be: suffixes of its host (of as many labels as some rule has) joined to prefixes of its
path (of as many characters as some rule has). Expressions meet the rules in an equi-join on the first four bytes of their SHA-256; the full digest
confirms a hit; of a URL's rules the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titrate.llm.common import ascii_lower, replacing, settled, table
from titrate.llm.registry import query

PREFIX_HEX = 8  # four bytes of the digest
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
SEPARATOR = "\n"  # between host and path in an expression; expressions with one inside the host still differ by their digest's input


def host_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"(?s)\A[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def expression(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(SEPARATOR), path), 256)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with host, path, rule (host and path of the winning rule, else null) and verdict.

    A rule (host, path, verdict) fits its host and all subdomains when the path starts with the rule's. The longest rule wins (characters of host
    and path), then the one with the longer host, then ``block`` before ``allow``. Without a rule the verdict is ``default``. A null URL or one
    without ``://`` has empty host and path. Rules with a null in host or path fit nothing; repeated rules count once. Empty tables are fine on
    both sides. Input columns named like a result column are replaced.
    """
    known = rules.where("host is not null and path is not null and verdict is not null").select(
        ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    # Only sizes leave the rule table: at most as many numbers as a host has labels, or a path characters.
    labels = sorted(r[0] for r in known.select(F.size(F.split("r_host", r"\.", -1))).distinct().collect())
    sizes = sorted(r[0] for r in known.select(F.length("r_path")).distinct().collect())
    rows = settled(pages).withColumn("__uid", F.monotonically_increasing_id()).withColumn("__host", host_of(F.col(url))).withColumn("__path", path_of(F.col(url)))
    hosts = F.array_distinct(F.array(*[F.substring_index("__host", ".", -n) for n in labels])) if labels else F.expr("array('')")
    prefixes = F.filter(F.array(*[F.when(F.length("__path") >= n, F.substring("__path", 1, n)) for n in sizes]), lambda p: p.isNotNull()) if sizes else F.expr(
        "cast(array() as array<string>)")
    expanded = rows.select("__uid", F.explode(hosts).alias("e_host"), prefixes.alias("__prefixes")).select(
        "__uid", "e_host", F.explode("__prefixes").alias("e_path")).withColumn("digest", expression(F.col("e_host"), F.col("e_path")))
    hashed = known.distinct().withColumn("r_digest", expression(F.col("r_host"), F.col("r_path")))
    hit = (F.substring("digest", 1, PREFIX_HEX) == F.substring("r_digest", 1, PREFIX_HEX)) & (F.col("digest") == F.col("r_digest"))
    rank = F.struct(F.length(F.concat("r_host", "r_path")).alias("size"), F.length("r_host").alias("host_size"), (F.col("r_verdict") == "block").alias("block"),
                    F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    winners = expanded.join(hashed, hit).groupBy("__uid").agg(F.max(rank).alias("__win"))
    results = {"host": F.col("__host"), "path": F.col("__path"), "rule": F.col("__win.rule"),
               "verdict": F.coalesce(F.col("__win.verdict"), F.lit(default))}
    own = [f"`{c}`" for c in replacing(pages, *results).columns]
    return rows.join(winners, "__uid", "left").select(*own, *[v.alias(n) for n, v in results.items()])


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_AFTER = "substr(url, instr(url, '://') + 3)"
SQL = f"""
with r(r_host, r_path, r_verdict) as (values {", ".join(str(r) for r in RULES)}),
p as (select page_id, case when instr(url, '://') > 0 then {_LOWER.format(f"regexp_extract({_AFTER}, '^([^/?#]*)', 1)")} else '' end as host,
             case when instr(url, '://') > 0 then regexp_extract({_AFTER}, '^[^/?#]*([^?#]*)', 1) else '' end as path, row_number() over () as uid from pages),
f as (select p.uid, max_by(r, length(r_host || r_path) * 10000 + length(r_host)) as best from p join r
      on (p.host = r_host or ends_with(p.host, '.' || r_host)) and starts_with(p.path, r_path) group by p.uid)
select page_id, host, path, best.r_host || best.r_path as rule, coalesce(best.r_verdict, 'allow') as verdict from p left join f using (uid)
"""


@query("op6_url_filter", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")
