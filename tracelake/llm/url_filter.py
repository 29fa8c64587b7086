"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

Host rules (allow or block a host with its subdomains, below a path) come first; the longest that fits decides.  Other
URLs are judged by pattern rules: regular expressions, each filed under that one of its literal tokens which the fewest
rules share.  The tokens of a URL fetch candidates from the index (an array of buckets addressed by the token's CRC, one
access a token), and only candidates run their expression.  Everything is one projection: no shuffle, no join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.shared import if_small, table, written

#: Host rules (verdict, host, path).
HOST_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Pattern rules (verdict, expression); every expression has a literal token of letters and digits.
PATTERN_RULES = (
    ("block", r"(?i)\bcasino\b"),
    ("block", r"(?i)\bcheap-pills\b"),
    ("block", r"(?i)\bfree-(xxx|porn|bets)\b"),
    ("block", r"(?i)://[^/?#]*\bporn\b"),
    ("block", r"(?i)://[^/?#]*\badult\b"),
    ("block", r"(?i)\bpoker-(online|win)\b"),
    ("block", r"(?i)\bviagra\b"),
    ("block", r"(?i)\bspam-farm\b"),
    ("block", r"(?i)\bads-track\b"),
    ("block", r"(?i)/wp-login\.php"),
    ("block", r"(?i)[?&]phpsessid="),
)
_TOKEN = "[^0-9a-z]+"


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every match of the expression has, between characters that cannot extend them.

    A token counts if it stands at the top level (in no group, class or alternative), is not followed by a quantifier,
    and has a literal separator, an escape such as ``\\b`` or an end of the expression on either side.
    """
    flat = re.sub(r"^\(\?[a-z]+\)", "", pattern)
    if re.search(r"(?<!\\)\|", re.sub(r"\((?:[^()\\]|\\.)*\)", "", flat)):
        return []
    # what is not literal becomes a letter-like mark that blocks a token beside it
    flat = re.sub(r"\\[bB]", "\x01", flat)
    flat = re.sub(r"\\[./?=&_:-]", "-", flat)
    flat = re.sub(r"\\.", "\x02", flat)
    flat = re.sub(r"\[[?&./=:;#_-]+\](?![*?{])", "-", flat)
    flat = re.sub(r"\[(?:[^\]\\]|\\.)*\][*+?]?", "\x02", flat)
    flat = re.sub(r"\((?:[^()\\]|\\.)*\)[*+?]?", "\x02", flat)
    out = []
    for m in re.finditer(r"[0-9A-Za-z]+", flat):
        before, after = flat[m.start() - 1 : m.start()], flat[m.end() : m.end() + 1]
        if before not in ("\x02", ".") and after not in ("\x02", ".", "*", "?", "+", "{") and (before and after):
            out.append(m[0].lower())
    return out


def pattern_index(rules: tuple[tuple[str, str], ...]) -> list[list[tuple[str, int, str, str]]]:
    """Buckets of (token, rank, verdict, expression); a token's bucket is its CRC-32 modulo their number."""
    tokens = [literal_tokens(p) for _, p in rules]
    if not all(tokens):
        raise ValueError(f"no literal token in {next(p for (_, p), t in zip(rules, tokens, strict=True) if not t)!r}")
    shared = Counter(t for own in tokens for t in set(own))
    buckets: list[list[tuple[str, int, str, str]]] = [[] for _ in range(max(1, 2 * len(rules)))]
    for rank, ((verdict, pattern), own) in enumerate(zip(rules, tokens, strict=True)):
        key = min(own, key=lambda t: (shared[t], -len(t), t))
        buckets[zlib.crc32(key.encode()) % len(buckets)].append((key, rank, verdict, pattern))
    return buckets


def _struct(key: str, rank: int, verdict: str, pattern: str) -> Column:
    return F.struct(F.lit(key).alias("key"), F.lit(rank).alias("rank"), F.lit(verdict).alias("verdict"), F.lit(pattern).alias("pattern"))


def host_of(url: Column) -> Column:
    """A-Z lower-cased part after the first ``://`` up to ``/``, ``?``, ``#`` or the end; '' for none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_by_host(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, fits) of the different hosts of ``hosts`` (host): the rules (verdict, host, path) of the host and the domains above it, longest first.

    For lists too long for a plan: the suffixes of each different host are joined with the rules' hosts.
    """
    parts = F.split("host", r"\.")
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1  # no rule fits a longer suffix
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - most + 1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = rules.select(F.col("host").alias("_rhost"), F.col("path").alias("_rpath"), F.col("verdict").alias("_what")).distinct()
    rule = F.concat("_rhost", "_rpath")
    fit = F.struct((-F.length(rule)).alias("order"), rule.alias("rule"), F.col("_rpath").alias("path"), F.col("_what").alias("verdict"))
    return hosts.select("host").distinct().select("host", F.explode(F.array_distinct(suffixes)).alias("_rhost")).join(asked, "_rhost").groupBy("host").agg(F.array_sort(F.collect_list(fit)).alias("fits"))


def judged(pages: DataFrame, url_col: str = "url", host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """``pages`` with host, path, rule (the host rule that decides, else null), pattern (the first matching expression, else
    null) and verdict; URLs that nothing fits are allowed, null URLs too.  Columns of these names are replaced.

    ``host_rules``: tuples (verdict, host, path) that become part of the plan, or a table of these columns of any length.
    Of rules of one length the first by code point decides."""
    url = F.col(url_col)
    out = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    ordered = ()
    if isinstance(host_rules, DataFrame):
        own = written(rules_by_host(out, host_rules), "url-rules").withColumnRenamed("host", "_host")
        out = out.join(if_small(own, 400), out["host"] == own["_host"], "left").drop("_host")
        first = F.get(F.filter("fits", lambda r: F.col("path").startswith(r["path"])), F.lit(0))
        out = out.withColumn("_fit", first).drop("fits")
        rule, verdict = F.col("_fit.rule"), F.col("_fit.verdict")
    else:  # longest rule first: the first that fits decides
        ordered = sorted(host_rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    for what, host, path in reversed(ordered):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    buckets = pattern_index(pattern_rules)
    empty = F.filter(F.array(_struct("", 0, "", "")), lambda r: F.lit(False))
    index = F.array(*[F.array(*[_struct(*r) for r in b]) if b else empty for b in buckets])
    tokens = F.array_distinct(F.split(F.lower(url), _TOKEN))
    fetched = F.flatten(F.transform(tokens, lambda t: F.filter(F.element_at(index, (F.crc32(F.encode(t, "UTF-8")) % len(buckets) + 1).cast("int")), lambda r: r["key"] == t)))
    matched = F.array_min(F.transform(F.filter(fetched, lambda r: F.regexp_like(url, r["pattern"])), lambda r: F.struct(r["rank"].alias("rank"), r["verdict"].alias("verdict"), r["pattern"].alias("pattern"))))
    out = out.withColumns({"rule": rule, "_own": verdict})
    out = out.withColumn("_hit", F.when(F.col("_own").isNull(), matched))
    return out.withColumns({"pattern": F.col("_hit.pattern"), "verdict": F.coalesce("_own", F.col("_hit.verdict"), F.lit("allow"))}).drop("_own", "_hit", "_fit")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "pattern", "verdict")


_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_H = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in HOST_RULES)
_P = ", ".join(f"({k}, '{v}', '{p}')" for k, (v, p) in enumerate(PATTERN_RULES))
OP5_SQL = rf"""
WITH u AS (SELECT row_number() OVER () AS k, page_id, url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), '{_A}', '{_Z}') AS host,
                  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h(verdict, rhost, rpath) AS (VALUES {_H}),
m AS (SELECT k, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS own
      FROM u, h WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k),
p(rnk, verdict, pattern) AS (VALUES {_P}),
n AS (SELECT k, arg_min(pattern, rnk) AS pattern, arg_min(verdict, rnk) AS hit FROM u, p WHERE regexp_matches(url, pattern) GROUP BY k)
SELECT page_id, host, path, rule, CASE WHEN own IS NULL THEN pattern END AS pattern, coalesce(own, hit, 'allow') AS verdict
FROM u LEFT JOIN m USING (k) LEFT JOIN n USING (k)
"""
