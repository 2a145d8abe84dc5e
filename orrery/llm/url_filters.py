"""URL filters (native): pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix, or any regular expression together with literals that every match contains as
whole tokens. Each rule is filed under the literal that the URL table holds least often; a URL's own tokens fetch the
candidate rules and only those run their expressions. The longest rule that fits decides.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: Tokens: runs of letters, digits and other characters that are neither of `. / : @ ? # & = ` nor white space.
TOKEN = r"[./:@?#&=\s]+"
#: Up to so many rules the index is a literal of the plan; beyond, it is a table that URL tokens are joined with.
INLINE_RULES = 64


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched in host + path; `literals` are tokens that each match must contain; `name` is reported."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]

    @staticmethod
    def prefix(text: str, verdict: str) -> "Rule":
        """`host/path`: the host and all its subdomains, paths that start with /path."""
        host, _, path = text.partition("/")
        whole = [t for t in re.split(TOKEN, host) if t] + [t for t in re.split(TOKEN, path.rpartition("/")[0]) if t]
        pattern = r"^(?:[^/]*\.)?" + re.escape(host) + "(?=/)" + re.escape("/" + path)
        return Rule(text, verdict, pattern, tuple(dict.fromkeys(whole)))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: from there up to `?`, `#` or the end.
    Both are empty for null and for a URL without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.concat(host, path), TOKEN), lambda t: t != ""))


def literal_counts(urls: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How often each literal of the rules occurs as a token in urls(host, path): one row a literal comes to the driver."""
    literals = sorted({t for r in rules for t in r.literals})
    if not literals:
        return {}
    wanted = F.array(*[F.lit(t) for t in literals])
    held = urls.select(F.explode(F.array_intersect(tokens(F.col("host"), F.col("path")), wanted)).alias("t"))
    return {r["t"]: r["n"] for r in held.groupBy("t").agg(F.count("*").alias("n")).collect()}


def index(rules: list[Rule], counts: dict[str, int]) -> list[tuple[str, int, Rule]]:
    """(rarest literal, position, rule); a rule without a literal is filed under the empty token, which every URL has."""
    return [(min(r.literals, key=lambda t: (counts.get(t, 0), t), default=""), k, r) for k, r in enumerate(rules)]


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", inline: int = INLINE_RULES) -> DataFrame:
    """Add host, path, rule (null where none fits) and verdict to pages(url, ...).

    Where several rules fit, the one with the longest name decides, then the first in `rules`. Null URLs, URLs without
    `://` and empty hosts fit only rules that match empty text; very long URLs are judged whole; repeated rows are each judged; an empty table gives an
    empty table; columns named host, path, rule or verdict are replaced, any others stay.
    """
    host, path = host_path(F.col("url"))
    own = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    filed = index(rules, literal_counts(own.select("host", "path"), rules))
    if len(rules) <= inline:
        found = _inline(F.col("host"), F.col("path"), filed)
        out = own.withColumn("__orrery_found", found)
    else:
        out = _joined(own, filed)
    return out.withColumns({"rule": F.col("__orrery_found.name"), "verdict": F.coalesce(F.col("__orrery_found.verdict"), F.lit(default))}).drop("__orrery_found")


FOUND = "size int, pos int, name string, verdict string"


def _inline(host: Column, path: Column, filed: list[tuple[str, int, Rule]]) -> Column:
    """The index as a literal map from token to rules: a URL's tokens fetch its candidates, and only those run their expressions."""
    by: dict[str, list[dict]] = {}
    for t, k, r in filed:
        by.setdefault(t, []).append({"size": len(r.name), "pos": -k, "name": r.name, "verdict": r.verdict, "pattern": r.pattern})
    if not by:
        return F.lit(None).cast(f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>")
    index = F.from_json(F.lit(json.dumps(by)), f"map<string,array<struct<{FOUND.replace(' ', ':').replace(',:', ',')},pattern:string>>>")
    fetched = F.flatten(F.array_compact(F.transform(F.concat(tokens(host, path), F.array(F.lit(""))), lambda t: F.try_element_at(index, t))))
    text = F.concat(host, path)
    fits = F.filter(fetched, lambda c: F.rlike(text, c["pattern"]))
    return F.array_max(F.transform(fits, lambda c: F.struct(*[c[n.split(" ")[0]].alias(n.split(" ")[0]) for n in FOUND.split(", ")])))


def _joined(own: DataFrame, filed: list[tuple[str, int, Rule]]) -> DataFrame:
    """Judge each distinct (host, path) once: its tokens fetch candidate rules by a join on the token."""
    spark = own.sparkSession
    rules = spark.createDataFrame([(t, len(r.name), -k, r.name, r.verdict, r.pattern) for t, k, r in filed], f"token string, {FOUND}, pattern string")
    once = own.select("host", "path").distinct()
    asked = once.withColumn("token", F.explode(F.concat(tokens(F.col("host"), F.col("path")), F.array(F.lit("")))))
    fits = asked.join(rules, "token").where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("size", "pos", "name", "verdict")).alias("__orrery_found"))
    return own.join(best, ["host", "path"], "left")
