"""URL rules found through their rarest literal token; native expressions only."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ascii_lower

RULES_PER_STEP = 500
_TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """`text` is host and path (`example.com/en/`: the host, its subdomains, paths that start so) or,
    with `glob`, a pattern over all that follows the scheme, in which `*` stands for any text."""

    text: str
    allow: bool
    glob: bool = False

    @property
    def regex(self) -> str:
        if self.glob:
            return "(?s)^" + ".*".join(re.escape(part) for part in self.text.split("*")) + "$"
        return r"^(?:[^/]*\.)?" + re.escape(self.text)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens a fitting URL must hold whole: those with a delimiter of the rule's own on
        either side; a host's first one starts a label."""
        text = self.text if self.glob else "." + self.text
        return re.findall(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", text)


def url_parts(url: Column) -> dict[str, Column]:
    """rest (after the first ://), host (A-Z lower-cased) and path; empty for null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return {"rest": rest, "host": ascii_lower(host), "path": path}


def _index(parts: DataFrame, rules: Sequence[UrlRule]) -> dict[str, list[UrlRule]]:
    """Rules by the token that is rarest among these URLs; under "" those without a whole token."""
    wanted = sorted({token for rule in rules for token in rule.tokens})
    counts = {}
    if wanted:
        seen = parts.select(F.explode(F.array_intersect("_tokens", F.array(*map(F.lit, wanted)))).alias("token"))
        counts = {row["token"]: row["n"] for row in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}
    found: dict[str, list[UrlRule]] = {}
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        found.setdefault(token, []).append(rule)
    return found


def _fitting(index: dict[str, list[UrlRule]]) -> Column:
    """The rules of this part of the index that fit, each a struct that sorts by rank."""

    def literal(rules: list[UrlRule]) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(not r.glob).alias("exact"), F.lit(len(r.text)).alias("size"), F.lit(r.text).alias("text"),
                    F.lit(r.allow).alias("allow"), F.lit(r.regex).alias("regex"),
                )
                for r in rules
            ]
        )

    held = F.create_map(*[c for token, rules in index.items() for c in (F.lit(token), literal(rules))])
    tokens = F.array_intersect(F.col("_tokens"), F.array(*map(F.lit, index)))
    candidates = F.flatten(F.transform(tokens, lambda t: F.element_at(held, t)))
    return F.filter(
        candidates,
        lambda r: F.when(r["exact"], F.regexp_like(F.col("_site"), r["regex"])).otherwise(
            F.regexp_like(F.col("_rest"), r["regex"])
        ),
    )


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, pattern, verdict: one row per row of `pages`, in no shuffle.

    The tokens of a URL fetch the rules indexed under them and only those run their expression.
    Among fitting host rules the longest wins (`rule`); without one the longest fitting glob
    (`pattern`), allow before block at equal length; else `default`. Counting tokens is one
    aggregate, of which only the rules' own tokens reach the driver. Larger rule sets are taken
    in steps of RULES_PER_STEP, so that no expression grows without end. A null URL, or one
    without ://, has an empty host and path and fits no host rule. Repeated rows are judged one by one.
    """
    parts = url_parts(F.col("_url"))
    frame = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("_url"))
    frame = frame.select("page_id", *[c.alias(f"_{name}") for name, c in parts.items()])
    frame = frame.withColumn("_site", F.concat("_host", "_path"))
    frame = frame.withColumn(
        "_tokens", F.array_append(F.regexp_extract_all(F.concat_ws(" ", "_site", "_rest"), F.lit(_TOKEN), F.lit(0)), "")
    )
    index = _index(frame, rules)
    tokens, best = sorted(index), F.lit(None)
    steps, step, size = [], {}, 0
    for token in tokens:
        step[token], size = index[token], size + len(index[token])
        if size >= RULES_PER_STEP:
            steps.append(step)
            step, size = {}, 0
    if step:
        steps.append(step)
    best = F.array_max(F.concat(*[_fitting(s) for s in steps])) if steps else None
    if best is None:
        return frame.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("pattern"), F.lit(default).alias("verdict"))
    frame = frame.withColumn("_best", best)
    return frame.select(
        "page_id",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.when(F.col("_best.exact"), F.col("_best.text")).alias("rule"),
        F.when(~F.col("_best.exact"), F.col("_best.text")).alias("pattern"),
        F.when(F.col("_best.allow"), "allow").when(~F.col("_best.allow"), "block").otherwise(default).alias("verdict"),
    )
