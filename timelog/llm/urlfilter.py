"""URL filter: host rules, and gradient-boosted trees for what no rule decides.

Features are lexical (lengths, depth, digit ratio, entropy, parameter counts,
statistics of the host's suffix). All of it is DataFrame expressions: quantile
cuts, one histogram aggregate per tree level (over distinct feature patterns of
a bounded sample of labelled rows), and scoring as sums of CASE expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelog.llm.common import discard, stored

#: Most labelled urls that a fit reads; beyond it, the first in hash order.
FIT_ROWS = 100_000
#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FEATURES = ("url_len", "host_len", "path_len", "labels", "depth", "digit_ratio", "host_digits", "hyphens", "entropy", "params", "longest_label", "suffix_rate", "suffix_seen")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_UNIT = 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for urls without ://."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.when(known, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")
    path = F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, by host and all its subdomains and a prefix of the path; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.translate(text, what, ""))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features of columns url, host and path that need no statistics, and suffix."""
    url = F.coalesce("url", F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(F.filter(F.split(url, ""), lambda c: c != "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.withColumns(
        {
            "url_len": F.length(url),
            "host_len": F.length("host"),
            "path_len": F.length("path"),
            "labels": _count(F.col("host"), "."),
            "depth": _count(F.col("path"), "/"),
            "digit_ratio": _count(url, "0123456789") / n,
            "host_digits": _count(F.col("host"), "0123456789"),
            "hyphens": _count(F.col("host"), "-"),
            "entropy": F.round(entropy, 6),
            "params": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
            "longest_label": F.array_max(F.transform(F.split("host", r"\."), lambda x: F.length(x))),
            "suffix": F.regexp_extract("host", r"[^.]*$", 0),
        }
    ).withColumns({c: F.col(c).cast("double") for c in FEATURES[:-2]})


def _leaf_of(tree: dict, leaf) -> Column:
    if "feature" not in tree:
        return leaf(tree)
    return F.when(F.col(tree["feature"]) > tree["cut"], _leaf_of(tree["high"], leaf)).otherwise(_leaf_of(tree["low"], leaf))


def _leaves(tree: dict) -> list[dict]:
    return [tree] if "feature" not in tree else _leaves(tree["low"]) + _leaves(tree["high"])


class Boosted:
    """Trees over FEATURES; `suffixes` holds the suffix statistics of the training rows."""

    def __init__(self, base: float, trees: list[dict], suffixes: DataFrame | None):
        self.base, self.trees, self.suffixes = base, trees, suffixes

    def margin(self) -> Column:
        return sum((_leaf_of(t, lambda leaf: F.lit(leaf["value"])) for t in self.trees), F.lit(self.base))

    def score(self, df: DataFrame) -> DataFrame:
        """Adds score, the chance that a url is to be blocked, to rows with url, host and path."""
        df = lexical(df)
        if self.suffixes is None:
            df = df.withColumns({"suffix_rate": F.lit(0.5), "suffix_seen": F.lit(0.0)})
        else:
            df = df.join(self.suffixes, "suffix", "left").withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(0.5)), "suffix_seen": F.coalesce("suffix_seen", F.lit(0.0))})
        return df.withColumn("score", 1 / (1 + F.exp(-self.margin()))).drop(*FEATURES, "suffix")


def fit(labelled: DataFrame, trees: int = 8, depth: int = 3, bins: int = 12, rate: float = 0.4, ridge: float = 2.0, most: int = FIT_ROWS) -> Boosted:
    """From columns url, host, path, bad (boolean). Without rows of both kinds: a constant."""
    sample = labelled.where("bad is not null").orderBy(F.xxhash64("url"), "url", "bad").limit(most)
    rows = stored(lexical(sample.select("url", "host", "path", F.col("bad").cast("int").alias("bad"))))
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not n or bad in (0, n):
        return Boosted(math.log((bad + 0.5) / (n - bad + 0.5)) if n else -1.0, [], None)
    # Pulled towards one half, so that the rate of a rare suffix says little about its own rows.
    by_suffix = rows.groupBy("suffix").agg(F.count("*").alias("sn"), F.sum("bad").alias("sb"))
    suffixes = stored(by_suffix.select("suffix", F.round((F.col("sb") + 5) / (F.col("sn") + 10), 6).alias("suffix_rate"), F.round(F.log1p("sn"), 6).alias("suffix_seen")))
    seen = rows.join(suffixes, "suffix")
    cuts = seen.agg(*(F.percentile_approx(f, [k / bins for k in range(1, bins)], 10_000).alias(f) for f in FEATURES)).first()
    cuts = {f: sorted(set(cuts[f])) for f in FEATURES}
    # A feature takes the least value of its bin: patterns of bins with counts are all that trees need.
    floor = {f: sum((F.when(F.col(f) > c, 1).otherwise(0) for c in cuts[f]), F.lit(0)) for f in FEATURES}
    patterns = stored(seen.select("bad", *(floor[f].alias(f) for f in FEATURES)).groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("bad").alias("b")))
    model = Boosted(math.log(bad / (n - bad)), [], suffixes)
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin()))
        # Sums of whole units don't depend on the order of rows.
        g, h = F.round((F.col("b") - F.col("n") * p) * _UNIT).cast("long"), F.round(F.col("n") * p * (1 - p) * _UNIT).cast("long")
        now = stored(patterns.select(*FEATURES, g.alias("g"), h.alias("h")))
        tree: dict = {}
        for _ in range(depth):
            leaves = _leaves(tree)
            for k, leaf in enumerate(leaves):
                leaf["id"] = k
            bins_of = F.explode(F.array(*(F.struct(F.lit(j).alias("f"), F.col(f).alias("bin")) for j, f in enumerate(FEATURES)))).alias("x")
            hist: dict = {}
            for r in now.select(_leaf_of(tree, lambda leaf: F.lit(leaf["id"])).alias("leaf"), "g", "h", bins_of).groupBy("leaf", "x.f", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                hist.setdefault(r["leaf"], {}).setdefault(r["f"], {})[r["bin"]] = (r["g"] / _UNIT, r["h"] / _UNIT)
            for leaf in leaves:
                by_feature = hist.get(leaf["id"], {})
                gs, hs = map(sum, zip(*by_feature[0].values())) if by_feature else (0.0, 0.0)
                value = lambda g, h: {"value": rate * g / (h + ridge)}
                leaf |= value(gs, hs)
                best = (1e-6, None)
                for j, values in sorted(by_feature.items()):
                    lg = lh = 0.0
                    for b in sorted(values)[:-1]:
                        lg, lh = lg + values[b][0], lh + values[b][1]
                        gain = lg**2 / (lh + ridge) + (gs - lg) ** 2 / (hs - lh + ridge) - gs**2 / (hs + ridge)
                        if gain > best[0] + 1e-9:
                            best = (gain, {"feature": FEATURES[j], "cut": b, "low": value(lg, lh), "high": value(gs - lg, hs - lh)})
                if best[1]:
                    leaf |= best[1]
        discard(now)
        model.trees.append(tree)
    for tree in model.trees:
        _unbin(tree, cuts)
    discard(rows, patterns)
    return model


def _unbin(tree: dict, cuts: dict) -> None:
    """Cuts between bins become cuts between values."""
    if "feature" in tree:
        tree["cut"] = float(cuts[tree["feature"]][tree["cut"]])
        _unbin(tree["low"], cuts)
        _unbin(tree["high"], cuts)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict, score.

    The urls that rules decide are the labelled ones that the trees learn from;
    the trees judge the others. Null urls and urls without :// have empty host
    and path and are judged by the trees; without labelled urls they allow.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("own"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    model = fit(rows.where("ruled is not null").select("url", "host", "path", (F.col("ruled") == "block").alias("bad")))
    scored = model.score(rows)
    return scored.select(F.col("own").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
