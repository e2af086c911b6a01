"""The scores of the fitted models against plain loops over the same tables, centroids and trees."""

import math
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timelog.llm import langid, quality, urlfilter

TEXTS = [
    None, "", " \t\n", "One two, three; four. Five: six!", "ÄÖ ü ß 漢字 \U00030123 12 %$#", "word " * 700, "A\nA\nB\n\nlonger line of words here\r\n" * 30, "x" * 5000, "().[]{}<>\"'`-- ??!!",
    "the quick brown fox jumps over the lazy dog and the other one", "the quick brown fox jumps over the lazy dog and the other one", "\U0001f600\U0001f600 e\u0301", "0 1 2 3 4 5 6 7 8 9" * 20,
]


def plain_quality_features(text):
    data = (text or "").encode()
    if not data:
        return [0.0] * 18
    kinds = [bytes(range(65, 91)), b"0123456789", b" \t", b"\n\r", b",.;:", b"!?", b"*#$%&@^~_=+|\\/", b"()[]{}<>\"'`-"]
    share = [sum(c in k for c in data) / len(data) for k in kinds]
    tokens = data.split()
    n = max(1, len(tokens))
    lines = [x for x in data.split(b"\n") if x]
    counts = Counter(tokens)
    sizes = [len(t) for t in tokens] or [0]
    short, long = sum(s <= 3 for s in sizes) / len(sizes), sum(s >= 12 for s in sizes) / len(sizes)
    return [
        math.log1p(len(data)), math.log1p(len(tokens)), sum(sizes) / len(sizes), *share, sum(c >= 128 for c in data) / len(data),
        1 - len(counts) / n, short, long, math.log1p(len(data) / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)), max(counts.values(), default=0) / n,
    ]


def plain_quality_score(model, x):
    place = [bisect_right(list(cuts), v) for cuts, v in zip(model.cuts, x)]
    z = model.base + sum(table[k] for table, k in zip(model.single, place))
    z += sum(table[model.coarse[i][place[i]], model.coarse[j][place[j]]] for (i, j), table in zip(model.pairs, model.double))
    return 1 / (1 + math.exp(-z))


def test_quality_scores_are_bin_sums(spark, documents, sample):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), labels)
    rows = [(n, t) for n, t in enumerate(TEXTS)] + [(1000 + r.doc_id, r.text) for r in sample.limit(150).collect()] + [(3, "same id")]
    got = sorted((r.doc_id, r.score) for r in quality.score_quality(documents(rows, extra=True), model).collect())
    want = sorted((i, plain_quality_score(model, plain_quality_features(t))) for i, t in rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-9)


def plain_grams(text):
    """The counts of hashed grams of one to three letters; what is no letter is a word break, and so are both ends."""
    points = [32, *(ord(c) if c.isalpha() else 32 for c in (text or "").lower()), 32]
    counts = Counter()
    mask = 0xFFFFFFFF
    for k in range(2, len(points)):
        one = points[k] * 0x9E3779B1 & mask
        two = one + points[k - 1] * 0x85EBCA6B & mask
        three = two + points[k - 2] * 0xC2B2AE35 & mask
        if points[k] == points[k - 1] == 32:
            continue
        for salt, h in enumerate((one, two, three)):
            h = h + salt * 0x27D4EB2F & mask
            h ^= h >> 15
            h = h * 0x2C1B3C6D & mask
            counts[h >> 32 - langid.BITS] += 1
    return counts


def plain_language(model, text):
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    v = {g: math.log1p(n) * float(model.idf[g]) for g, n in plain_grams(text).items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    near = [max(sum(x * float(p[g]) for g, x in v.items()) / norm for p, owner in zip(model.points, model.owner) if owner == k) for k in range(len(model.langs))]
    best = max(range(len(near)), key=lambda k: near[k])
    return model.langs[best], 1 / sum(math.exp(langid.SHARPNESS * (x - near[best])) for x in near)


def test_language_is_the_nearest_centroid(spark, documents, sample):
    model = langid.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(n, t) for n, t in enumerate(TEXTS)] + [(1000 + r.doc_id, r.text[:4000] if r.text else None) for r in sample.limit(120).collect()]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(documents(rows, extra=True), model).collect()}
    for i, t in rows:
        lang, score = plain_language(model, t)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-4), (i, t)


def test_letters_beyond_the_first_planes(documents):
    docs = documents([(n, "漢字仮名" * 5, "ja", "s") for n in range(40)])
    model = langid.train(docs)
    got = {r.doc_id: r.lang_pred for r in langid.predict(documents([(1, "\U00030123\U00030456"), (2, "\U000e0041 \U0010fffd")]), model).collect()}
    assert got == {1: "ja", 2: "und"}


def test_rare_language_is_learned(documents):
    rows = [(n, "the cat sat on the mat", "en", "s") for n in range(300)] + [(1000 + n, "qzx vwq xqz zzx qqv", "xx", "s") for n in range(8)] + [(2000 + n, None, "yy", "s") for n in range(50)]
    model = langid.train(documents(rows), most=20, least=3)
    assert model.langs == ["en", "xx"]


def plain_url_features(url, suffixes):
    url = url or ""
    rest = url.partition("://")[2] if "://" in url else None
    host = path = ""
    if rest is not None:
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    n = max(1, len(url))
    query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(url).values())
    digits = lambda s: sum(c in "0123456789" for c in s)
    rate, seen = suffixes.get(host.rsplit(".", 1)[-1], (0.5, 0.0))
    return host, path, {
        "url_len": len(url), "host_len": len(host), "path_len": len(path), "labels": host.count("."), "depth": path.count("/"), "digit_ratio": digits(url) / n, "host_digits": digits(host),
        "hyphens": host.count("-"), "entropy": round(entropy, 6), "params": query.count("&") + 1 if query else 0, "longest_label": max(map(len, host.split("."))), "suffix_rate": rate, "suffix_seen": seen,
    }


def plain_tree(tree, x):
    while "feature" in tree:
        tree = tree["high"] if x[tree["feature"]] > tree["cut"] else tree["low"]
    return tree["value"]


def test_url_scores_are_tree_sums(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = [(10_001, None), (10_002, ""), (10_003, "no scheme"), (10_004, "http://"), (10_005, "http://x.net?" + "a=1&" * 4000), (10_006, "HTTP://A-1.Example.ORG/fr/x#?y"), (10_006, "s://b://c/?"), (10_007, "http://h/#f?q=1")]
    pages = pages.unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    host, path = urlfilter.host_and_path(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    rule, ruled = urlfilter.rule_for(F.col("host"), F.col("path"))
    rows = rows.withColumn("ruled", ruled)
    model = urlfilter.fit(rows.where("ruled is not null").select("url", "host", "path", (F.col("ruled") == "block").alias("bad")))
    suffixes = {r.suffix: (r.suffix_rate, r.suffix_seen) for r in model.suffixes.collect()}
    got = sorted(((r.page_id, r.url or "", r.host, r.path, r.verdict, r.score) for r in urlfilter.judge(pages).join(pages.withColumnRenamed("page_id", "p").distinct(), F.col("page_id") == F.col("p")).where(F.col("page_id") != 10_006).collect()))
    assert model.trees and len(got) == pages.where("page_id <> 10006").count()
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[0] + r[1]))
    for page, url, host, path, verdict, score in got:
        h, p, x = plain_url_features(url, suffixes)
        z = model.base + sum(plain_tree(t, x) for t in model.trees)
        fit = next((v for rh, rp, v in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)), None)
        assert (host, path) == (h, p) and score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6), url
        assert verdict == (fit or ("block" if score >= 0.5 else "allow"))


def held_out_accuracy(pages):
    """Share of ruled urls of a held-out fifth on which the trees alone agree with the rules, and that of always saying the commoner verdict."""
    host, path = urlfilter.host_and_path(F.col("url"))
    rows = pages.select("url").distinct().withColumns({"host": host, "path": path})
    rows = rows.withColumn("bad", urlfilter.rule_for(F.col("host"), F.col("path"))[1] == "block").where("bad is not null")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(5)) == 0
    model = urlfilter.fit(rows.where(~fold))
    out = model.score(rows.where(fold)).agg(F.avg(((F.col("score") >= 0.5) == F.col("bad")).cast("int")), F.avg(F.col("bad").cast("int"))).first()
    return out[0], max(out[1], 1 - out[1])


def test_url_trees_on_held_out_urls(spark):
    got, plain = held_out_accuracy(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    assert got > 0.7 and got > plain + 0.1
