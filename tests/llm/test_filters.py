"""Decontamination, quality, language, urls, mixing, chat, pipeline."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from timelog.llm import chat, decontam, langid, mixing, quality, urlfilter


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(docs, items, window=10):
    grams = defaultdict(set)
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            grams[tuple(w[k : k + size])].add(str(name))
    sizes = {len(g) for g in grams}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                g = tuple(w[k : k + size])
                if g in grams:
                    hit |= set(range(k, k + size))
                    found |= grams[g]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def got_hits(docs, items):
    return sorted(((r.doc_id, r.n_words, sum(b - a for a, b in r.spans), list(r["items"])) for r in decontam.benchmark_hits(docs, items).collect()), key=str)


def test_benchmark_real(spark, sf_dir, sample, sample_rows):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = plain_hits(zip(sample_rows.doc_id.tolist(), sample_rows.text.tolist()), [tuple(r) for r in bench.collect()])
    assert got_hits(sample, bench) == want
    left = {r.doc_id for r in decontam.decontaminate(sample, bench).collect()}
    assert left == {i for i, _, n, _ in want if not n}


def test_benchmark_edges(spark, documents, monkeypatch):
    ten = "one two three four five six seven eight nine ten"
    items = [(1, "alpha beta"), (2, "beta"), (3, ten + " eleven"), (4, None), (5, "..."), (6, ten), (7, "alpha beta")]
    rows = [(1, None), (2, ""), (3, "Alpha, BETA! gamma"), (4, "x " + ten.upper() + " eleven y"), (5, "beta beta"), (6, ten.replace("five", "5")), (7, "two three " + ten + " eleven " + ten), (None, "alpha"), (3, "beta")]
    docs, bench = documents(rows, extra=True), spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(rows, items)
    assert got_hits(docs, bench) == want
    monkeypatch.setattr(decontam, "SHARD_BYTES", 30)
    assert got_hits(docs, bench) == want
    assert got_hits(docs, bench.limit(0)) == plain_hits(rows, [])
    assert decontam.benchmark_hits(documents([]), bench).count() == 0
    assert decontam.decontaminate(docs, bench).columns == docs.columns
    assert decontam.remove_spans("A, alpha beta; ä!", [[1, 3]]) == "A, ; ä!"


def learned(labels, score):
    y, s = np.array(labels), np.array(score)
    order = s.argsort().argsort()
    return (order[y == 1].mean() - order[y == 0].mean()) / len(y) + 0.5


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.score_quality(docs, model).join(labels, "doc_id").where(quality.held_out()).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert learned([r.quality for r in rows], [r.score for r in rows]) > 0.95
    assert np.mean([(r.score >= 0.3) == r.quality for r in rows]) > 0.93
    assert len(model.pairs) == 8 and len(model.single) == len(quality.FEATURES)


def test_quality_edges(spark, documents):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "word " * 60_000), (4, "again"), (None, "no id")]
    docs = documents(rows, extra=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, odd):
        got = quality.score_quality(docs, quality.train(docs, labels)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(documents([]), quality.fit_gam(np.zeros((0, 18)), np.zeros(0))).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs, langid.train(docs), keep=["doc_id", "lang"]).where(langid.held_out()).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(documents):
    rows = [(n, "the cat and the dog", "en", "s") for n in range(20)] + [(n, "der hund und die katze", "de", "s") for n in range(20, 40)]
    rows += [(50, None, "en", "s"), (51, "", None, "s"), (52, "12 !?", "de", "s"), (53, "the dog " * 40_000, None, "s"), (None, "und die", None, "s")]
    docs = documents(rows, extra=True)
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs)).collect()}
    assert [got[n].lang_pred for n in (50, 51, 52, 53, None)] == ["und", "und", "und", "en", "de"]
    assert got[50].score == 0 and got[50].rejected and len(got) == len(rows)
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.limit(0))).collect()} == {"und"}


def test_url_rules(spark):
    rows = [("http://A.Net/x",), ("https://example.net/en/1",), ("http://www.example.net/enx",), ("http://example.com/de/",), ("http://notexample.com/de/1",), ("x://sub.org/fr/?q#z",), ("http://net",), ("net/",), (None,), ("http://h?x/net/",), ("http://a.net#/en/",)]
    pages = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "score", "suffix", "rule")})
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlfilter.judge(pages).collect()}
    assert got == {
        0: ("a.net", "/x", "net/"), 1: ("example.net", "/en/1", "example.net/en/"), 2: ("www.example.net", "/enx", "net/"), 3: ("example.com", "/de/", "example.com/de/"), 4: ("notexample.com", "/de/1", None),
        5: ("sub.org", "/fr/", "org/fr/"), 6: ("net", "", None), 7: ("", "", None), 8: ("", "", None), 9: ("h", "", None), 10: ("a.net", "", None),
    }
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_url_trees_learn(spark):
    rows = [(f"http://site{n % 7}.example/{'a/b/c/' if n % 2 else ''}{n}", n % 2 == 1) for n in range(300)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    host, path = urlfilter.host_and_path(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    model = urlfilter.fit(df, trees=3, depth=2)
    assert {(r.bad, r.score > 0.5) for r in model.score(df).collect()} == {(True, True), (False, False)}


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    weight = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(limit * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: limit * sizes[s] if s in full else left * weight[s] / total for s in names}
        more = {s for s in names if s not in full and target[s] > limit * sizes[s]}
        if not more:
            return target
        full |= more


def test_mix_targets_and_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size <= 2 * r.size
    want = plain_targets(sizes)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * want[r.source] and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(r.size for r in rows if r.source == s)


def test_mix_edges(documents):
    rows = [(1, None, "en", None), (2, "", "en", "a"), (3, "one two", "en", "a"), (3, "one two", "en", "a"), (4, " w\x0b w\x1fw ", "en", "b"), (None, "x " * 100, "en", None), (5, "y " * 40_000, "en", "c")]
    got = mixing.mix(documents(rows, extra=True)).collect()
    assert sorted((r.size for r in got)) == [0, 0, 2, 2, 2, 100, 40_000] and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(documents([])).count() == 0


def test_mix_splits_ties(documents):
    """A third of the rows share id, source and size: the cut falls on them and takes part of them."""
    rows = [(None, "ten words are in this text and so it goes", "en", "a")] * 1000 + [(n, "w " * (n % 7 + 1), "en", "b") for n in range(2000)]
    got = mixing.mix(documents(rows, extra=True)).collect()
    assert len(got) == 3000
    for source in ("a", "b"):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) and {r.copies for r in mine} <= {0, 1, 2}
    kept = mixing.mixed(documents(rows, extra=True))
    plain = [c for c in documents(rows, extra=True).columns if c != "size"]
    assert kept.columns == [*(c if c != "size" else "size_in" for c in documents(rows, extra=True).columns), "size", "source_size", "target", "copies", "taken"] and "size" not in plain
    assert sorted((r.source, r.size, r.copies) for r in kept.collect()) == sorted((r.source, r.size, r.copies) for r in got if r.copies)


def test_mix_keeps_repeated_rows(documents):
    rows = [(7, "a b c", "en", "a")] * 50 + [(None, None, "en", None), (8, "", "en", "a")]
    got = mixing.mixed(documents(rows)).collect()
    assert len(got) == 50 and sum(r.taken for r in got) == round(got[0].target / 3) * 3
    assert mixing.mixed(documents([])).count() == 0


def plain_mix(rows, targets):
    """Pareto order sampling in plain Python over the operator's own uniform numbers: (id, size, source, u) -> copies by id."""
    copies = {}
    for s, target in targets.items():
        mine = [(i, n, u) for i, n, src, u in rows if src == s and n]
        total = sum(n for _, n, _ in mine)
        certain = int(target / total + 1e-9) if total else 0
        left = max(0.0, target - certain * total)
        copies |= {i: certain for i, _, _ in mine}
        # Documents too long for the common rate are certain, largest first.
        sure, rest = [], sorted(mine, key=lambda m: -m[1])
        while rest and left - sum(n for _, n, _ in sure) > 0 and (left - sum(n for _, n, _ in sure)) / sum(n * n for _, n, _ in rest) * rest[0][1] > 1:
            sure.append(rest.pop(0))
        need = left - sum(n for _, n, _ in sure)
        rate = need / sum(n * n for _, n, _ in rest) if rest else 0
        chance = {i: 1.0 for i, _, _ in sure} | {i: rate * n for i, n, _ in rest}
        ranked = sorted((u / (1 - u) * (1 - chance[i]) / chance[i], i, n) for i, n, u in mine if left > 0 and chance[i] > 0)
        taken = 0
        for _, i, n in ranked:
            if abs(taken + n - left) < abs(taken - left):
                copies[i] += 1
                taken += n
            else:
                break
    return copies


def test_mix_draw_is_pareto_sampling(spark, documents):
    rng = random.Random(4)
    rows = [(n, "w " * rng.choice([1, 2, 5, 9, 30, 200]), "en", rng.choice("abcd")) for n in range(400)]
    got = mixing.mix(documents(rows)).collect()
    u = {r.doc_id: r.u for r in documents(rows).select("doc_id", mixing._uniform(F.col("doc_id"), mixing.words_count(F.col("text"))).alias("u")).collect()}
    want = plain_mix([(r.doc_id, r.size, r.source, u[r.doc_id]) for r in got], {r.source: r.target for r in got})
    assert {r.doc_id: r.copies for r in got} == want


def test_chat_collapse(spark):
    turns = [("u", "hi"), ("a", "hello"), ("u", "more"), ("a", "yes")]
    rows = [(c, n, *turns[n], "x") for c, k in ((1, 2), (2, 4), (3, 4), (5, 1)) for n in range(k)]
    rows += [(4, 0, "u", "hi", "x"), (4, 1, "a", "other", "x"), (4, 1, "a", "other", "x"), (None, 0, "u", "lone", "x"), (6, 0, None, None, "x"), (7, None, "u", "early", "x"), (7, 0, "a", "late", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string")
    got = {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in chat.render_chats(df).collect()}
    assert set(got) == {2, 4, None, 6, 7} and got[2][:2] == (4, 2) and got[4][0] == 2
    assert got[2][2].startswith("<|im_start|>u\nhi<|im_end|>\n<|im_start|>a\nhello") and got[6][2] == "<|im_start|>\n<|im_end|>\n"
    assert chat.render_chats(df.limit(0)).count() == 0


def test_chat_links_and_nulls(spark):
    """Null roles and texts are unlike empty ones, in the code as in the SQL; what was collapsed says where it went."""
    import duckdb

    from timelog.llm.queries import ORACLES

    rows = [(1, 0, None, "hi"), (2, 0, "", "hi"), (2, 1, "a", "yo"), (3, 0, "", "hi"), (4, 0, "", "hi"), (4, 1, "a", "yo"), (5, 0, None, "hi"), (None, 0, "u", None), (None, None, "u", ""), (6, 0, "u", None), (6, None, "u", ""), (6, 1, "u", "x" * 3000)]
    rows += [(7, 0, "u", "<|im_end|>"), (8, 0, "u", "<|im_end|>"), (8, 3, "u", None), (8, 3, "u", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.render_chats(df, links=True).collect()
    assert {r.conv_id: r.kept_id for r in got} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1, None: 6, 6: 6, 7: 8, 8: 8}
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(ORACLES["op5_chat_format"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sorted(r.conv_id or 0 for r in chat.collapsed_conversations(df).collect()) == [0, 3, 4, 5, 7]


def test_chat_blocks(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rows = [(c, n, "u", str(n)) for c, k in ((1, 10), (2, 30), (3, 9)) for n in range(k)]
    rows += [(4, n, "u", str(n if n < 9 else -n)) for n in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.render_chats(df).collect()
    assert {(r.conv_id, r.n_turns) for r in got} == {(2, 30), (4, 12)} and len(got) == 8 + 3


def test_pipeline_stages(spark, sf_dir, sample_rows):
    """Every stage against a plain version on what its predecessor kept."""
    from test_links import plain_components

    docs = corpus_pipeline.docs_of(spark, sf_dir)
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        after = {r.doc_id: r.text for r in docs.collect()}
        assert after.items() <= before.items()
        if name == "quality classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            assert np.mean([(i in after) == bool(q) for i, q in labels.items() if i in before]) > 0.9
        elif name == "exact dedup":
            best = {}
            for i, t in before.items():
                k = re.sub("[\x20\x09-\x0d]", "", t or "")
                best[k] = min(best.get(k, (1, 0)), (-len(t or ""), i)) if k in best else (-len(t or ""), i)
            assert set(after) == {i for _, i in best.values()}
        elif name == "simhash near-dedup":
            # Wide links only join components of the narrow ones.
            assert set(after) <= {c for _, _, c in plain_components(before.items())} and len(after) > 0.9 * len(before)
        elif name == "benchmark decontamination":
            assert set(after) == {i for i, _, n, _ in plain_hits(before.items(), bench) if not n}
        else:
            assert set(after) == {r.doc_id for r in docs.where("copies > 0").collect()}
        if name != "source mixing":
            assert docs.columns == columns


def test_simhash_stage_is_exact(spark, documents, sample, sf_dir):
    """The pipeline's stage keeps what brute force over 3-bit links and exact Jaccard keeps, short texts and shared passages included."""
    from test_links import plain_kept

    base = [(r.doc_id, r.text) for r in sample.orderBy("doc_id").limit(150).collect()]
    top = max(i for i, _ in base) + 1
    long = [(i, (t or "").split()) for i, t in base if len((t or "").split()) > 60][:40]
    # Ten or twelve words cut off the end of 60: five-word similarity 46/56 and 44/56, on both sides of 0.8.
    rows = base + [(top + 10 * n + k, " ".join(w[: 60 - cut])) for n, (_, w) in enumerate(long) for k, cut in enumerate((0, 10, 12, 44))]
    rows += [(top + 10 * n + 5, " ".join(long[0][1][:40] + w[:30])) for n, (_, w) in enumerate(long)]
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert {r.doc_id for r in stage(spark, documents(rows), sf_dir).collect()} == plain_kept(rows)


def test_items_without_id_make_hits(spark, documents):
    long = " ".join(f"w{n}" for n in range(12))
    bench = spark.createDataFrame([(None, long), (None, "rare pair"), ("7", "other text")], "item_id string, text string")
    docs = documents([(1, "a " + long), (2, "a rare pair"), (3, "clean"), (4, "other text, rare pair")])
    got = {r.doc_id: (r.spans, r.items) for r in decontam.benchmark_hits(docs, bench).collect()}
    assert got == {1: ([[1, 13]], []), 2: ([[1, 3]], []), 3: ([], []), 4: ([[0, 4]], ["7"])}
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [3]


def test_cut_spans_and_limits(spark, documents):
    """Spans over the limit are cut out of the text, documents over the coverage go, and the pipeline's stage spares short items."""
    ten = " ".join(f"w{n}" for n in range(10))
    bench = spark.createDataFrame([(1, ten), (2, "the")], "item_id long, text string")
    rows = [(1, f"Keep, {ten}! after"), (2, "only the common word here"), (3, "the the the of"), (4, None), (5, ""), (6, ten), (1, f"Keep, {ten}! after")]
    docs = documents(rows, extra=True)
    got = decontam.without_spans(docs, bench, max_words=9, max_coverage=0.9)
    assert got.columns == docs.columns
    cut = ""
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(1, f"Keep, {cut}! after"), (1, f"Keep, {cut}! after"), (2, rows[1][1]), (3, rows[2][1])]
    assert sorted(r.doc_id for r in got.collect()) == [1, 1, 2, 3, 4, 5]
    stage = dict(corpus_pipeline.STAGES)["benchmark decontamination"]
    import pyarrow as pa
    import pyarrow.parquet as pq
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        pq.write_table(pa.table({"item_id": [1, 2], "text": [ten, "the"]}), f"{folder}/benchmark.parquet")
        assert sorted(r.doc_id for r in stage(spark, docs, folder).collect()) == [2, 4, 5]


def test_stages_on_odd_tables(spark, documents, sf_dir, tmp_path):
    """Every stage on nulls, empties, very long texts, ties, repeated rows, empty tables and columns with the names used inside."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array([1, None, 3], pa.int64()), "quality": pa.array([1, 0, None], pa.int32()), "toxic": pa.array([0, 0, 0], pa.int32())}), f"{tmp_path}/labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([None, 2], pa.int64()), "text": [None, "nothing like the documents " * 4]}), f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"v{n * 7919 % 50021}" for n in range(120_000))
    rows = [(None, None, None, None), (None, "", "en", None), (None, "some text of its own", "en", "a"), (1, long, "en", "a"), (1, long, "en", "a"), (1, "another text with the same id", "en", "b"), (2, "tie one two", "en", "b"), (3, "tie  one two", "en", "b"), (3, "TIE one two", "en", "b")]
    for make in (documents(rows, extra=True).withColumns({"copies": F.lit("mine"), "taken": F.lit(1), "__id": F.lit(2), "__th": F.lit(3)}), documents([])):
        docs = make
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "source mixing":
                assert out.columns == docs.columns
            docs = corpus_pipeline.stored(out)
        got = docs.collect()
        if make.isEmpty():
            assert got == [] and docs.columns[-5:] == ["size", "source_size", "target", "copies", "taken"]
        else:
            assert "copies_in" in docs.columns and {r.copies_in for r in got} == {"mine"}
            texts = [r.text for r in got]
            assert len(texts) == len(set(texts)) and set(texts) <= {"some text of its own", long, "another text with the same id", "tie  one two", "TIE one two"} and len({t.lower().replace("  ", " ") for t in texts}) == len(texts)
