"""Quality rules, URL filters, toxicity and search against brute force and held-out labels."""

import base64
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from lectern.llm import fertility, search, toxicity, url_templates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check_fertility(docs):
    rows = fertility.judge(docs).collect()
    expected = Counter((r.doc_id, *brute_base(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, *[r[c] for c in BASE]) for r in rows) == expected
    assert not any(r.kept and r.base_failed for r in rows)
    return rows


def test_op1(odd_docs, no_docs, small_docs):
    rows = check_fertility(small_docs)
    check_fertility(odd_docs)
    assert fertility.judge(no_docs).count() == 0 and fertility.keep(no_docs).count() == 0
    model = sentencepiece.SentencePieceProcessor(model_file=fertility.public_tokenizers.path(fertility.MODEL))
    texts = {r.doc_id: r.text for r in small_docs.collect()}
    for r in rows[:50]:
        tokens = Counter(t for w in WORD.findall(texts[r.doc_id]) for t in model.encode(w))
        n = sum(tokens.values())
        assert r.chars_per_token == pytest.approx(r.word_chars / n, abs=1e-3)
        assert r.entropy == pytest.approx(-sum(c / n * math.log2(c / n) for c in tokens.values()), abs=2e-3)
        assert r.fallback_share == pytest.approx(sum(c for t, c in tokens.items() if model.is_byte(t)) / n, abs=1e-3)
    with open(fertility.public_tokenizers.path(fertility.RANKS), "rb") as lines:
        ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=fertility.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows[:50]:
        tokens = Counter(encoding.decode_single_token_bytes(t) for w in WORD.findall(texts[r.doc_id]) for t in encoding.encode_ordinary(" " + w))
        n = sum(tokens.values())
        assert r.byte_level_chars_per_token == pytest.approx(r.word_chars / n, abs=1e-3)
        assert r.byte_level_entropy == pytest.approx(-sum(c / n * math.log2(c / n) for c in tokens.values()), abs=2e-3)
        assert r.byte_level_fallback_share == pytest.approx(sum(c for t, c in tokens.items() if len(t) == 1 and t[0] > 127) / n, abs=1e-3)


def test_op1_bands_by_brute_force(spark):
    """Every verdict, from quartiles that numpy takes of each language's length classes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    measured = fertility.stored(fertility.features(docs), "features-test")
    rows = fertility.judged(measured).collect()
    groups = {}
    for r in (r for r in rows if not r.base_failed):
        for key in ((r.grp, r.n_words.bit_length()), (r.grp, None), (None, None)):
            groups.setdefault(key, []).append(r)
    quartiles = {k: {m: np.percentile([r[m] for r in g], (25, 75)) for m in fertility.WIDTHS} for k, g in groups.items()}
    for r in rows:
        if r.base_failed:
            assert not r.kept
            continue
        steady = math.sqrt(fertility.STEADY_WORDS / r.n_words)
        key, scale = next(
            (k, s)
            for k, s in (((r.grp, r.n_words.bit_length()), 1.0), ((r.grp, None), max(1.0, steady)), ((None, None), fertility.WIDER * max(1.0, steady)))
            if k[0] is None or len(groups[k]) >= fertility.MIN_GROUP
        )
        inside, near = True, False
        for m, (below, above) in fertility.WIDTHS.items():
            low, high = quartiles[key][m]
            for end, sign, width in ((low, -1, below), (high, 1, above)):
                if width is not None:
                    room = end + sign * scale * max((high - low) * width, min(1.0, steady) * fertility.LEAST[m]) - r[m]
                    inside &= sign * room >= 0
                    near |= abs(room) < 1e-9
        assert near or r.kept == inside
    assert any(r.kept for r in rows) and any(not r.kept and not r.base_failed for r in rows)


@pytest.mark.parametrize("text", ["a" * 200_000, "\u0e01\u0e32" * 100_000, "\u200b" * 60 + " \u200b\u200d" * 60, "$" * 200_000])
def test_op1_measures_long_and_empty_words(text):
    values = fertility.Fertility().measure(text)
    assert len(values) == 6 + len(fertility.WIDTHS) and all(math.isfinite(v) for v in values)


def test_op1_planted(spark, small_docs):
    """Texts of signs, of bytes and of few words go; the clean texts that pass the base rules stay."""
    clean = small_docs.join(spark.read.parquet("/root/testdata/sf0.001/labels.parquet").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", "lang")
    words = " ".join(f"wo{i:x}rd" for i in range(200))
    junk = [(10_001, " ".join(f"w{i}$$$###@@~" for i in range(200)), "en"), (10_002, " ".join("ꙮꙭꙬ"[i % 3] * (i + 1) for i in range(120)), "en"), (10_003, " ".join("ab"[i % 2] + "c" * (i // 2 % 7) for i in range(400)), "en")]
    rows = {r.doc_id: r for r in fertility.judge(clean.union(spark.createDataFrame(junk, clean.schema))).collect()}
    assert not any(rows[d].kept for d, _, _ in junk), words
    passed = [r for d, r in rows.items() if d < 10_000 and not r.base_failed]
    assert sum(r.kept for r in passed) >= 0.97 * len(passed)
    kept = fertility.keep(clean)
    assert kept.columns == clean.columns and kept.count() == sum(r.kept for d, r in {r.doc_id: r for r in fertility.judge(clean).collect()}.items())


def test_op1_rejects_labelled_junk(spark):
    """Most labelled junk that passes the base rules goes, long texts above all, and few good documents do."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    rows = fertility.judge(spark.read.parquet(f"{folder}/documents.parquet")).where("not base_failed").join(labels, "doc_id").collect()
    bad, good = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1]
    long = [r for r in bad if r.n_words >= 300]
    print(sum(not r.kept for r in bad), len(bad), sum(not r.kept for r in long), len(long), sum(not r.kept for r in good), len(good))
    assert sum(r.kept for r in bad) <= 0.1 * len(bad) and sum(r.kept for r in long) <= 0.15 * len(long)
    assert sum(not r.kept for r in good) <= 0.01 * len(good)


def test_repeat_words_with_many_kinds():
    ids = fertility.np.r_[fertility.np.arange(1 << 20), fertility.np.arange(3)]
    assert fertility.repeat_words(ids) == 6


def test_op8_sql(spark):
    connection = duckdb.connect()
    for name in ("pages", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.01/{name}.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict", "template", "bad_share"]
    expected = Counter(connection.execute(f"SELECT {', '.join(columns)} FROM ({url_templates.OP8_SQL})").fetchall())
    assert Counter(map(tuple, url_templates.op8_url_templates(spark, "/root/testdata/sf0.01").select(columns).collect())) == expected


def test_op8_odd(spark, labels):
    urls = [
        None, "", "no scheme", "http://A.Example.ORG/es/1?x", "http://example.org/en/17", "HTTP://notexample.org/es/1", "http://x.com/fr/a#b", "http://x.com/de/", "http://org",
        "http://example.com:80/fr/1", "x://y://z/a", "http://h.net" + "/a1" * 3000, "http://h.net/é\n/b", "http://h.net/a?b=http://c", "http://h.net/a?b=http://c",
    ]
    pages = spark.createDataFrame([(i, u, "<html>", "shadow") for i, u in enumerate(urls)], "page_id long, url string, html string, template string")
    rows = {r.page_id: r for r in url_templates.judge(pages, labels).collect()}
    found = [(rows[i].host, rows[i].path[:12], rows[i].rule) for i in range(len(urls))]
    assert found == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/17", "example.org/en/1"), ("notexample.org", "/es/1", "org/"),
        ("x.com", "/fr/a", "com/fr/"), ("x.com", "/de/", "com/de/"), ("org", "", None), ("example.com:80", "/fr/1", None), ("y:", "//z/a", None),
        ("h.net", "/a1/a1/a1/a1", None), ("h.net", "/é\n/b", None), ("h.net", "/a", None), ("h.net", "/a", None),
    ]
    assert url_templates.judge(pages.limit(0), labels).count() == 0
    assert url_templates.judge(pages, labels.limit(0)).count() == len(urls)


def test_op8_purity(spark):
    """A branch full of bad pages is blocked, its clean siblings are not."""
    rows = [(i, f"http://h.net/{'spam' if i % 2 else 'news'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    found = url_templates.judge(pages, labels)
    assert {(r.template, r.verdict) for r in found.collect()} == {("h.net/spam/**", "block"), ("h.net/news/**", "allow")}


def test_op8_small_branch_of_large_host(spark):
    """A bad directory is blocked whatever the size of its host, and however many branches share it evenly."""
    spam = [(i, f"http://h.net/spam/{i}") for i in range(90)]
    labels = spark.createDataFrame([(i, int(i >= 90), 0) for i in range(12_000)], "doc_id long, quality int, toxic int")
    for n in (200, 10_000):
        pages = spark.createDataFrame(spam + [(i, f"http://h.net/news/{i}") for i in range(90, n)], "page_id long, url string")
        found = url_templates.judge(pages, labels).groupBy("template", "verdict").count().collect()
        assert {tuple(r) for r in found} == {("h.net/spam/**", "block", 90), ("h.net/news/**", "allow", n - 90)}
    name = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i % 240:03}")
    pages = spark.createDataFrame([(i, f"http://even.net/{name(i)}/{i}") for i in range(7200)], "page_id long, url string")
    even = spark.createDataFrame([(i, int(i % 240 >= 24), 0) for i in range(7200)], "doc_id long, quality int, toxic int")
    found = url_templates.judge(pages, even).where("verdict = 'block'").select("page_id").collect()
    assert {r.page_id for r in found} == {i for i in range(7200) if i % 240 < 24}


def test_op8_deep_branch(spark):
    """A bad branch far below the host is blocked, its clean siblings are not, and pure rests share one template."""
    rows = [(i, f"http://h.net/a/b/c/d/e/{'spam' if i % 2 else 'news'}/{'x/' * (i % 3)}{i}") for i in range(400)]
    pages = spark.createDataFrame(rows + [(i, f"http://g.net/a/b/c/d/e/f/{i}") for i in range(1000, 1040)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(400)] + [(i, 1, 0) for i in range(1000, 1040)], "doc_id long, quality int, toxic int")
    found = {r.page_id: r for r in url_templates.judge(pages, labels).collect()}
    assert len(found) == 440
    assert all(found[i].verdict == ("block" if i % 2 else "allow") for i in range(400))
    assert {found[i].template for i in range(1000, 1040)} == {"g.net/**"}
    assert {found[i].template for i in range(400)} == {"h.net/*/*/*/*/*/spam/**", "h.net/*/*/*/*/*/news/**"}


def test_op8_depth_changes_nothing(spark):
    """The same pages some levels deeper get the same verdicts, few as they are or many."""
    for n in (8, 60):
        labels = spark.createDataFrame([(i, int(i >= n), 0) for i in range(2 * n)], "doc_id long, quality int, toxic int")
        found = []
        for deep in ("", "/x/y", "/x/y/z/u/v/w"):
            pages = spark.createDataFrame([(i, f"http://h.net{deep}/a/b/{'' if i < n else 'c/'}{i}") for i in range(2 * n)], "page_id long, url string")
            found.append({r.page_id: r.verdict for r in url_templates.judge(pages, labels).collect()})
        assert found[0] == found[1] == found[2]
        assert n == 8 or all(v == ("block" if i < n else "allow") for i, v in found[0].items())


def test_op8_deeper_than_the_sql(spark):
    """The SQL follows nine levels, the operator any number: a bad branch below them is told apart by the operator alone."""
    pages = spark.createDataFrame([(i, f"http://h.net{'/d' * 12}/{'spam' if i % 2 else 'news'}/{i}") for i in range(400)], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    assert {r.verdict for r in url_templates.judge(pages, labels).where("page_id % 2 = 1").collect()} == {"block"}
    connection = duckdb.connect()
    connection.register("pages", pages.toPandas())
    connection.register("labels", labels.toPandas())
    assert {t for (t,) in connection.execute(f"SELECT DISTINCT template FROM ({url_templates.OP8_SQL})").fetchall()} == {"h.net" + "/*" * (url_templates.SQL_DEPTH - 1) + "/**"}


def test_op8_long_numbers(spark):
    """Numbers up to 64 bits name a document; larger ones, and those in the middle of a path, name none."""
    big = (1 << 63) - 1
    pages = spark.createDataFrame([(i, f"http://h.net/{'a' if i < 30 else 'b'}/{big - i if i < 60 else str(big + i)}") for i in range(90)], "page_id long, url string")
    labels = spark.createDataFrame([(big - i, int(i >= 30), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = url_templates.judge(pages, labels).collect()
    assert {(r.page_id < 30, r.verdict) for r in rows} == {(True, "block"), (False, "allow")}


def test_op8_hot_keys(spark, monkeypatch):
    """One host, one number and pages without numbers hold most rows; with hot keys broadcast the rows are the same."""
    from lectern.llm import common

    rows = [(i, f"http://h.net/{'spam' if i % 2 else 'news'}/{i if i % 3 else 7}") for i in range(900)] + [(1000 + i, "http://h.net/none/x") for i in range(500)] + [(2000 + i, f"http://k{i}.net/{i}") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(900)], "doc_id long, quality int, toxic int")
    expected = sorted(map(repr, url_templates.judge(pages, labels).collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert sorted(map(repr, url_templates.judge(pages, labels).collect())) == expected and len(expected) == 1450


def same_as_sql(pages, labels):
    connection = duckdb.connect()
    connection.register("pages", pages.toPandas())
    connection.register("labels", labels.toPandas())
    columns = ["page_id", "host", "path", "rule", "verdict", "template", "bad_share"]
    expected = Counter(connection.execute(f"SELECT {', '.join(columns)} FROM ({url_templates.OP8_SQL})").fetchall())
    rows = url_templates.judge(pages, labels).select(columns).collect()
    assert Counter(map(tuple, rows)) == expected
    return rows


def test_op8_rests_are_judged_by_length(spark):
    """Below a node where no branch can stay, pages of other lengths have shares of their own, at every depth and as the SQL says."""
    labels = spark.createDataFrame([(i, int(i >= 8), 0) for i in range(16)], "doc_id long, quality int, toxic int")
    for deep in ("", "/x/y", "/x/y/z/u/v/w"):
        pages = spark.createDataFrame([(i, f"http://h.net{deep}/a/b/{'' if i < 8 else 'c/'}{i}") for i in range(16)] + [(16, "http://h.net"), (17, "http://h.net/")], "page_id long, url string")
        found = {r.page_id: r for r in same_as_sql(pages, labels)}
        assert all(found[i].verdict == ("block" if i < 8 else "allow") for i in range(16))
        assert found[0].bad_share == round((8 + 10 * 0.5) / 18, 6) and found[8].bad_share == round(10 * 0.5 / 18, 6)
        rests = {r.page_id: r.rest for r in url_templates.judge(pages, labels).collect()}
        assert [rests[i] for i in (0, 8, 16, 17)] == [3 + deep.count("/"), 4 + deep.count("/"), 0, 1]


def test_op8_sql_on_planted_branches(spark):
    """Bad, good and mixed directories at several depths, where templates do differ, against the SQL."""
    draw = random.Random(11)
    shares = {"spam": 0.95, "junk": 0.9, "ads": 0.5, "news": 0.02, "blog": 0.04, "shop": 0.3}
    rows, labels = [], []
    for i in range(4000):
        kinds = draw.choices(list(shares), k=2)
        deep = "/".join(draw.choice(["a", "b"]) for _ in range(draw.choice([0, 0, 1, 3, 4])))
        rows.append((i, f"http://{draw.choice(['h', 'g'])}.net/{kinds[0]}/{deep + '/' if deep else ''}{kinds[1] if draw.random() < 0.3 else draw.randrange(99)}/{i}"))
        labels.append((i, int(draw.random() >= shares[kinds[0]]), 0))
    found = same_as_sql(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len({r.template for r in found}) > 12 and {r.verdict for r in found} == {"block", "allow"}


def test_op8_merges_like_branches(spark):
    """Bad directories that do not differ from one another become one branch; so do good ones; one that differs from both stays."""
    names = {"spam": 1.0, "junk": 1.0, "ads": 0.55, "news": 0.0, "blog": 0.0}
    rows = [(i, f"http://h.net/{list(names)[i % 5]}/{i}") for i in range(2000)]
    labels = [(i, int((i // 5 % 20) / 20 >= list(names.values())[i % 5]), 0) for i in range(2000)]
    found = same_as_sql(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    by_name = {n: {r.template for r in found if r.path.startswith(f"/{n}/")} for n in names}
    assert by_name["spam"] == by_name["junk"] == {"h.net/{+}/**"} and by_name["news"] == by_name["blog"] == {"h.net/{-}/**"}
    assert by_name["ads"] not in (by_name["spam"], by_name["news"])


def test_op8_long_numbers(spark):
    """A number of more than 18 digits names no document, not the one of its last 18 digits."""
    rows = [(1, "http://h.net/a/9000000000000000007"), (2, "http://h.net/a/7"), (3, "http://h.net/a/x000000000000000007z/")]
    labels = spark.createDataFrame([(7, 0, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    found = {r.page_id: r for r in same_as_sql(spark.createDataFrame(rows, "page_id long, url string"), labels)}
    assert found[1].bad_share == round((2 + 10) / (2 + 10), 6)
    assert len(found) == 3


def test_op9_newton_steps_reach_the_optimum():
    """The squared-hinge machine and the curve stop where no weight can be changed for the better."""
    import numpy as np

    draw = np.random.default_rng(2)
    x, weight = draw.normal(size=(200, 6)), draw.uniform(0.2, 2, 200)
    y = np.sign(x[:, 0] + 0.5 * draw.normal(size=200))
    w, b = toxicity._svm(x, y, weight, 3.0)
    lost = lambda v: (v[:-1] @ v[:-1] + 1e-3 * v[-1] ** 2) / 2 + 1.5 * (weight * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()
    best = np.r_[w, b]
    assert all(lost(best) <= lost(best + step) + 1e-9 for step in draw.normal(size=(300, 7)) * 0.01)


def test_op9_nystrom_features_are_the_kernel():
    """Inner products of the landmarks' own features give their kernel back, and weights collapse to the same margins."""
    import numpy as np

    words = ["idiot", "moron", "scum", "river", "stone"]
    columns = {k: i for i, k in enumerate(sorted({k for w in words for k in toxicity.subsequences(w)}))}
    marks = toxicity._features(words, columns)
    values, vectors = np.linalg.eigh(marks @ marks.T)
    made = marks @ marks.T @ (vectors / np.sqrt(values))
    assert np.allclose(made @ made.T, [[toxicity.kernel(a, b) for b in words] for a in words])


def test_op9_sample_takes_one_row_of_a_doc_id(spark):
    docs = spark.createDataFrame([(i % 40, f"text number {i} of many") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(40)], "doc_id long, toxic int")
    rows = toxicity.sample(docs, labels, 10, 12)
    assert len(rows) == 22 and sum(t for _, t in rows) == 10 and all(isinstance(w, dict) and w["text"] == 1 for w, _ in rows)
    assert rows == toxicity.sample(docs.repartition(7), labels, 10, 12)


def test_kernel_by_enumeration():
    """Against all subsequences of three characters, each by its spread."""
    from itertools import combinations

    def vector(word):
        word, found = toxicity.MARK + word, Counter()
        for picks in combinations(range(len(word)), 3):
            if (spread := picks[-1] - picks[0]) < toxicity.SPREAD:
                found["".join(word[i] for i in picks)] += toxicity.DECAY ** (spread + 1)
        return found

    def size(n):
        return math.sqrt(sum(toxicity.DECAY ** (2 * (p[-1] - p[0] + 1)) for p in combinations(range(n + 1), 3) if p[-1] - p[0] < toxicity.SPREAD))

    for a, b in (("idiot", "idiot"), ("idiot", "idxiot"), ("moron", "mornings"), ("abc", "xyz")):
        x, y = vector(a), vector(b)
        assert toxicity.kernel(a, b) == pytest.approx(sum(v * y[k] for k, v in x.items()) / size(len(a)) / size(len(b)))


def test_collapsed_weights_are_the_kernel_expansion():
    machine = toxicity.Machine({k: v for k, v in toxicity.subsequences("idiot").items()}, 0.0, (1, 0, 0))
    for word in ("idiot", "id1iot", "clown", "idiots" * 6):
        parts = [word[i : i + toxicity.PART] for i in range(0, max(1, len(word) - toxicity.PART // 2), toxicity.PART // 2)] if len(word) > toxicity.PART else [word]
        assert machine.margin(word) == pytest.approx(max(toxicity.kernel("idiot", p) for p in parts))


def test_op9_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.where("toxic = 1 or doc_id % 3 = 0").select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.scores(some, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good, bad = [r.score for r in rows if not r.toxic], [r.score for r in rows if r.toxic]
    assert sum(b > g for b in bad for g in good) / len(good) / len(bad) > 0.9
    assert sum(s >= 0.5 for s in good) <= 0.1 * len(good)


def test_op9_few_labels():
    """A few dozen toxic texts of ordinary length are enough to find the words that make them so."""
    connection = duckdb.connect()
    folder = "/root/testdata/sf0.01"
    rows = connection.execute(f"SELECT doc_id, text, toxic FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    rows = [r for r in rows if not brute_base(r[1])[-1]]  # as the pipeline's first stage leaves them
    machine = toxicity.fit([(text, toxic) for doc_id, text, toxic in rows if zlib.crc32(str(doc_id).encode()) % 5])
    margins = toxicity.Memo(lambda word: machine.margin(toxicity.normal(word)))
    found = [(machine.score(text, margins) >= 0.5, toxic) for _, text, toxic in rows]
    bad, good = [f for f, toxic in found if toxic], [f for f, toxic in found if not toxic]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.05 * len(good)


def brute_score(machine, text):
    """A text's score by the definition: every subsequence of every part of every word, no tree and no memo."""
    from itertools import combinations

    found, words, run = (text or "").split(), [], ""
    for word in [*found, ""]:
        if len(word) == 1 and word.isalpha():
            run += word
        else:
            words += [run] if len(run) > 2 else []
            run = ""
    margins = []
    for word in [*found, *words]:
        word = "".join(c for c in word.lower() if c.isalnum())
        if len(word) < 3:
            margins.append(-1.0)
            continue
        own = [word[at : at + 24] for at in range(0, len(word) - 12, 12)] if len(word) > 24 else [word]
        values = []
        for part in own:
            part, total, size = "^" + part, 0.0, 0.0
            for p in combinations(range(len(part)), 3):
                spread = p[-1] - p[0] + 1
                if spread <= toxicity.SPREAD:
                    total += machine.weights.get("".join(part[i] for i in p), 0.0) * 0.6**spread
                    size += 0.6 ** (2 * spread)
            values.append(total / math.sqrt(size) + machine.offset)
        margins.append(max(values))
    top = sorted([min(1.0, max(-0.5, m)) for m in margins] + [-0.5, -0.5])[-2:]
    a, b, c = machine.curve
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, a * top[1] + b * top[0] + c))))


def test_op9_scores_by_definition(small_docs, odd_docs, labels):
    """Whole texts, end to end: fitted on labelled ones, scored as the operator does and by enumeration."""
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = small_docs.collect()
    machine = toxicity.fit([(r.text, toxic[r.doc_id]) for r in rows if r.doc_id in toxic])
    assert machine.weights
    margins = toxicity.Memo(lambda word: machine.margin(toxicity.normal(word)))
    texts = [r.text for r in rows[:40]] + [r.text if r.text is None or len(r.text) < 60_000 else r.text[:2000] for r in odd_docs.collect()]
    for text in texts:
        assert machine.score(text, margins) == pytest.approx(brute_score(machine, text), abs=1e-9)


def test_op9_how_gaps_weaken():
    """The kernel of an insult with itself when letters are put in: what the docstring says."""
    whole = toxicity.kernel("idiot", "idiot")
    every = [toxicity.kernel("idiot", ("x" * n).join("idiot")) / whole for n in range(4)]
    assert every[0] == 1 and 0.1 < every[1] < 0.2 and 0.01 < every[2] < 0.04 and every[3] == 0
    assert 0.2 < toxicity.kernel("idiot", "idixxxot") / whole < 0.3


def test_op9_insults_with_gaps(spark):
    insults = ["idiot", "moron", "pathetic", "scum"]
    words = [w * 2 + "a" for w in ("the", "and", "house", "garden", "river", "stone", "table", "window", "road", "light")]
    rows = []
    for i in range(400):
        text = " ".join(words[(i * k + k) % 10] for k in range(1, 30))
        rows.append((i, f"{text} {insults[i % 4]} you {insults[(i + 1) % 4]} {text}" if i % 5 == 0 else text, int(i % 5 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, "river stone i.d.i.o.t table s c u m road"), (1001, "river stone idxiot and patheetic road"), (1002, "river stone road")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    found = {r.doc_id: r.score for r in toxicity.scores(docs, labels).collect()}
    assert found[1000] > 0.5 and found[1001] > found[1002] and found[1002] < 0.5
    assert all((found[i] >= 0.5) == bool(t) for i, _, t in rows)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, s in found.items() if s < 0.5}


def test_op9_texts_without_spaces():
    """What makes a text toxic is learnt wherever it stands in a run of letters without spaces."""
    draw = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 400)]
    insults = ["臭傻货笨蛋", "滚开废物垃圾"]

    def text(toxic):
        start = "".join(draw.choices(letters, k=draw.randrange(30, 120)))
        return start + (draw.choice(insults) if toxic else "") + "".join(draw.choices(letters, k=draw.randrange(0, 60)))

    rows = [(text(i % 3 == 0), int(i % 3 == 0)) for i in range(450)]
    machine = toxicity.fit(rows[:300])
    margins = toxicity.Memo(lambda word: machine.margin(toxicity.normal(word)))
    found = [(machine.score(t, margins) >= 0.5, toxic) for t, toxic in rows[300:]]
    bad, good = [f for f, toxic in found if toxic], [f for f, toxic in found if not toxic]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.05 * len(good)


def test_op9_odd(spark, odd_docs, no_docs, labels):
    rows = toxicity.scores(odd_docs, labels).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd_docs.collect())
    assert all(0 <= r.score <= 1 for r in rows)
    empty = {r.doc_id: r.score for r in rows}
    assert empty[1] == empty[2] == empty[3] < 0.5
    assert toxicity.scores(no_docs, labels).count() == 0
    assert {r.score for r in toxicity.scores(odd_docs, labels.limit(0)).collect()} == {0.0} or all(r.score < 1e-9 for r in toxicity.scores(odd_docs, labels.limit(0)).collect())


def test_op2_sql(spark):
    connection = duckdb.connect()
    connection.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    expected = sorted(connection.execute(search.OP2_SQL).fetchall())
    assert sorted(map(tuple, search.op2_search(spark, "/root/testdata/sf0.01").collect())) == expected


def test_op2_shards_and_blocks_agree(spark, small_docs):
    queries = small_docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    whole = sorted(map(tuple, search.search(small_docs, queries, 7).collect()))
    parts = sorted(map(tuple, search.search(small_docs.repartition(5), queries, 7, shard_bytes=20_000, query_bytes=9_000).collect()))
    assert parts == whole


def test_op2_prunes(spark):
    """Fewer postings are scored than all documents would need, far fewer for short queries, and the hits are the same."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    short = whole.select("query_id", F.array_join(F.slice(F.split("text", " "), 5, 6), " ").alias("text"))
    shares = []
    for queries in (whole, short):
        counts = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
        found = sorted(map(tuple, search.search(docs, queries, 3, counts=counts).collect()))
        assert found == sorted(map(tuple, search.search(docs.repartition(3), queries, 3, shard_bytes=100_000).collect()))
        shares.append(counts[0].value / counts[1].value)
    assert shares[0] < 0.8 and shares[1] < 0.3


def test_op2_copies_of_queries(spark):
    """Queries of one text are searched once, and each leaves out its own documents only."""
    draw = random.Random(3)
    texts = ["some words of a text"] * 40 + [" ".join(draw.choices("abcdefghij", k=draw.randrange(12))) for _ in range(200)]
    docs = spark.createDataFrame([(i % 230 if i > 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    queries = docs.where("doc_id is not null").select(F.col("doc_id").alias("query_id"), "text")
    words, asked = {}, []
    for r in queries.collect():
        words.setdefault(r.query_id, []).extend(r.text.split())
    for some in ("query_id = 20", "query_id between 10 and 39"):
        counts = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))
        search.search(docs, queries.where(some), 5, counts=counts).collect()
        asked.append(counts[1].value)
    assert asked[0] == asked[1] > 0
    rows = [(r.doc_id, Counter((r.text or "").split())) for r in docs.collect()]
    mean, df = sum(sum(c.values()) for _, c in rows) / len(rows), Counter(w for _, c in rows for w in c)
    expected = []
    for q, own in words.items():
        scores = []
        for d, c in rows:
            parts = [t * math.log(1 + (len(rows) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w, t in Counter(own).items() if c[w]]
            scores += [(-round(sum(parts), 6), d is not None, d or 0)] if parts and d != q else []
        expected += [(q, rank, d if known else None, -score) for rank, (score, known, d) in enumerate(sorted(scores)[:5], 1)]
    for shard_bytes in (search.SHARD_BYTES, 4_000):
        found = search.search(docs, queries, 5, shard_bytes=shard_bytes).collect()
        assert [(r.query_id, r.rank, r.doc_id) for r in sorted(found)] == [e[:3] for e in sorted(expected)]


def test_op2_odd(spark, odd_docs, no_docs):
    queries = spark.createDataFrame([(100, "one two three four"), (101, ""), (102, None), (103, "nowhere-found"), (11, "same row"), (None, "one")], "query_id long, text string")
    rows = search.search(odd_docs, queries, 3).collect()
    assert [(r.rank, r.doc_id) for r in sorted(rows, key=lambda r: (r.query_id, r.rank)) if r.query_id == 100] == [(1, 9), (2, 10), (3, 5)]
    assert {r.query_id for r in rows} == {100}
    assert search.search(no_docs, queries, 3).count() == 0 and search.search(odd_docs, queries.limit(0), 3).count() == 0
