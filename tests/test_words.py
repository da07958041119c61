"""The word cutter and the learnt dictionary, against enumeration and planted text."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.words import Cutter, tokenizer
from lectern.operators import bm25, lexicon, segments

WORDS = {"知识": 40, "知识库": 30, "检索": 50, "向量": 45, "数据": 60, "数据库": 25, "大": 30, "学生": 20, "大学": 15, "生活": 12, "的": 90, "增强": 18, "生成": 22}


def enumerated(cutter, run):
    """All cuts of a run into dictionary words and unknown single characters, with their scores."""
    if not run:
        return [(0.0, [])]
    found = []
    for n in range(1, len(run) + 1):
        weight = cutter.weights.get(run[:n], cutter.unknown if n == 1 else None)
        if weight is not None:
            found += [(weight + score, [run[:n], *rest]) for score, rest in enumerated(cutter, run[n:])]
    return found


def test_best_path_is_the_best():
    cutter, draw = Cutter(WORDS), random.Random(2)
    letters = sorted({c for w in WORDS for c in w} | {"龘", "靐"})
    for _ in range(200):
        run = "".join(draw.choice(letters) for _ in range(draw.randrange(1, 9)))
        path = cutter.best_path(run)
        score = sum(cutter.weights.get(w, cutter.unknown) for w in path)
        assert "".join(path) == run and score == pytest.approx(max(s for s, _ in enumerated(cutter, run)))


def test_guess_is_the_likeliest():
    """Unknown runs: the states' path against all paths."""
    cutter, draw = Cutter(WORDS), random.Random(3)
    for _ in range(60):
        run = "".join(draw.choice("龘靐知识大学") for _ in range(draw.randrange(1, 7)))

        def cuts(rest):
            return [[]] if not rest else [[rest[:n], *more] for n in range(1, len(rest) + 1) for more in cuts(rest[n:])]

        def score(words):
            states = "".join("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E" for w in words)
            value = cutter.first[states[0]] + cutter.emits(states[0], run[0])
            return value + sum(cutter.steps[a].get(b, -math.inf) + cutter.emits(b, c) for a, b, c in zip(states, states[1:], run[1:]))

        assert score(cutter.guessed(run)) == pytest.approx(max(map(score, cuts(run))))


def test_search_mode():
    cutter = Cutter(WORDS)
    assert cutter.tokens("知识库的检索 BM25, GPT向量数据库") == ["知识", "知识库", "的", "检索", "bm25", "gpt", "向量", "数据", "数据库"]
    assert cutter.tokens("") == [] and cutter.tokens("!? 。") == [] and cutter.tokens("Ünï 12") == ["ünï", "12"]
    assert "".join(cutter.tokens("大" * 5000)) == "大" * 5000
    assert Cutter({}).tokens("知 a") == ["知", "a"]


def test_planted_chinese_is_found(spark, tmp_path):
    """A dictionary learnt from text without spaces, an index that cuts by it, and queries that find words inside runs."""
    draw = random.Random(4)
    names, glue = ["知识库", "向量检索", "大语言", "模型", "数据", "增强", "引用", "会话"], list("的和在与了是从对为用")
    sentence = lambda: "".join(draw.choice(names) + draw.choice(glue) for _ in range(draw.randrange(4, 12)))
    texts = [(i, 0, sentence() + "。" + sentence()) for i in range(300)] + [(900, 0, "今天讨论会话引用"), (901, 0, "plain words only"), (902, 0, None)]
    rows = spark.createDataFrame(texts, "document_id long, chunk_index int, content string")
    learnt = lexicon.learn(rows.select(F.col("content").alias("text")), least=20)
    assert {"知识库", "向量检索", "大语言", "模型", "数据", "增强", "引用", "会话"} <= set(learnt)
    cut, path = tokenizer(spark, Cutter(learnt)), f"file://{tmp_path}/index"
    segments.add(bm25.count_tokens(rows, cut), path)
    queries = spark.createDataFrame([(0, "引用会话"), (1, "words")], "query_id long, text string")
    found = segments.search(path, queries, 400, tokenize=cut).where("bm25_score > 0").collect()
    has = {i for i, _, t in texts if t and ("引用" in t or "会话" in t)}
    assert {r.document_id for r in found if r.query_id == 0} == has and {r.document_id for r in found if r.query_id == 1} == {901}
    assert lexicon.learn(rows.limit(0).select(F.col("content").alias("text"))) == {}
