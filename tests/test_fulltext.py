"""Keyword and substring scores against SQLite's own index."""

from __future__ import annotations

import random
import sqlite3
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import best, fulltext


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(0)
    words = ["alpha", "beta", "gamma", "delta", "naïve", "café", "x1", "banana", "ananas", "foo_bar", "don't", "über"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(1, 41)]


def sqlite_index(corpus, tokenizer):
    con = sqlite3.connect(":memory:")
    con.execute(f"create virtual table t using fts5(body, tokenize='{tokenizer}')")
    con.executemany("insert into t(rowid, body) values (?, ?)", corpus)
    return con


def test_bm25_equals_sqlite(spark, corpus):
    con = sqlite_index(corpus, "unicode61")
    chunks = spark.createDataFrame(corpus, "chunk_id long, text string")
    asked = {1: "alpha beta", 2: "cafe naive", 3: "x1 alpha alpha", 4: "zzz"}
    got = fulltext.bm25_topk(fulltext.build_index(chunks), spark.createDataFrame(list(asked.items()), "query_id long, question string"), 100).collect()
    for q, text in asked.items():
        match = " OR ".join(f'"{w}"' for w in text.split())
        want = {i: round(-s, 5) for i, s in con.execute("select rowid, rank from t where t match ?", (match,))}
        assert {r.chunk_id: round(r.score, 5) for r in got if r.query_id == q} == pytest.approx(want, abs=2e-5)


def test_phrases_equal_sqlite(spark, corpus):
    con = sqlite_index(corpus, "unicode61")
    chunks = spark.createDataFrame(corpus, "chunk_id long, text string")
    phrases = [(1, 0, "foo_bar"), (2, 0, "alpha beta"), (3, 0, "don't"), (4, 0, "!!")]
    got = fulltext.phrase_topk(chunks, fulltext.build_index(chunks), spark.createDataFrame(phrases, "query_id long, phrase_id int, phrase string"), 100).collect()
    for q, _, p in phrases[:3]:
        want = {i: -s for i, s in con.execute("select rowid, rank from t where t match ?", (f'"{p}"',))}
        assert {r.chunk_id: r.score for r in got if r.query_id == q} == pytest.approx(want, abs=2e-5)
    assert not [r for r in got if r.query_id == 4]


def test_phrases_are_looked_for_where_the_texts_are(spark):
    """What is shuffled are a chunk's phrases, not its places times the places of all phrases."""
    rng = random.Random(3)
    texts = [(i % 25, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))) for i in range(30)]
    chunks = spark.createDataFrame([*texts, (98, None), (99, "")], "chunk_id int, text string").repartition(3)
    phrases = sorted({tuple(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(40)})
    df = fulltext.phrase_counts(chunks, phrases)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for c, text in texts:
        words = text.split()
        for p, phrase in enumerate(phrases):
            n = sum(tuple(words[i : i + len(phrase)]) == phrase for i in range(len(words)))
            if n:
                want[c, p] = want.get((c, p), 0) + n
    assert {(r.chunk_id, r.number): r.tf for r in df.collect()} == want
    # A phrase that a question repeats counts as often, however it is written.
    asked = [(1, 0, "A b"), (1, 1, "a-b"), (2, 0, "a b"), (3, 0, "?"), (4, 0, "e e e e e")]
    index = fulltext.build_index(chunks)
    got = {}
    for r in fulltext.phrase_topk(chunks, index, spark.createDataFrame(asked, "query_id long, phrase_id int, phrase string"), 100).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.score
    assert set(got) == {1, 2} and got[1] == pytest.approx({c: 2 * s for c, s in got[2].items()}, abs=2e-5)


@pytest.mark.parametrize("question", ["nana", "ana", "ALPHA beta", "café", "cafe", "is alpha", "qu", "alpha OR über", "a-b", "beta, alpha?",
    "alpha AND beta", "alpha NOT beta", '"alpha beta"', '"pha be"', "alp*", '"alp" * beta', "alpha AND", "NOT alpha", "alpha alpha", "is NOT alpha", "alpha NOT is", "is AND alpha", "alpha AND is", "is OR alpha", "beta OR is NOT gamma", "beta AND al NOT gamma", '"say ""alpha"" "', "alpha beta NOT gamma delta OR über",
    "alpha AND beta NOT gamma AND delta", "alpha NOT beta NOT gamma", "beta OR alpha AND gamma NOT delta", '"a OR b" OR alpha', "alphaOR beta", "and or alpha", "", "al", '"unfinished'])
def test_substrings_equal_sqlite(spark, corpus, question):
    con = sqlite_index(corpus, "trigram")
    chunks = spark.createDataFrame(corpus, "chunk_id long, text string")
    got = fulltext.trigram_topk(chunks, spark.createDataFrame([(1, question)], "query_id long, question string"), 100).collect()
    try:
        want = {i: -s for i, s in con.execute("select rowid, rank from t where t match ?", (question,))}
    except sqlite3.OperationalError:
        want = {}
    assert {r.chunk_id: r.score for r in got} == pytest.approx(want, abs=2e-5)


BRACKETS = ["(alpha OR beta) NOT gamma", "(alpha OR beta) AND (gamma OR delta)", "((alpha))", "()", "(alpha", "alpha)", "(alpha) beta", "alpha (beta)", "alpha NOT (beta OR (gamma AND delta))", "alpha NOT (beta NOT gamma)",
    "(alpha NOT beta) NOT gamma", "alpha NOT (al)", "(al) AND alpha", "(al beta)", "(al) OR alpha", "(alpha OR (banana AND x1)) AND gamma", "NEAR alpha", "NEAR(alpha beta)", "NEAR(alpha beta, 0)", "NEAR(alpha beta gamma, 12)",
    "NEAR(alpha al)", "NEAR(al be)", "NEAR(alpha)", "NEAR(alpha* beta , 5) AND gamma", "NEAR(alpha beta,)", "NEAR(alpha beta, x)", "NEAR(alpha beta, -1)", "near(alpha beta)", "NEAR (ana nana, 3)", "NEAR(ana ana, 2)", "gamma NOT NEAR(alpha beta, 3)",
    'NEAR("alpha beta" gamma, 20) OR delta', "^alpha", "^ alpha", "alpha ^beta", "alpha AND ^beta", "NEAR(^alpha beta)", '"alp" + "lph"', "alp + pha", 'NEAR("alp" + "lph" beta)', "alpha + ^beta", '^"alpha beta" OR gamma', '^"alp" + lpha', "alpha, beta", "al + alpha", "title: alpha"]


def test_brackets_and_near_equal_sqlite(spark, corpus):
    con = sqlite_index(corpus, "trigram")
    rng, words = random.Random(7), ["alpha", "beta", "gamma", "nana", "delta", "caf", "al", "der"]

    def random_tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice([rng.choice(words), rng.choice(words) + " " + rng.choice(words), f"NEAR({rng.choice(words)} {rng.choice(words)} {rng.choice(words)}, {rng.randint(0, 40)})", "^" + rng.choice(words)])
        return f"({random_tree(depth - 1)}) {rng.choice(['AND', 'OR', 'NOT'])} ({random_tree(depth - 1)})"

    asked = dict(enumerate([*BRACKETS, *(random_tree(rng.randint(1, 3)) for _ in range(150))]))
    found = fulltext.trigram_topk(spark.createDataFrame(corpus, "chunk_id long, text string"), spark.createDataFrame(list(asked.items()), "query_id long, question string"), 100).collect()
    got = {q: {} for q in asked}
    for r in found:
        got[r.query_id][r.chunk_id] = r.score
    for q, question in asked.items():
        try:
            want = {i: -s for i, s in con.execute("select rowid, rank from t where t match ?", (question,))}
        except sqlite3.OperationalError:
            want = {}
        assert got[q] == pytest.approx(want, abs=2e-5), question


def test_places_near_each_other_are_counted_in_one_sweep():
    """Two common words in a long text: a window of places moves on, it is not looked up among all of them anew."""
    from tidemark.functions.expressions import near_counts

    began, n = time.process_time(), 40_000
    assert near_counts([list(range(0, 8 * n, 8)), list(range(5, 8 * n, 8))], [2, 2], 10) == [n, n]
    assert time.process_time() - began < 5
    assert near_counts([[0, 50, 51], [10, 90]], [3, 3], 7) == [1, 1]


def test_texts_are_searched_once(spark, corpus):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    chunks = spark.createDataFrame(corpus, "chunk_id long, text string").withColumn("text", told.asNondeterministic()("text"))
    asked = spark.createDataFrame([(1, "NEAR(alpha beta, 30)"), (2, "nana OR delta")], "query_id long, question string")
    assert fulltext.trigram_topk(chunks, asked, stats=spark.createDataFrame([(40, 50.0)], "n_chunks long, avgchars double")).count()
    assert seen.value <= len(corpus)


def test_kept_trigrams_change_nothing(spark, corpus):
    chunks = spark.createDataFrame([*corpus, (900, None), (901, ""), (902, "ab")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "nana OR gam"), (2, "alpha NOT beta"), (3, "zzz OR delta"), (4, "qqqq"), (5, None)], "query_id long, question string")
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(fulltext.trigram_topk(chunks, asked))
    assert want and key(fulltext.trigram_topk(chunks, asked, grams=fulltext.trigram_postings(chunks))) == want


def test_a_task_keeps_little_on_the_way(monkeypatch):
    assert best.CELLS <= 1 << 19
    monkeypatch.setattr(best, "CELLS", 30)
    rng = np.random.default_rng(4)
    every, kept, most = [], best.Best(3), 0
    asked = np.array([7, 3, 11, 2])
    for at in range(0, 4000, 8):
        some = slice(None) if at % 3 else slice(0, 2)
        scores, ids = rng.integers(-1, 6, (8, 4))[:, some].astype(float), np.arange(at, at + 8)
        scores[scores < 0] = best.NONE
        kept.add(scores, ids, asked[some])
        every += [(q, -s, c) for j, q in enumerate(asked[some]) for s, c in zip(scores[:, j], ids) if s > best.NONE]
        most = max(most, sum(len(p[0]) for p in kept.parts))
    (q, c, s), *rest = kept.rows()
    want = [r for q in sorted(asked) for r in sorted(e for e in every if e[0] == q)[:3]]
    assert not rest and list(zip(q, -s, c)) == want and most <= 30 + 8 * 4


def test_many_questions_take_several_passes(spark, corpus, monkeypatch):
    chunks = spark.createDataFrame(corpus, "chunk_id long, text string").repartition(3)
    asked = ["nana OR gam", "alpha NOT beta", "ananas", "a b", "zzz", "alpha beta OR über gamma", "naïve NOT alpha beta NOT gamma", "banana"]
    df = spark.createDataFrame(list(enumerate(asked)), "query_id long, question string")
    key = lambda d: sorted(map(tuple, d.collect()))
    every, few = key(fulltext.trigram_topk(chunks, df, 100)), key(fulltext.trigram_topk(chunks, df, 3))
    assert few == [r for r in every if r[-1] < 3] and len({r[0] for r in every}) > 4
    monkeypatch.setattr(fulltext, "WORDS_TOGETHER", 4)
    monkeypatch.setattr(best, "CELLS", 20)
    assert key(fulltext.trigram_topk(chunks, df, 100)) == every and key(fulltext.trigram_topk(chunks, df, 3)) == few


def test_ideographs_are_found_by_pairs(spark):
    texts = ["数据统计报告", "这份合同的违约条款是什么", "Q3各区域销售数据汇总", "total sales 数据", "款", "機器 学习", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    assert [r[0] for r in df.select(T.bigrams(df.text)).collect()][:5] == [
        ["数据", "据统", "统计", "计报", "报告"], ["这份", "份合", "合同", "同的", "的违", "违约", "约条", "条款", "款是", "是什", "什么"],
        ["q3", "各区", "区域", "域销", "销售", "售数", "数据", "据汇", "汇总"], ["total", "sales", "数据"], ["款"]]
    marked = df.withColumn("is_cjk", T.is_cjk(F.col("text")))
    asked = spark.createDataFrame([(1, "合同违约"), (2, "sales 数据"), (3, "统计")], "query_id long, question string")
    got = {}
    for r in fulltext.bm25_topk(fulltext.build_index(marked), asked).collect():
        got.setdefault(r.query_id, set()).add(r.chunk_id)
    # Chunk 3 has few ideographs: its run stays whole, and here it is a pair.
    assert got == {1: {1}, 2: {0, 2, 3}, 3: {0}}
    plain = fulltext.build_index(df.where("chunk_id = 0"))
    assert [r.term for r in plain.postings.collect()] == ["数据统计报告"]


def test_a_segmenter_can_be_passed_in(spark):
    words = lambda text: F.split(F.lower(text), r"[ /]+")
    df = spark.createDataFrame([(1, "数据/统计", True), (2, "a/b", False)], "chunk_id long, text string, is_cjk boolean")
    assert sorted(r.term for r in fulltext.build_index(df, words).postings.collect()) == ["a", "b", "数据", "统计"]


def test_terms(spark):
    df = spark.createDataFrame([("foo_bar don't C++ Été ế",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(T.terms(df.t)).collect()]
    assert got == [["foo", "bar", "don", "t", "c", "ete", "ế"], [], []]


def test_counted_terms_are_those_of_the_segmenter(spark):
    rng = random.Random(6)
    texts = [(i % 45 if i else None, "".join(rng.choice("数据统a1é𠀀𝒳 .-款") for _ in range(rng.randint(0, 30))), rng.choice([True, False, None])) for i in range(60)]
    df = spark.createDataFrame([*texts, (70, None, True), (71, "", False), (72, "款", True), (73, "--", True)], "chunk_id int, text string, is_cjk boolean").repartition(3)
    held = fulltext.counted_terms(df)
    key = lambda d, *c: sorted((tuple(r) for r in d.select(*c).collect()), key=repr)
    plain = fulltext.index_terms(df)
    want = plain.select("chunk_id", F.explode("terms").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))
    assert key(fulltext.postings_of(held), "term", "chunk_id", "tf") == key(want, "term", "chunk_id", "tf")
    assert key(fulltext.lengths_of(held), "chunk_id", "len") == key(fulltext.lengths_of(plain), "chunk_id", "len")
    other = fulltext.counted_terms(df, lambda text: F.split(text, "a"))
    assert key(fulltext.lengths_of(other), "chunk_id", "len") == key(fulltext.lengths_of(fulltext.index_terms(df, lambda text: F.split(text, "a"))), "chunk_id", "len")
    # Repeats of a term in a text are no rows.
    one = fulltext.counted_terms(spark.createDataFrame([(1, "数" * 5000 + " b" * 5000, True)], "chunk_id long, text string, is_cjk boolean")).first()
    assert sorted(map(tuple, one.terms)) == [("b", 5000), ("数数", 4999)] and one.len == 9999
