"""Vector codes, packing into tiers and ranked search, against plain versions and on awkward rows."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import impacts, queries, tiers, vector_codes

SF = "/root/testdata/sf0.001"


# Vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    width = -(-max(len(v) for *_, v in kept) // parts) or 1
    kept = [(i, label, v + [0] * (parts * width - len(v))) for i, label, v in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:entries]
    books = [[cut(v, p) for *_, v in seeds] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for *_, v in kept:
                groups[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, label, v in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
        by_label[label] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, code, error, by_label[label]) for i, label, code, error in out], digest


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def codes_of(spark, rows, **more):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string, code string, vector int" if len(rows[0]) == 5 else "vec_id long, embedding array<double>, label string") if rows else spark.createDataFrame([], "vec_id long, embedding array<double>, label string")
    got, books = vector_codes.compress(docs, **more)
    return order(tuple(r) for r in got.select("vec_id", "code", "error", "label_error").collect()), books


def test_codes_equal_plain_ones(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(centres)], rng.choice(["a", "b", None])) for i in range(400)]
    rows += [(1000 + i, list(rows[i][1]), "a") for i in range(60)]
    rng.shuffle(rows)
    got, books = codes_of(spark, rows, entries=16)
    want, _ = plain_codes(rows, entries=16)
    assert got == order(want)
    assert books.digest() == plain_codes(rows, entries=16)[1]


def test_partial_distances_lose_nothing():
    rng = np.random.default_rng(5)
    for k, d in ((1, 1), (3, 2), (64, 4), (64, 7)):
        x, book = rng.integers(-6, 6, (500, d)), rng.integers(-6, 6, (k, d))
        every = np.square(x[:, None] - book[None]).sum(axis=2)
        of, far = vector_codes.nearest(x, book, vector_codes.Codebooks(book[None]).orders()[0])
        assert (of == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def test_dimensions_by_variance():
    book = np.array([[[0, 5, 1], [0, -5, 2], [0, 5, 9]]])
    assert vector_codes.Codebooks(book).orders()[0].tolist() == [1, 2, 0]


def test_codes_of_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    v = [0.5, -0.001] * 8
    rows = [(5, v, None, "x", 1), (None, v, "a", "x", 1), (3, None, "a", "x", 1), (4, [*v[:-1], nan], "a", None, 1), (6, [*v[:-1], -inf], "a", "x", 1), (7, [*v[:-1], None], "a", "x", None)]
    rows += [(5, v, None, "x", 1), (8, [], "b", "x", 1), (9, [1.0] * 17, "b", "x", 1)]
    got, books = codes_of(spark, rows)
    want, digest = plain_codes([r[:3] for r in rows])
    assert got == order(want) and books.digest() == digest and [r[0] for r in got] == [5, 5, 8, 9, None]
    # Sizes beyond what 64 bits hold saturate, and every row stays.
    huge, _ = codes_of(spark, [(i, [(-1) ** i * 1e300] * 32, "c") for i in range(70)])
    assert len(huge) == 70 and all(0 <= r[2] < 1 << 63 for r in huge)
    assert codes_of(spark, [])[0] == [] and codes_of(spark, [(1, None, "a")])[0] == []
    with pytest.raises(ValueError):
        codes_of(spark, [(1, v, "a")], entries=300)


def test_floors_go_down(spark):
    got, books = codes_of(spark, [(1, [-0.001] * 16, "a"), (2, [0.001] * 16, "a")])
    assert books.entries[:, :, 0].tolist() == [[-1, 0]] * 16 and [r[2] for r in got] == [0, 0]


def test_labels_of_many_rows_and_of_few(spark):
    rows = spark.range(30000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 10000, None).when(F.col("id") < 20000, F.lit(-1)).otherwise(F.col("id")).alias("label"), F.lit("").alias("code"), (F.col("id") % 7).alias("error"))
    got = vector_codes.with_label_error(rows).groupBy(F.col("label").isNull().alias("none"), (F.col("label") == -1).alias("hot")).agg(F.count("*"), F.max("label_error"), F.min("label_error")).collect()
    assert {tuple(r)[2:] for r in got} == {(10000, sum(i % 7 for i in range(10000)), sum(i % 7 for i in range(10000))), (10000, sum(i % 7 for i in range(10000, 20000)), sum(i % 7 for i in range(10000, 20000))), (10000, 6, 0)}


# Packing into tiers


@pytest.fixture(scope="module")
def model():
    return tiers.read_model(public_tokenizers.path("word_bpe_49k.json"))


def test_words_encode_like_texts(model):
    encoder, rng = tiers.Encoder(model), random.Random(1)
    plain = ["'s", "'re", "'T", "'l", "'ll", "s", "a", "É", "é", "Ŀ", "ŉ", "ª", "×", " ", "  ", "\n", "\t", "\xa0", "\x85", "\x0b", "\x7f", "\x00", "1", "²", "¼", "!!", ".", "'", "İ", "ſ", "<|endoftext|>", "in", "the", "\xad"]
    rare = ["\u0301", "Σ", "\u2003", "\x1c", "漢", "٣", "ﬁ", "\u200d", "😀", "e\u0301", "\U0010ffff"]
    texts = ["".join(rng.choices(plain, k=rng.randint(0, 12))) for _ in range(6000)] + ["".join(rng.choices(plain + 3 * rare, k=rng.randint(0, 12))) for _ in range(6000)] + ["x" * 100_000, " " * 1000, ""]
    words = [r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    for some in (texts, words, ["漢"], [""], []):
        want = [e.ids for e in encoder.tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [i.tolist() for i in encoder.encode(pa.array(some, pa.string()))] == want


def test_other_tokenizers_encode_by_themselves():
    """A tokenizer that isn't of the known kind has no merges to borrow; its words go through it."""
    model = tiers.read_model(public_tokenizers.path("word_bpe_49k.json"))
    other = json.loads(model)
    other["model"]["merges"] = other["model"]["merges"][:1000] + other["model"]["merges"][1001:]
    encoder, text = tiers.Encoder(json.dumps(other)), "Some words, and MORE words."
    assert encoder.merges is None and encoder.encode(pa.array([text]))[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_windows_are_full_and_whole(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 2, 255, 256, 257, 4095, 4096, 4097, rng.randint(1, 300), rng.randint(1, 9000)]) for _ in range(rng.randint(1, 400))]
    found = tiers.pack_window(lengths)
    seen = defaultdict(list)
    for context, pieces in found:
        assert sum(n for *_, n in pieces) == context and context & context - 1 == 0 and context <= 4096
        for doc, start, n in pieces:
            seen[doc].append((start, n))
    for doc, length in enumerate(lengths):
        at = 0
        for start, n in sorted(seen[doc]):
            assert start == at and n > 0
            at += n
        assert at == length
    # Only the end of a window is cut into contexts that are no tier.
    assert sum(context not in tiers.TIERS for context, _ in found) <= 8
    # A sequence is closed by one cut at most; whole contexts of long texts are cuts by themselves.
    assert sum(len(s) for s in seen.values()) <= len(lengths) + len(found) + sum(n // 4096 for n in lengths) + 16


def test_gaps_are_filled_from_shorter_tiers():
    found = tiers.pack_window([3000, 1000, 90, 6])
    assert found == [(4096, [(0, 0, 3000), (1, 0, 1000), (2, 0, 90), (3, 0, 6)])]


def test_steps_have_equal_tokens_and_like_costs():
    rng = random.Random(2)
    found = tiers.pack_window([min(20000, int(rng.expovariate(1 / 700)) + 1) for _ in range(5000)])
    steps = tiers.steps_of(found, 1 << 16)
    held = defaultdict(list)
    for (context, pieces), step in zip(found, steps):
        held[step].append((context, sum(n * n for *_, n in pieces)))
    assert all(len({c for c, _ in s}) == 1 and sum(c for c, _ in s) <= 1 << 16 for s in held.values())
    by_tier = defaultdict(list)
    for s in held.values():
        if sum(c for c, _ in s) == 1 << 16:
            by_tier[s[0][0]].append(sum(cost for _, cost in s))
    assert all(max(c) <= 1.15 * min(c) for t, c in by_tier.items() if t in (4096, 2048, 1024))


def test_packed_ids_are_the_texts(spark, model):
    long = "word and more. " * 30_000
    texts = [(1, "a"), (2, None), (3, ""), (None, "no id"), (None, "no id"), (7, "twice"), (7, "twice"), (8, long), *((i, f"text {i} " * (i % 90)) for i in range(20, 320))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, ids int, context string").repartition(3)
    packed = tiers.pack(docs, model, window_tokens=60_000).cache()
    rows = packed.collect()
    tokenizer = Tokenizer.from_str(model)
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in texts)
    joined, places = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(ids) == r["length"] > 0
        joined[r["doc_id"]].append((r["start"], ids.tolist(), r["doc_tokens"]))
        places[r["sequence_id"]].append((r["offset"], r["length"], r["context"], r["step"]))
    for s in places.values():
        at = 0
        for offset, n, *_ in sorted(s):
            assert offset == at
            at += n
        assert {x[2:] for x in s} == {(at, s[0][3])}
    unique = {i: ids for (i, ids), n in want.items() if n == 1 and i is not None}
    for i, ids in unique.items():
        assert [x for _, part, _ in sorted(joined[i]) for x in part] == list(ids) and {n for *_, n in joined[i]} == {len(ids)}
    assert sum(r["length"] for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    whole = {r["sequence_id"]: r for r in tiers.sequences(packed).collect()}
    assert len(whole) == len(places) and all(len(r["ids"]) == 4 * r["context"] and r["cu_seqlens"][-1] == r["context"] for r in whole.values())
    for r in rows:
        at = r["offset"]
        assert whole[r["sequence_id"]]["ids"][4 * at : 4 * (at + r["length"])] == r["ids"]
    assert tiers.pack(docs.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        tiers.pack(docs, model, tiers=(4096, 1000))


def test_op12_over_a_table(spark):
    got = queries.op12_tier_packing(spark, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, text in texts.items():
        ids, at = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in by_sequence.values():
        total = sum(n for _, n in s)
        assert total & total - 1 == 0 and total <= 4096 and [o for o, _ in sorted(s)] == [0, *np.cumsum([n for _, n in sorted(s)])[:-1].tolist()]


# Ranked search


def plain_ranks(docs, questions, k=10):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(ws), len(ws)) for i, t in docs if (ws := words(t))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in {q for q in questions if q[1] is not None}:
        found = []
        for i, c, size in held:
            m = 25 + 75 * size * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in Counter(words(text)).items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return order(out)


def ranks_of(spark, docs, questions, **more):
    d = spark.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, item_id int, term string").repartition(3)
    q = spark.createDataFrame([(*x, 1.0) for x in questions], "item_id long, text string, score double")
    return order(tuple(r) for r in impacts.ranked(d, q, **more).collect())


def corpus(rng, n):
    word = lambda: rng.choice("the of a b c d e É 漢字 x1 y2 z".split() + [f"w{int(rng.expovariate(0.02))}"])
    return [(i, rng.choice([" ", "-", "\n", ". "]).join(word().upper() if rng.random() < 0.2 else word() for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("size", [70, 1])
def test_ranks_equal_plain_ones(spark, monkeypatch, size):
    rng = random.Random(size)
    docs = corpus(rng, 700)
    docs += [(2000 + i, docs[7][1]) for i in range(30)] + [(None, docs[9][1]), (5, docs[9][1]), (5, docs[9][1]), (3000, None), (3001, ""), (3002, "! ?")]
    questions = [(i, docs[rng.randrange(700)][1]) for i in range(25)] + [(90, None), (91, ""), (92, "the The THE"), (92, "zebra"), (93, "w1 w1 w1 w2"), (93, "w1 w1 w1 w2"), (None, "b c d"), (None, "7:a b"), (7, "a b")]
    monkeypatch.setattr(impacts, "TERMS_TOGETHER", 100 * size)
    assert ranks_of(spark, docs, questions) == plain_ranks(docs, questions)


def test_small_blocks_and_few_sums(monkeypatch):
    """Blocks of a few documents and passes over a few questions rank like the whole; the functions run here, not in workers."""
    rng = random.Random(4)
    docs = [(i, t) for i, t in corpus(rng, 300) if impacts.terms_of(t.encode())]
    counts = {i: Counter(impacts.terms_of(t.encode())) for i, t in docs}
    of = impacts.Statistics(len(docs), sum(map(lambda c: sum(c.values()), counts.values())), Counter(t for c in counts.values() for t in c))
    questions = impacts.Questions([{"item": f"{q:03}", "item_id": q, "term": t, "times": n} for q in range(40) for t, n in counts[docs[q][0]].items()])
    monkeypatch.setattr(impacts, "SUM_WORDS", 400)

    def block(some):
        held = defaultdict(list)
        for slot, (i, _) in enumerate(some):
            for t, n in counts[i].items():
                held[t].append((slot, n))
        flat = [x for v in held.values() for x in v]
        return {"doc_ids": [i for i, _ in some], "lengths": [sum(counts[i].values()) for i, _ in some], "terms": list(held), "ends": np.cumsum([len(v) for v in held.values()]).tolist(), "slots": [s for s, _ in flat], "tfs": [n for _, n in flat]}

    found = defaultdict(list)
    for a in range(0, len(docs), 130):
        one = block(docs[a : a + 130])
        for q, slot, score in impacts.scored(one, questions, of, 10):
            for i, s, n in zip(q.tolist(), slot.tolist(), score.tolist()):
                found[i].append((-n, one["doc_ids"][s]))
    got = order((q, r, i, -n) for q, rows in found.items() for r, (n, i) in enumerate(sorted(rows)[:10], 1))
    assert got == plain_ranks(docs, [(q, docs[q][1]) for q in range(40)])


def test_carries_and_best_sums():
    rng = np.random.default_rng(1)
    sums, plain = np.zeros((40, 5, 4), np.uint64), np.zeros((5, 256), np.int64)
    for _ in range(60):
        slots = np.unique(rng.integers(0, 256, rng.integers(1, 200)))
        impact, shift = rng.integers(1, 1 << 20, len(slots)), int(rng.integers(0, 4))
        rows = np.unique(rng.integers(0, 5, 3))
        impacts.add(sums, rows, impacts.slices(slots, impact), shift)
        plain[np.ix_(rows, slots)] += impact << shift
    plain[4] = plain[4] // 1_000_000 * 1_000_000
    again = np.zeros_like(sums)
    for q in range(5):
        at = np.flatnonzero(plain[q])
        impacts.add(again, np.array([q]), impacts.slices(at, plain[q][at]), 0)
    assert (again[:, :4] == sums[:, :4]).all()
    for k in (1, 10, 300):
        q, s, score = impacts.best(again, k)
        for i in range(5):
            want = sorted((-n, at) for at, n in enumerate(plain[i].tolist()) if n)[:k]
            assert sorted(zip((-score[q == i]).tolist(), s[q == i].tolist())) == want


def test_empty_tables_rank_nothing(spark):
    assert ranks_of(spark, [(1, None), (2, "")], [(1, "a b")]) == []
    assert ranks_of(spark, [(1, "a b")], [(1, None), (2, " ")]) == []
    assert impacts.ranked(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_a_whole_index_answers_too(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a a"), (3, "d")], "doc_id long, text string").coalesce(1)
    index = impacts.blocks(docs)
    of = impacts.statistics(index)
    assert (of.docs, of.tokens, of.held_by) == (3, 6, {b"a": 2, b"b": 1, b"c": 1, b"d": 1})
    questions = impacts.Questions([{"item": "q", "item_id": 9, "term": b"b", "times": 1}])
    assert [(r["item_id"], r["doc_id"]) for r in impacts.search(index, questions, of).collect()] == [(9, 1)]


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_lexical_search"])
def test_queries_equal_their_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    columns = sorted(df.columns)
    want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert order(tuple(r) for r in df.select(columns).collect()) == order(want) and want
