"""Chunks against a plain function on random text, and the cases that are easy to get wrong."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import chunking

TABLE = "| A | B |\n|---|:-:|\n| 1 | 2 |\n| 3 | 4 |"


def pages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")


def chunks(spark, text, **sizes):
    rows = chunking.page_chunks(pages(spark, text), **sizes).orderBy("position").collect()
    return [(r.chunk_type, r.section, r.text) for r in rows]


def test_table_and_its_summary(spark):
    got = chunks(spark, f"# Top\nbefore\n\n{TABLE}\nafter")
    assert got == [("text", "Top", "before"), ("table", "Top", TABLE), ("table_summary", "Top", "[表格] Top 包含 2 行数据，列：A、B"), ("text", "Top", "after")]


def test_bars_without_a_rule_are_text(spark):
    assert chunks(spark, "| a | b |\n| c | d |") == [("text", "", "| a | b |\n| c | d |")]


def test_a_run_starts_its_table_at_the_rule(spark):
    assert [k for k, *_ in chunks(spark, f"| x |\n{TABLE}\n{TABLE}")] == ["text", "table", "table_summary"]


def test_paths_of_headings(spark):
    got = chunks(spark, "intro\n# A\na\n### C\nc\n## B\nb\n# D\nd")
    assert [(s, t) for _, s, t in got] == [("", "intro"), ("A", "a"), ("A > C", "c"), ("A > B", "b"), ("D", "d")]


def test_blank_and_null_pages_have_no_chunks(spark):
    assert chunking.page_chunks(pages(spark, "", None, "  \n ", "# only a heading")).count() == 0


def test_wide_table_names_six_columns(spark):
    head = "| " + " | ".join(f"c{i}" for i in range(8)) + " |"
    df = spark.createDataFrame([(f"{head}\n|{'---|' * 8}",)], "t string")
    assert df.select(chunking.table_summary(df.t, F.lit(""))).first()[0] == "[表格] 文档 包含 0 行数据，列：c0、c1、c2、c3、c4、c5等8列"


def plain_pieces(text, most, back, separators=chunking.SEPARATORS):
    """The rule as it is stated, by trial: of all runs of parts from here on, the longest that fits."""
    if len(text) <= most:
        return [text] if text.strip() else []
    usable = [s for s in separators if s in text]
    if not usable:
        return [text[a : a + most] for a in range(0, len(text), most - back) if text[a : a + most].strip()]
    sep, found, parts, before = usable[0], [], text.split(usable[0]), ""

    def run(parts):
        held = ""
        for part in parts:
            held = (held + sep + part).lstrip(sep) if held else part
        return held

    while parts:
        opened = [before + sep + parts[0]] if before else [parts[0]]
        fits = 1
        while fits < len(parts) and len(run([*opened, *parts[1 : fits + 1]])) <= most:
            fits += 1
        got = plain_pieces(held, most, back, separators[1:]) if (held := run([*opened, *parts[1:fits]])).strip() else []
        found, parts, before = found + got, parts[fits:], got[-1][-back:] if got and back else ""
    return found


def test_pieces_equal_the_plain_rule():
    rng = random.Random(4)
    for letters in (["a", "b", " ", ". ", "\n", "\n\n", "。", "word", "\n\n\n"], ["a", " ", "."], ["\n", "a", "\n\n"], ["。", ".", "x", "..."]):
        for _ in range(400):
            text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
            most = rng.randint(2, 40)
            back = rng.randint(0, most - 1)
            assert chunking.pieces(text, most, back) == plain_pieces(text, most, back), (text, most, back)


def plain_page(text, most, back):
    """Kinds, paths and texts of a page's chunks, line by line and with the plain rule."""
    lines, kinds = text.splitlines(), []
    row = [len(x.strip()) > 2 and x.strip()[0] == "|" == x.strip()[-1] for x in lines]
    rule = [r and all(c.strip() and set(c.strip().strip(":")) == {"-"} and len(c.strip()) - len(c.strip().strip(":")) <= 2 for c in x.strip()[1:-1].split("|")) for r, x in zip(row, lines)]
    for i in range(len(lines)):
        a = i
        while a > 0 and row[a] and row[a - 1]:
            a -= 1
        tops = [j for j in range(a, len(lines) - 1) if all(row[a : j + 1]) and rule[j + 1]]
        kinds.append("table" if row[i] and tops and i >= tops[0] else "text")
    out, crumbs, i = [], [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and kinds[j] == kinds[i]:
            j += 1
        body = "\n".join(lines[i:j]).strip()
        if kinds[i] == "table":
            out.append(("table", " > ".join(crumbs), body))
            if any(x.strip() and not re.match(r"\|[-:| ]+\|", x.strip()) for x in body.splitlines()):
                out.append(("table_summary", " > ".join(crumbs), None))
        else:
            held, said = "", []
            for part in re.split(r"(?m)^(#{1,6}\s+.+)", body):
                said.append(part)
            for n, part in enumerate(said):
                if n % 2:
                    mark, title = re.match(r"(#+)\s+(.+)", part).groups()
                    crumbs = crumbs[: len(mark) - 1] + [title.strip()]
                else:
                    out += [("text", " > ".join(crumbs), p) for p in plain_pieces(part.strip(), most, back)]
        i = j
    return out


def test_pages_equal_the_plain_rule(spark):
    rng = random.Random(6)
    blocks = ["# A", "## B", "#### C d", "### ", "#no", "| a | b |", "|---|:-:|", "|--|", "| 1 | 2 |", "|  | x |", "| - |", "```", "some words. and more of them", "", "", "  ", "x" * 60, "|not", "。" * 3, "# Last\r"]
    texts = ["\n".join(rng.choice(blocks) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    got = {}
    for r in chunking.page_chunks(pages(spark, *texts).repartition(3), 12, 3).orderBy("page_id", "position").collect():
        assert r.char_count == len(r.text) and r.position == len(got.setdefault(r.page_id, []))
        got[r.page_id].append((r.chunk_type, r.section, None if r.chunk_type == "table_summary" else r.text))
    for i, text in enumerate(texts):
        assert got.get(i, []) == plain_page(text, 24, 6), text


def test_chunking_moves_no_rows(spark):
    plan = chunking.page_chunks(pages(spark, "a"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_pieces_are_short_and_overlap():
    rng = random.Random(0)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", " ", ". ", "\n", "\n\n", "。", "word"]) for _ in range(rng.randint(0, 400)))
        got = list(chunking.pieces(text, 40, 8))
        assert all(p.strip() for p in got)
        kept = sum(len(p) for p in got)
        assert kept >= len("".join(text.split())) - text.count(".") - text.count("。") - 40
    assert list(chunking.pieces("x" * 100, 40, 8)) == ["x" * 40, "x" * 40, "x" * 36, "x" * 4]
    assert list(chunking.pieces("aaaa bbbb cccc", 9, 2)) == ["aaaa bbbb", "bb cccc"]


def test_hard_split(spark):
    df = pages(spark, "x" * 100, "", None)
    got = [r[0] for r in df.select(chunking.hard_split(F.col("text"), 20, 4)).collect()]
    assert got[0] == ["x" * 40, "x" * 40, "x" * 36, "x" * 4] and got[1] == [] and got[2] == []


@pytest.mark.parametrize("size, overlap", [(0, 0), (10, 10), (10, -1)])
def test_sizes_are_checked(size, overlap):
    with pytest.raises(ValueError):
        chunking.checked_size(size, overlap)


def test_markdown(spark):
    raw = "---\ntags:\n  - a\n  - 'b'\n---\n# H #no\nText #tag/sub #fff (#anchor) x#y #k=1 #tag/sub\n%%hid\nden%%\n\n\n\n![[e.png]] [[t|alias]] [[target]]\n> [!note] Title\npara ^id-1"
    df = spark.createDataFrame([(raw,)], "t string")
    tags, text = df.select(T.merged_tags(df.t), T.clean_markdown(T.body(df.t))).first()
    assert tags == ["a", "b", "tag/sub"]
    assert text == "# H #no\nText #tag/sub #fff (#anchor) x#y #k=1 #tag/sub\n\n alias target\n> Title\npara"


FRONT = [
    ("tags: [a, \"b, c\", 'd''s', it's, 2024]", ["a", "b, c", "d's", "it's", "2024"]),
    ("title: x\ntags: [\n  a,\n  'b]',\n]\ndate: 1", ["a", "b]"]),
    ("tags:  # ours\n- a # first\n\n  # none\n- \"b # c\"\n-\n- yes\nother: [x]", ["a", "b # c", "None", "True"]),
    ('"tags": a b # one', ["a b"]),
    ("'tags': 'a: b'", ["a: b"]),
    ('tags: "say \\"so\\""', ['say "so"']),
    ("tags: []", []),
    ("tags:", []),
    ("tags: ~", []),
    ("tags: 2024", []),
    ("tags: 2024-01-02", []),
    ("tags: {a: b}", []),
    ("tags:a", []),
    ("other:\n  tags: [a]", []),
    ("mytags: [a]", []),
    ("tags: [a, a]", ["a", "a"]),
    ("tags: [" + ", ".join(f'"t{i}"' for i in range(20000)) + "]", [f"t{i}" for i in range(20000)]),
    ("tags:\n" + "- 'x'\n" * 20000, ["x"] * 20000),
]


def test_front_matter_tags(spark):
    df = spark.createDataFrame([(i, f"---\n{head}\n---\nBody") for i, (head, _) in enumerate(FRONT)] + [(98, None), (99, "no front matter")], "i int, t string")
    got = {r.i: r.tags for r in df.select("i", T.front_matter_tags(df.t).alias("tags")).collect()}
    assert (got.pop(98) or [], got.pop(99)) == ([], [])
    for i, (head, tags) in enumerate(FRONT):
        assert got[i] == tags, head[:80]


def test_front_matter_tags_come_back_as_written(spark):
    draw = random.Random(5)
    quotes = (lambda t: '"' + t.replace("\\", "\\\\").replace('"', '\\"') + '"', lambda t: "'" + t.replace("'", "''") + "'")
    frames = (
        lambda items: f"tags: [{', '.join(items)}]",
        lambda items: "tags: [" + ",\n  ".join(items) + "\n]\nlater: [z]",
        lambda items: "first: 1\ntags:\n" + "\n".join(f"  - {x}  # note" for x in items) + "\nlater: z",
    )
    rows, want = [], []
    for i in range(300):
        tags = ["".join(draw.choice("ab 中,#'\"\\[]{}:-|") for _ in range(draw.randint(1, 8))) for _ in range(draw.randint(1, 5))]
        plain = [re.fullmatch("[ab中]+", t) and draw.random() < 0.8 for t in tags]
        items = [t if p else draw.choice(quotes)(t) for t, p in zip(tags, plain)]
        rows.append((i, f"---\n{draw.choice(frames)(items)}\n---\nBody"))
        want.append(tags)
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.tags for r in df.select("i", T.front_matter_tags(df.t).alias("tags")).collect()}
    for i, tags in enumerate(want):
        assert got[i] == tags, rows[i][1]


def test_lines(spark):
    df = spark.createDataFrame([("a\r\nb\n\nc d\n",), ("",), ("\n",)], "t string")
    assert [r[0] for r in df.select(T.lines(df.t)).collect()] == [["a", "b", "", "c", "d"], [], [""]]


def test_long_texts_are_taken_apart_a_few_at_a_time():
    import pyarrow as pa

    from tidemark.operators.batches import ROWS, TOGETHER, slices

    texts = ["x" * n for n in (0, 5, 3 * TOGETHER, 7, TOGETHER // 2, TOGETHER // 2, TOGETHER // 2, *[1] * (2 * ROWS))]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["page_id", "text"])
    got = list(slices([batch.slice(0, 0), batch.slice(1), batch.slice(0, 1)]))
    assert [i for b in got for i in b.column(0).to_pylist()] == [*range(1, len(texts)), 0]
    assert all(b.num_rows == 1 or b.nbytes <= TOGETHER and b.num_rows <= ROWS for b in got)
