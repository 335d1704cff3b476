"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is a chain of blocks, each the text between two block-level tags. A block's features are its
ancestors' tags, words of their class and id, and the shape of its text. The labels to train on come
from pages that mark their article; half of the training pages hide the mark, so that the model also
learns to do without. Training uses at most ``SAMPLE`` pages (a documented bound: the pages with the
smallest hash of page_id) in one task; every page is decoded by Viterbi.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 400
EPOCHS = 8
RATE = 0.2
DECAY = 1e-3

#: Tags by their role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
MATH = frozenset(
    "annotation annotation-xml math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms "
    "mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
INLINE |= MATH
SILENT = frozenset("script style noscript template head title svg iframe object canvas audio video select textarea button".split())
#: Of a formula only its visible form counts, not its source.
RAW = frozenset("script style title textarea annotation annotation-xml".split())
#: Tags that leave the page's head open, and tags of the lines of a list to choose from.
IN_HEAD = frozenset("html head title base link meta script style noscript template".split())
CHOICES = frozenset("option optgroup".split())
ARTICLE = frozenset("article main".split())
OUTSIDE = frozenset("nav footer aside form header menu dialog".split())
#: Words of class or id that tell of something beside the article.
OUTSIDE_WORDS = frozenset(
    "ad ads advert advertisement adbox banner breadcrumb comment comments consent cookie cookies disqus footer form header login "
    "menu modal nav navbar navigation newsletter notice pagination popup promo related reply share sharing sidebar signup social "
    "sponsor sponsored subscribe toolbar widget".split()
)
#: Weights the training starts from and is pulled to; they also serve features it never saw.
PRIOR = {"in:article": 3.0, "out": -4.0, "tag:p": 0.5, "links:all": -1.0} | {f"in:{t}": -2.0 for t in OUTSIDE}
WORDS = re.compile(r"[a-z]+")


class Blocks(HTMLParser):
    """Collects (text, ancestors, link characters); an ancestor is (tag, words of class and id).

    Text in a silent tag is dropped if the tag is closed. If its container ends first, only the text up
    to the next block tag was the silent tag's own.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset[str]]] = []
        self.found: list[tuple[str, tuple, int]] = []
        self.text: list[str] = []
        self.linked = 0
        #: Found blocks in silent tags by place, with those tags; tags (by identity) that were closed, or hold a block tag.
        self.hidden: dict[int, list[int]] = {}
        self.closed: set[int] = set()
        self.split: set[int] = set()
        #: All silent tags, so that no identity is used twice.
        self.kept: list[tuple] = []

    def silent(self) -> list[int]:
        return [id(x) for x in self.open if x[0] in SILENT]

    def end_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            ancestors = tuple(x for x in self.open if x[0] not in INLINE)
            if silent := self.silent():
                if ancestors[-1][0] in CHOICES or not self.split.issuperset(silent):
                    text = ""
                self.hidden[len(self.found)] = silent
                ancestors = tuple(x for x in ancestors if x[0] not in SILENT)
            if text:
                self.found.append((text, ancestors, self.linked))
            else:
                self.hidden.pop(len(self.found), None)
        self.text, self.linked = [], 0

    def finish(self) -> None:
        self.close()
        self.end_block()
        self.found = [x for i, x in enumerate(self.found) if self.closed.isdisjoint(self.hidden.get(i, ()))]

    def leave_head(self) -> None:
        for i, x in enumerate(self.open):
            if x[0] == "head":
                self.end_block()
                self.closed.add(id(x))
                del self.open[i:]
                return

    def handle_starttag(self, tag, attrs):
        if tag == "body" or tag not in IN_HEAD and not any(t in SILENT and t not in ("head", "title") for t, _ in self.open):
            self.leave_head()
        if tag == "br":
            self.text.append(" ")
        if tag not in INLINE:
            self.end_block()
            if tag not in SILENT and tag not in CHOICES and tag not in VOID:
                self.split.update(self.silent())
            # A paragraph ends where the next block starts, an item where the next item does.
            self.leave("p" if tag != "li" else "li", within="ul ol table div section article main body".split())
        if tag not in VOID:
            words = frozenset(w for k, v in attrs if k in ("class", "id", "role") and v for w in WORDS.findall(v.lower()))
            self.open.append((tag, words))
            if tag in SILENT:
                self.kept.append(self.open[-1])

    def leave(self, tag: str, within=()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in SILENT:
                    self.closed.add(id(self.open[i]))
                del self.open[i:]
                return
            if self.open[i][0] in within:
                return

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.end_block()
        self.leave(tag)

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.leave_head()
        if not any(t in RAW for t, _ in self.open):
            self.text.append(data)
            if any(t == "a" for t, _ in self.open):
                self.linked += len(data.strip())


def blocks(html: str) -> list[tuple[str, tuple, int]]:
    parser = Blocks()
    parser.feed(html)
    parser.finish()
    return parser.found


def features(text: str, ancestors: tuple, linked: int, hide_article: bool = False) -> list[str]:
    tags = [t for t, _ in ancestors]
    words = set().union(*(w for _, w in ancestors)) if ancestors else set()
    out = [f"tag:{tags[-1]}" if tags and not (hide_article and tags[-1] in ARTICLE) else "tag:none"]
    if not hide_article and any(t in ARTICLE for t in tags):
        out.append("in:article")
    out += [f"in:{t}" for t in sorted(set(tags)) if t not in ARTICLE and t not in ("html", "body")]
    if words & OUTSIDE_WORDS:
        out.append("out")
    out.append(f"len:{min(9, len(text).bit_length())}")
    out.append("links:all" if linked * 5 >= len(text) * 4 else "links:some" if linked else "links:none")
    out.append(f"stops:{min(3, sum(map(text.count, '.!?')))}")
    out.append("ends:stop" if text[-1] in ".!?\"'" else "ends:none")
    if text[0] in "©&" or "©" in text:
        out.append("mark:copyright")
    return out


def marked(ancestors: tuple) -> bool:
    """Whether a block is in the page's marked article and in nothing beside it."""
    inside = [i for i, (t, _) in enumerate(ancestors) if t in ARTICLE]
    if not inside:
        return False
    return not any(t in OUTSIDE or w & OUTSIDE_WORDS for t, w in ancestors[inside[0] + 1 :])


class Model:
    """Weights of features for label 1 (label 0 has none), and of the steps between labels."""

    def __init__(self, weights: dict[str, float], steps: list[list[float]], start: list[float]):
        self.weights, self.steps, self.start = weights, steps, start

    def unary(self, page: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, PRIOR.get(f, 0.0)) for f in fs) for fs in page]

    def decode(self, page: list[list[str]]) -> list[int]:
        """Viterbi."""
        best0, best1, back = 0.0, 0.0, []
        (s00, s01), (s10, s11) = self.steps
        for i, u in enumerate(self.unary(page)):
            if i == 0:
                best0, best1 = self.start[0], self.start[1] + u
                continue
            from0, from1 = best1 + s10 > best0 + s00, best1 + s11 > best0 + s01
            back.append((from0, from1))
            best0, best1 = max(best0 + s00, best1 + s10), max(best0 + s01, best1 + s11) + u
        label = int(best1 > best0)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]]) -> Model:
    """Conditional likelihood by stochastic gradient, page by page, with forward-backward sums."""
    model = Model({}, [[0.5, -0.5], [-0.5, 0.5]], [0.0, 0.0])
    w = model.weights
    order = np.random.default_rng(0)
    log_add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        for at in order.permutation(len(pages)).tolist():
            page, labels = pages[at]
            u, t, n = model.unary(page), model.steps, len(page)
            a = [(model.start[0], model.start[1] + u[0])]
            for i in range(1, n):
                p, q = a[-1]
                a.append((log_add(p + t[0][0], q + t[1][0]), log_add(p + t[0][1], q + t[1][1]) + u[i]))
            b = [(0.0, 0.0)] * n
            for i in range(n - 2, -1, -1):
                p, q = b[i + 1][0], b[i + 1][1] + u[i + 1]
                b[i] = (log_add(t[0][0] + p, t[0][1] + q), log_add(t[1][0] + p, t[1][1] + q))
            z = log_add(*a[-1])
            one = [math.exp(min(0.0, a[i][1] + b[i][1] - z)) for i in range(n)]
            for i in range(n):
                g = labels[i] - one[i]
                if abs(g) > 1e-4:
                    for f in page[i]:
                        old, prior = w.get(f, PRIOR.get(f, 0.0)), PRIOR.get(f, 0.0)
                        w[f] = old + rate * (g - DECAY * (old - prior))
            grad = [[0.0, 0.0], [0.0, 0.0]]
            for i in range(1, n):
                grad[labels[i - 1]][labels[i]] += 1
                for x in (0, 1):
                    for y in (0, 1):
                        grad[x][y] -= math.exp(min(0.0, a[i - 1][x] + t[x][y] + (u[i] if y else 0.0) + b[i][y] - z))
            for x in (0, 1):
                for y in (0, 1):
                    t[x][y] += rate * (grad[x][y] / max(1, n) - DECAY * t[x][y])
            for y in (0, 1):
                model.start[y] += rate * ((labels[0] == y) - (one[0] if y else 1 - one[0]))
    return model


def train(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` pages that mark their article; without any, the prior weights serve."""
    chosen = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")).orderBy(F.xxhash64("page_id"), "page_id").limit(sample)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["html"]))
        data = []
        for r in rows:
            found = blocks(r["html"])
            if found:
                labels = [int(marked(x)) for _, x, _ in found]
                data += [([features(*b, hide_article=hide) for b in found], labels) for hide in (False, True)]
        m = fit(data)
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([m.weights, m.steps, m.start])])], names=["model"])

    found = chosen.select("page_id", "html").coalesce(1).mapInArrow(learn, "model string").first()
    return fit([]) if found is None else Model(*json.loads(found["model"]))


def main_text(html: str, model: Model) -> str:
    found = blocks(html)
    if not found:
        return ""
    keep = model.decode([features(*b) for b in found])
    return "\n\n".join(b[0] for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``.

    Null and empty html, and html without text, give an empty text; null or repeated ids are rows of
    their own; an empty table gives no rows; other columns are not read. ``n_chars`` are code points.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    model = train(pages, sample)
    shared = pages.sparkSession.sparkContext.broadcast((model.weights, model.steps, model.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            texts = [main_text(h, own) for h in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
