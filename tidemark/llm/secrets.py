"""Secret scans: fixed patterns, plus strings that a dictionary-primed zstandard cannot shorten.

A candidate is a long string near a word that names a secret, before or after it, of any length and with
its dotted parts; what follows a found one on the next lines is a candidate too. Its marginal cost is the
number of bytes by which a frame grows when the candidate is appended to its surrounding text, compressed
with a dictionary of identifiers: the words that identifiers of the corpus are made of most often, counted
over all texts, and some that are common around secrets everywhere. A random key costs nearly its full
entropy, an identifier or a word that stands nearby next to nothing. Copies of the candidate itself don't
count as surroundings, and all places of a string get its verdict.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ids_and_texts

#: The kinds in the order in which they are listed, and their patterns.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_VALUE = 12

#: Words that name a secret, and identifiers that are common around one.
SENSITIVE = re.compile(r"(?ai:password|passwd|pwd|secret|token|api[_-]?key|credential|private[_-]?key|auth|bearer|signature|login)")
IDENTIFIERS = (
    "username password passwd secret token api_key apikey access_key_id secret_access_key client_id client_secret "
    "authorization bearer credential certificate private_key public_key session signature endpoint hostname localhost "
    "config configuration settings environment example placeholder changeme default development production staging "
    "function return import export const static public private class string integer boolean true false null undefined "
    "https://www.example.com/index.html http:// .com .org .net /usr/local/bin /var/log/ application/json text/plain "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 "
)
#: A word of an identifier, alone, between marks or in camel case. It is shorter than any candidate, so no secret
#: enters the dictionary, however often it is copied.
PIECE = r"[A-Z][a-z]{3,14}(?![a-z])|(?<![A-Za-z])[a-z]{4,15}(?![a-z])"
#: Words of the corpus in the dictionary: the most frequent ones. A coder's dictionary is bounded by its window.
ENTRIES = 4096
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*")
LEAST_CANDIDATE = 16
#: What may stand between a found string and the string that continues it: line ends, quotes, joins.
BETWEEN = re.compile(r"""(?:\\[nr]|[\s"'+,.\\])+""")
#: A candidate that is plain as a whole is looked at in slices of so many characters.
SLICE = 512
#: How far from a candidate its sensitive word may stand, and how much text around it primes the coder.
REACH = 40
AROUND = 200
#: Marginal bytes per character from which a candidate counts as novel.
LEAST_NOVELTY = 0.68

#: A text without any of these has no assignment and no sensitive word: a plain search says so sooner.
_HINTS = tuple(x.encode() for x in ("passw", "pwd", "secret", "token", "api", "credential", "private", "auth", "bearer", "signature", "login"))

_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
LEVEL = 19
#: Marginal cost of (text before, candidate, text after), per character.
Cost = Callable[[str, str, str], float]


def novelty_by(dictionary: str) -> Cost:
    """The marginal compressed bytes of a candidate in its surroundings, per character, under a dictionary."""
    primer = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primer.precompute_compress(level=LEVEL)
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=primer, write_content_size=False)

    def cost(before: str, candidate: str, after: str) -> float:
        around = (before + "\n" + after + "\n").encode()
        return (len(coder.compress(around + candidate.encode())) - len(coder.compress(around))) / len(candidate)

    return cost


novelty = novelty_by(IDENTIFIERS)


def identifiers(docs: DataFrame, entries: int = ENTRIES) -> str:
    """The dictionary for a corpus: words of identifiers counted over every text, the most frequent last.

    Counts are summed in Spark; only the ``entries`` first words by count and spelling reach the driver. Null and
    empty texts have none, and without any the fixed words are the dictionary.
    """
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(PIECE), F.lit(0))).alias("word"))
    counted = words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "word").limit(entries).collect()
    return " ".join([*(r["word"] for r in reversed(top)), IDENTIFIERS])


def hinted(text: str) -> bool:
    lower = text.encode().lower()
    return any(h in lower for h in _HINTS)


def base_spans(text: str, hint: bool | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind, in order."""
    found = []
    if hinted(text) if hint is None else hint:
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def run_start(text: str, at: int, i: int) -> int:
    """Where the run of candidate characters around position ``i`` starts, not before ``at``."""
    while i > at and (text[i - 1] in _CHARS or text[i - 1] == "." and i - 1 > at and text[i - 2] in _CHARS):
        i -= 1
    return i


def outside(a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a:b that no base span covers."""
    out = []
    for p, _, q in base:
        if p < b and a < q:
            out.append((a, p))
            a = max(a, q)
    return [(p, q) for p, q in [*out, (a, b)] if p < q]


def surroundings(text: str, a: int, b: int) -> tuple[str, str, str]:
    """The text before the candidate a:b, the candidate, and the text after it.

    What the candidate shares with the sides over its least length is left out of them, at their ends
    too: a copy of a key says nothing against the key.
    """
    s, sides = text[a:b], []
    for p, q, lo, hi in (
        (max(0, a - AROUND), a, max(0, a - AROUND - LEAST_CANDIDATE + 1), a),
        (b, min(len(text), b + AROUND), b, min(len(text), b + AROUND + LEAST_CANDIDATE - 1)),
    ):
        kept, at = [], p
        for i in range(lo, hi - LEAST_CANDIDATE + 1):
            if text[i : i + LEAST_CANDIDATE] in s:
                kept.append(text[at : max(at, i)])
                at = max(at, i + LEAST_CANDIDATE)
        sides.append("".join([*kept, text[at:q]]))
    return sides[0], s, sides[1]


def cuts(text: str, a: int, b: int) -> Iterator[list[int]]:
    """Places to cut a plain candidate at, in the order in which they are tried."""
    yield [i for i in range(a, b) if text[i] == "."]
    words = [m.span() for m in SENSITIVE.finditer(text, a, b)]
    yield [p for p, _ in words]
    yield [i for i in range(a + 1, b) if text[i - 1] == "=" != text[i]]
    yield [q for _, q in words]
    yield list(range(a + SLICE, b, SLICE))


def novel_parts(text: str, a: int, b: int, cost: Cost = novelty) -> list[tuple[int, int]]:
    """The candidate itself if it is novel, or else its novel parts."""
    if text[a:b].startswith("."):
        a += 1
    if b - a < LEAST_CANDIDATE:
        return []
    if cost(*surroundings(text, a, b)) >= LEAST_NOVELTY:
        return [(a, b)]
    for places in cuts(text, a, b):
        if inner := [i for i in places if a < i < b]:
            return [x for p, q in zip([a, *inner], [*inner, b]) for x in novel_parts(text, p, q, cost)]
    return []


def continued(text: str, a: int, b: int, base: list[tuple[int, int, int]], cost: Cost = novelty) -> list[tuple[int, int]]:
    """Novel strings that go on where the found string a:b ends, each where the one before it ends.

    A last line too short to be a candidate belongs to lines of one width, or ends in padding.
    """
    out, widths = [], [b - a]
    while (gap := BETWEEN.match(text, b)) and (c := CANDIDATE.match(text, gap.end())):
        p, q = c.span()
        if any(k == 0 and x < q and p < y for x, k, y in base):
            break
        parts = [x for y in outside(p, q, base) for x in novel_parts(text, *y, cost)]
        covered = sum(y - x for x, y in parts) + sum(max(0, min(q, y) - max(p, x)) for x, _, y in base)
        out += parts
        if covered < q - p:
            broken = any(x in gap.group() for x in ("\n", "\\n", "\r", "\\r"))
            wrapped = len(widths) > 1 and widths[-1] == widths[-2] or text[q - 1] == "="
            if q - p < LEAST_CANDIDATE and broken and wrapped and (q == len(text) or text[q] in "\r\n\"'\\"):
                out += outside(p, q, base)
            break
        widths.append(q - p)
        b = q
    return out


def everywhere(text: str, found: set[tuple[int, int]], base: list[tuple[int, int, int]], cost: Cost = novelty) -> set[tuple[int, int]]:
    """The found spans and every other place of their strings, outside the base spans."""
    by_start: dict[str, set[str]] = {}
    for a, b in found:
        if b - a >= LEAST_CANDIDATE:
            by_start.setdefault(text[a : a + LEAST_CANDIDATE], set()).add(text[a:b])
    out, ends, done = set(found), {}, 0
    for a, b in found:
        ends[a] = max(b, ends.get(a, 0))
    reach = 0
    for i in range(len(text) - LEAST_CANDIDATE + 1 if by_start else 0):
        reach = max(reach, ends.get(i, 0))
        longest = max((i + len(s) for s in by_start.get(text[i : i + LEAST_CANDIDATE], ()) if text.startswith(s, i)), default=0)
        if longest > reach:
            reach = longest
            out.update(outside(i, longest, base))
            if i >= done and not any(p < longest and i < q for p, _, q in base):
                out.update(more := continued(text, i, longest, base, cost))
                done = max([longest, *(q for _, q in more)])
    return out


def novel_spans(text: str, base: list[tuple[int, int, int]], cost: Cost = novelty) -> list[tuple[int, int, int]]:
    """Incompressible strings near a sensitive word, and what continues them or an assigned value, outside the base spans.

    A string that is novel at one place is reported at all of its places in the text.
    """
    found, at = set(), 0
    for a, k, b in base:
        if k == 0:
            found.update(continued(text, a, b, base, cost))
    for m in SENSITIVE.finditer(text):
        for c in CANDIDATE.finditer(text, run_start(text, at, max(at, m.start() - REACH))):
            a, b = c.span()
            if a > m.end() + REACH:
                break
            if b <= at or b - a < LEAST_CANDIDATE:
                at = max(at, b)
                continue
            at = b
            parts = [x for p in outside(a, b, base) for x in novel_parts(text, *p, cost)]
            found.update(parts)
            if parts and parts[-1][1] == b:
                found.update(more := continued(text, *parts[-1], base, cost))
                at = max([at, *(q for _, q in more)])
    return [(a, 3, b) for a, b in sorted(everywhere(text, found, base, cost))]


def all_spans(text: str, cost: Cost = novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans and the novel ones."""
    hint = hinted(text)
    base = base_spans(text, hint)
    return base, novel_spans(text, base, cost) if hint else []


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts per kind, a digest of the base spans, and all spans.

    Positions are code points, ends exclusive. Null and empty texts have no spans (the digest is that
    of the empty string); null or repeated doc_ids are kept as they are; an empty table gives no
    rows; columns other than doc_id and text are not read.
    """
    dictionary = identifiers(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = novelty_by(dictionary)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, novel = all_spans(text, cost)
                counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*counts, digest, joined(sorted(base + novel)), len(novel)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    return ids_and_texts(docs).mapInArrow(run, schema)


def masked(text: str, cost: Cost = novelty) -> str:
    """The text with every span's characters replaced by one marker per merged span."""
    out, at, (base, novel) = [], 0, all_spans(text, cost)
    merged: list[list[int]] = []
    for a, _, b in sorted(base + novel):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``[SECRET]`` (``n_chars`` follows if it was
    the length); every row stays, null texts stay null, all other columns pass through; an empty table
    gives no rows."""
    dictionary = identifiers(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = novelty_by(dictionary)
        for batch in batches:
            i = batch.schema.get_field_index("text")
            old = batch.column(i).to_pylist()
            new = [None if t is None else masked(t, cost) for t in old]
            batch = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
            j = batch.schema.get_field_index("n_chars")
            if j >= 0:
                n = [m if a is b or a == b else len(b) for a, b, m in zip(old, new, batch.column(j).to_pylist())]
                batch = batch.set_column(j, batch.schema.field(j), pa.array(n, batch.schema.field(j).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
