"""What a substring search is asked for: words and "quoted phrases", AND, OR, NOT, brackets and NEAR.

A question is read into a tree over its words (JSON, words by their place in a list); no tree means that the
question is no expression, which finds nothing.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right

#: Shortest word that has a trigram.
LEAST_WORD = 3
#: Fixed value: how far apart the words of a NEAR may be where it doesn't say.
NEAR_WITHIN = 10
LEXEME = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<bare>[A-Za-z0-9_\x1a\u0080-\U0010ffff]+)|(?P<mark>[()+*^,]))')


class NoExpression(ValueError):
    """The question is none."""


class _Reader:
    """Reads one question; every method takes what it can from the lexemes on."""

    def __init__(self, question: str):
        self.lexemes, self.words, at = [], [], 0
        question = question.rstrip()
        while at < len(question):
            m = LEXEME.match(question, at)
            if m is None:
                raise NoExpression
            self.lexemes.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.lexemes.append(("end", ""))
        self.at = 0

    def next_is(self, *kinds: str) -> bool:
        kind, said = self.lexemes[self.at]
        return kind in kinds or said in kinds and kind != "quoted"

    def take(self, *kinds: str) -> str:
        if not self.next_is(*kinds):
            raise NoExpression
        self.at += 1
        return self.lexemes[self.at - 1][1]

    def joined(self, by: str, part) -> list:
        """Parts with ``by`` between them: NOT binds most tightly, then AND, then OR, each from the left."""
        found = [part()]
        while self.next_is(by):
            self.take(by)
            found.append(part())
        return found

    def any_of(self) -> list:
        parts = self.joined("OR", self.all_of)
        return parts[0] if len(parts) == 1 else ["or", parts]

    def all_of(self) -> list:
        parts = self.joined("AND", self.but)
        return parts[0] if len(parts) == 1 else ["and", parts]

    def but(self) -> list:
        first, *rest = self.joined("NOT", self.unit)
        for other in rest:
            first = ["not", [first, other]]
        return first

    def unit(self) -> list:
        """A bracket, or phrases one after another, all of which have to occur. Phrases too short to be found say
        nothing beside others."""
        if self.next_is("("):
            self.take("(")
            inner = self.any_of()
            self.take(")")
            return inner
        found = [self.phrase()]
        while self.next_is("quoted", "bare", "^") and not self.next_is("AND", "OR", "NOT"):
            found.append(self.phrase())
        told = [f for f in found if f is not None]
        return told[0] if len(told) == 1 else ["and", told] if told else ["never"]

    def phrase(self) -> list | None:
        """A phrase, one at the start of a text (^), or a NEAR; None if it is too short."""
        if self.next_is("NEAR") and self.lexemes[self.at + 1] == ("mark", "("):
            return self.near()
        first = self.next_is("^")
        if first:
            self.take("^")
        word = self.string()
        return word if word is None or word == ["never"] or not first else ["first", word[1]]

    def near(self) -> list | None:
        self.take("NEAR")
        self.take("(")
        found = [self.string()]
        while not self.next_is(",", ")"):
            found.append(self.string())
        within = NEAR_WITHIN
        if self.next_is(","):
            self.take(",")
            said = self.take("bare")
            if not said.isascii() or not said.isdigit():
                raise NoExpression
            within = int(said)
        self.take(")")
        told = [f for f in found if f is not None]
        if ["never"] in told:
            return ["never"]
        return told[0] if len(told) == 1 else ["near", within, [w[1] for w in told]] if told else None

    def string(self) -> list | None:
        """A phrase's strings, joined by +; trigrams that follow each other overlap by two characters."""
        said, never = "", False
        while True:
            if self.next_is("AND", "OR", "NOT"):
                raise NoExpression
            text = self.take("quoted", "bare")
            text = text[1:-1].replace('""', '"') if self.lexemes[self.at - 1][0] == "quoted" else text
            if self.next_is("*"):
                self.take("*")
            if len(text) >= LEAST_WORD:
                never |= bool(said) and said[-2:].lower() != text[:2].lower()
                said = said + text[2:] if said else text
            if not self.next_is("+"):
                break
            self.take("+")
        if never:
            return ["never"]
        if not said:
            return None
        if said not in self.words:
            self.words.append(said)
        return ["word", self.words.index(said)]


def parsed(question: str | None) -> tuple[list[str], str | None]:
    """A question's words and its tree: ``["word", i]``, ``["first", i]``, ``["near", n, [i, ...]]``, ``["never"]``,
    and ``["and" | "or", trees]``, ``["not", [tree, tree]]``. Null and what is no expression have neither."""
    try:
        reader = _Reader(question or "")
        tree = reader.any_of()
        reader.take("end")
    except (NoExpression, RecursionError):
        return [], None
    return reader.words, json.dumps(tree)


def near_counts(starts: list[list[int]], sizes: list[int], within: int) -> list[int]:
    """How many places of every phrase are part of a NEAR: each phrase has a place whose end, in trigrams, is at most
    ``within`` before the place of the last one. 0 for all if there is no such set. ``starts`` are in order."""
    counts, ends = [0] * len(starts), [0] * len(starts)
    # Places in reach are a window of each phrase's, and windows only move on.
    for last in sorted({p for ps in starts for p in ps}):
        held = [(bisect_left(ps, last - size - within), bisect_right(ps, last)) for ps, size in zip(starts, sizes)]
        if all(a < b for a, b in held):
            for i, (a, b) in enumerate(held):
                counts[i] += b - max(a, ends[i]) if b > ends[i] else 0
                ends[i] = max(ends[i], b)
    return counts
