"""Text checks: the first pattern of an ordered list that occurs in a text.

Patterns are regular expressions, searched without regard to case. Short lists of patterns that mean the same
to the JVM (`portable` rewrites them) stay in the JVM. All others run as they stand, in batches: an automaton of one
required literal or more of each pattern reads a text once and names the patterns that may occur; these are
tried in the order of the list until one does, so that time hardly grows with the list. Patterns without such a literal are
always tried. Both ways give the hit that trying all patterns one after the other gives.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re import _constants as op
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lists up to this length are searched in the JVM, pattern by pattern.
JVM_PATTERNS = 16
#: What counts as white space, as a class of the JVM's expressions.
WHITE = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters that match an ASCII letter if case is ignored, beside its other case.
ALIKE = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}
FOLD = {**{c: chr(c + 32) for c in range(65, 91)}, **ALIKE}
REPEATS = (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT)


def usable_patterns(lines: list[str], strip_prefix: bool = False) -> list[str]:
    """Patterns of a list file in order: blanks and # lines are skipped, what is no pattern is taken literally.

    A leading `re:` is part of the pattern unless strip_prefix.
    """
    out = []
    for line in lines:
        s = line.strip().lstrip("﻿")
        if not s or s.startswith("#"):
            continue
        if strip_prefix and s.startswith("re:"):
            s = s[3:]
        try:
            re.compile(s, re.IGNORECASE)
        except re.error:
            s = re.escape(s)
        out.append(s)
    return out


def portable(pattern: str) -> str | None:
    """The same search as an expression of the JVM; null where it may differ there."""

    def one(code, value) -> str | None:
        if code is op.LITERAL:
            return "\\x{%x}" % value if value < 128 else None
        if code is op.ANY:
            return "[^\n]"
        if code is op.IN:
            parts = [member(*m) for m in value]
            return None if None in parts else "[" + "".join(parts) + "]"
        if code is op.BRANCH:
            parts = [sequence(b) for b in value[1]]
            return None if None in parts else "(?:" + "|".join(parts) + ")"
        if code is op.SUBPATTERN:
            inner = sequence(value[3])
            return None if inner is None or value[1] or value[2] else f"(?:{inner})"
        if code in REPEATS:
            inner, most = sequence(value[2]), "" if value[1] is op.MAXREPEAT else value[1]
            tail = {op.MAX_REPEAT: "", op.MIN_REPEAT: "?", op.POSSESSIVE_REPEAT: "+"}[code]
            return None if inner is None else "(?:%s){%d,%s}%s" % (inner, value[0], most, tail)
        return None

    def member(code, value) -> str | None:
        if code is op.LITERAL and value < 128:
            return "\\x{%x}" % value
        if code is op.RANGE and value[1] < 128:
            return "\\x{%x}-\\x{%x}" % value
        if code is op.CATEGORY and value is op.CATEGORY_SPACE:
            return WHITE
        return None

    def sequence(items) -> str | None:
        parts = [one(*item) for item in items]
        return None if None in parts else "".join(parts)

    tree = parser.parse(pattern, re.IGNORECASE)
    return None if tree.state.flags != re.IGNORECASE | re.UNICODE else sequence(tree)


def required(pattern: str) -> tuple[str, ...]:
    """Folded literals of which every match of pattern holds one; empty where none is known."""

    def of(items) -> tuple[str, ...]:
        found, run = [], ""
        for code, value in [*items, (None, None)]:
            if code is op.LITERAL and value < 128:
                run += chr(value).translate(FOLD)
                continue
            found += [(run,)] if run else []
            run = ""
            if code is op.BRANCH:
                parts = [of(b) for b in value[1]]
                found += [tuple(x for p in parts for x in p)] if all(parts) else []
            elif code is op.SUBPATTERN:
                found.append(of(value[3]))
            elif code is op.ATOMIC_GROUP:
                found.append(of(value))
            elif code in REPEATS and value[0] > 0:
                found.append(of(value[2]))
        return max((f for f in found if f), key=lambda f: min(map(len, f)), default=())

    return of(parser.parse(pattern, re.IGNORECASE))


class FirstHit:
    """The first pattern of a list that occurs in a text."""

    def __init__(self, patterns: tuple[str, ...]):
        import ahocorasick

        self.patterns, self.compiled = patterns, {}
        self.always, literals, self.plain = [], {}, set()
        for i, p in enumerate(patterns):
            held = required(p)
            if not held:
                self.always.append(i)
            elif len(held) == 1 and len(held[0]) == len(p) and p.translate(FOLD) == held[0]:
                self.plain.add(i)  # the literal is the pattern
            for x in held:
                literals.setdefault(x, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for x, numbers in literals.items():
            self.automaton.add_word(x, numbers)
        if literals:
            self.automaton.make_automaton()

    def __call__(self, text: str) -> str | None:
        may, seen = set(self.always), set()
        if len(self.automaton):
            for _, numbers in self.automaton.iter(text.translate(FOLD)):
                if id(numbers) not in seen:  # a literal counts once a text
                    seen.add(id(numbers))
                    may.update(numbers)
        for i in sorted(may):
            if i in self.plain or self._compiled(i).search(text):
                return self.patterns[i]
        return None

    def _compiled(self, i: int) -> re.Pattern:
        if i not in self.compiled:
            self.compiled[i] = re.compile(self.patterns[i], re.IGNORECASE)
        return self.compiled[i]


@lru_cache(maxsize=4)
def _searcher(patterns: tuple[str, ...]) -> FirstHit:
    return FirstHit(patterns)


def first_hit(text: Column, patterns: list[str]) -> Column:
    """The first of a few portable patterns that occurs in text, ignoring case; null if none does."""
    if not patterns:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(text.rlike(f"(?iu){portable(p)}"), F.lit(p)) for p in patterns])


def in_jvm(patterns: list[str]) -> bool:
    return len(patterns) <= JVM_PATTERNS and all(portable(p) is not None for p in patterns)


def stripped(text: Column) -> Column:
    """text without white space at its ends."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"\\A[{WHITE}]+|[{WHITE}]+\\z", "")


def text_check(texts: DataFrame, media: str, text: str, patterns: list[str], least: int = 3, shown: int = 0) -> DataFrame:
    """media, score and hit of joined texts, stripped first; texts shorter than `least` are not searched.

    With shown, also text: so many characters of what was searched, empty where nothing was.
    """
    whole = texts.select(media, stripped(F.col(text)).alias("_whole"))
    if in_jvm(patterns):
        hit = F.when(F.length("_whole") >= least, first_hit(F.col("_whole"), patterns))
        # An array of one, opened again, keeps the optimizer from copying the search into every column that reads it.
        found = whole.select(media, "_whole", F.explode(F.array(hit)).alias("hit"))
    else:
        listed = tuple(patterns)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = _searcher(listed)
            for b in batches:
                hits = [first(t) if len(t) >= least else None for t in (x.as_py() for x in b.column(1))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.string())], [*b.schema.names, "hit"])

        found = whole.mapInArrow(search, f"`{media}` {whole.schema[media].dataType.simpleString()}, _whole string, hit string")
    told = [F.when(F.length("_whole") >= least, F.substring("_whole", 1, shown)).otherwise("").alias("text")] if shown else []
    return found.select(media, F.when(F.col("hit").isNotNull(), 1.0).otherwise(0.0).alias("ocr_match"), "hit", *told)


def joined_texts(frames: DataFrame, media: str, position: str, text: str) -> DataFrame:
    """Non-empty frame texts of each item, in order, joined by line breaks."""
    parts = F.sort_array(F.collect_list(F.when(F.col(text) != "", F.struct(position, text))))
    return frames.groupBy(media).agg(F.array_join(F.transform(parts, lambda x: x[text]), "\n").alias("text"))
