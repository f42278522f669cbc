"""Rule-based quality filter that cleans lines first and then judges what is left.

Each line with a word is tested by itself. Failing lines are removed; a document is rejected when
it loses too much of its text, or when its base statistics are bad. Everything about a document
follows from its own text, so the work needs no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import hash_words, map_texts, shadowed, windows

SYMBOLS = b"#*$%&|<>"
SYMBOL_RUN = re.compile(rb"[#*$%&|<>]{2,}")
CAPITALS = bytes(range(65, 91))
SMALL = bytes(range(97, 123))
BLANKS = b" \t\n\r\x0b\x0c"
#: Ends of a sentence, also inside closing quotes and brackets.
SENTENCE_ENDS = tuple(c.encode() for c in ".!?:;…。！？\"')]”’»")
#: Words that stand between the entries of a menu.
SEPARATORS = frozenset(c.encode() for c in ("|", "»", "›", "·", "•", "::", ">", "<", "/"))
#: Phrases of page furniture, in lower case.
FURNITURE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here", "read more", "sign up", "log in", "enable javascript", "subscribe to our newsletter", "skip to content", "back to top")
FURNITURE_PATTERN = re.compile("|".join(map(re.escape, FURNITURE)).encode())


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the verdict."""

    stub_words: int = 4  # a line of fewer words that ends no sentence fails
    separators: int = 3  # a line with so many separators ...
    separator_pct: int = 20  # ... that are so much of its words fails
    furniture_words: int = 15  # a line of at most so many words with a furniture phrase fails
    symbol_pct: int = 30  # runs of symbols against words
    shout_letters: int = 20  # a line with so many ASCII letters ...
    shout_pct: int = 60  # ... of which more than this share are capitals fails
    stutter_words: int = 8  # a line of so many words ...
    stutter_pct: int = 30  # ... of which more than this share equal the word before fails
    min_words: int = 20
    repeat_width: int = 8
    repeat_pct: int = 30
    lost_pct: int = 50  # a document that loses more than this share of its words is rejected


def line_fails(line: bytes, words: list[bytes], rules: Rules) -> bool:
    """Whether a line with words breaks a punctuation, navigation, boilerplate or shape rule."""
    n = len(words)
    if n < rules.stub_words and not words[-1].endswith(SENTENCE_ENDS):
        return True
    if n >= rules.stutter_words and 100 * sum(map(eq, words, words[1:])) > rules.stutter_pct * n:
        return True
    if 100 * len(SYMBOL_RUN.findall(line)) >= rules.symbol_pct * n:
        return True
    between = sum(map(SEPARATORS.__contains__, words))
    if between >= rules.separators and 100 * between >= rules.separator_pct * n:
        return True
    if n <= rules.furniture_words and FURNITURE_PATTERN.search(line.lower()):
        return True
    capitals = len(line) - len(line.translate(None, CAPITALS))
    if 2 * capitals > len(line) // 4:
        letters = capitals + len(line) - len(line.translate(None, SMALL))
        return letters >= rules.shout_letters and 100 * capitals > rules.shout_pct * letters
    return False


def repeated_words(words: list[bytes], width: int) -> int:
    """Words inside windows of ``width`` words that occur at least twice, first ones included."""
    if len(words) < width + 1:
        return 0
    found = windows(hash_words(words), width)
    ordered = np.sort(found)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(found, twice))
    change = np.zeros(len(words) + 1, np.int64)
    change[starts] += 1
    change[starts + width] -= 1
    return int(np.count_nonzero(np.cumsum(change)))


def judge(text: bytes, rules: Rules) -> tuple:
    """(words, their characters, symbols, repeated lines, repeated words, base failed, kept, cleaned text)."""
    words = text.split()
    n = len(words)
    chars = len(text.decode()) - (len(text) - len(text.translate(None, BLANKS)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, again, left, clean = set(), 0, 0, []
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            clean.append(line)
            continue
        if line in seen:
            again += 1
        else:
            seen.add(line)
        if not line_fails(line, own, rules):
            left += len(own)
            clean.append(line)
    repeats = repeated_words(words, rules.repeat_width)
    base_failed = n < rules.min_words or 100 * repeats > rules.repeat_pct * n
    kept = not base_failed and 100 * (n - left) <= rules.lost_pct * n
    return n, chars, symbols, again, repeats, base_failed, kept, b"\n".join(clean).decode()


FIELDS = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")]


def quality_rules(docs: DataFrame, text_col: str = "text", clean_col: str | None = None, rules: Rules = Rules(), keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (default: all), the counts, ``base_failed``, ``kept`` and, named by ``clean_col``, the cleaned text.

    A null or empty text has no words and fails the base rules. Every row, also a repeated one, is
    judged by its own text alone; a column named like a result gives way to it.
    """
    fields = FIELDS + ([T.StructField(clean_col, T.StringType())] if clean_col else [])

    def build():
        def run(texts: list[bytes]) -> list:
            rows = list(zip(*(judge(t, rules) for t in texts))) or [()] * 8
            return [list(c) for c in rows[: len(fields)]]

        return run

    return map_texts(docs, text_col, T.StructType(fields), build, keep)


def clean_documents(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Documents that pass, with their cleaned text; the columns of the input, in their order."""
    renamed, names = shadowed(docs)
    judged = quality_rules(renamed, names[text_col], "clean", rules)
    return judged.where("kept").select(*[F.col("clean" if c == text_col else own).alias(c) for c, own in names.items()])
