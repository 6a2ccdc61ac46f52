"""Fast cutting of texts into the pre-tokens of a byte-level vocabulary.

Cutting before every space that a word follows never splits a pre-token, so texts are cut into
words first, words are looked up, and only new words meet the full pattern.
"""

from __future__ import annotations

import re

import public_tokenizers
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)
#: Where a text may be cut: before a space that a word follows. No pre-token spans such a place.
CUT = re.compile(r" (?=\S)")
#: Blanks that do not stand alone between two words: such a text needs CUT, others plain splits.
ODD_BLANK = re.compile(r"\s(?:\s|$)|^\s")
ODD_PAIRS = ("  ", "\n\n", " \n", "\n ")
#: Blanks other than space and line end.
RARE_BLANK = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Signs that form one pre-token after a word.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def cut_text(text: str) -> tuple[str, list[str], bool]:
    """(first word, further words, whether the words are plain).

    Plain words follow a space, or start with the line end they follow; the others keep blanks
    of their own and follow a space.
    """
    if odd(text):
        head, *words = CUT.split(text)
        return head, words, False
    head, *words = text.replace("\n", " \n").split(" ")
    return head, words, True


def odd(text: str) -> bool:
    """Whether blanks meet or stand at an end, so that the words of the text are not plain."""
    if RARE_BLANK.search(text):
        return bool(ODD_BLANK.search(text))
    return text[:1].isspace() or text[-1:].isspace() or any(pair in text for pair in ODD_PAIRS)


class Recent:
    """A bounded cache of two generations: what was used since the last turn outlives the next."""

    def __init__(self, limit: int) -> None:
        self.limit, self.new, self.old = limit, {}, {}

    def turn(self) -> None:
        if len(self.new) > self.limit:
            self.new, self.old = {}, self.new


def of_plain(word: str) -> list[str]:
    """Pre-tokens of a plain word with what stands before it."""
    stem = word.rstrip(SIGNS)
    if stem.isalpha():
        return [" " + stem, word[len(stem):]] if len(stem) < len(word) else [" " + stem]
    return PATTERN.findall(word if word[0] == "\n" else " " + word)
