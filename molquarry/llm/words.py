"""Texts to words for whole batches at once: one pass of each pattern over all texts of a batch."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

#: Letters that look like Latin ones (fixed values).
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ɑ": "a",
}
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿\x00]+")
_FOREIGN = re.compile("[^\x00-\x7f]+")
_MARKUP = re.compile(r"<[^<>\x00]{1,300}>|&#?[a-z0-9]{2,8};")
_WORD = re.compile(r"[^\W_]+|\x00")
#: Between two texts of a batch.
END = "\x00"


def _latin(run: str, known: dict[str, str] = {}) -> str:  # noqa: B006 - a cache
    got = known.get(run)
    if got is None:
        folded = unicodedata.normalize("NFKC", run)
        if any("̀" <= c <= "ͯ" for c in folded):
            folded = unicodedata.normalize("NFC", folded)
        got = _INVISIBLE.sub("", folded).lower()
        got = "".join(LOOK_ALIKES.get(c, c) for c in got)
        if len(known) < 100_000:
            known[run] = got
    return got


_CAPITAL = re.compile(r"\n(?=[ \t>]*[A-Z])")
_MISDECODED = re.compile("[\u00c2-\u00f4][\u0080-\u00bf]{1,3}")
#: What the bytes 80 to 9f became where a text was read as Windows-1252 (fixed values: that code page).
_WINDOWS = {ord(bytes([b]).decode("cp1252")): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _decoded(m: re.Match) -> str:
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def mended(text: str) -> str:
    """UTF-8 that was read byte by byte as a Western code page, read right."""
    if "\u00c3" in text or "\u00c2" in text or "\u00e2" in text or "\u00ce" in text or "\u00d0" in text:
        return _MISDECODED.sub(_decoded, text.translate(_WINDOWS) if "\u20ac" in text or "\u0153" in text else text)
    return text


def folded(texts: list[str], lines: bool = False) -> str:
    """All texts, each closed by END: in lower case, compatibility forms and look-alikes folded, without invisible characters.

    lines: a line that begins with a capital letter gets a blank line before it.
    """
    whole = END.join(mended(t.replace(END, "") if END in t else t) for t in texts) + END if texts else ""
    whole = _FOREIGN.sub(lambda m: _latin(m.group()), whole)
    return (_CAPITAL.sub("\n\n", whole) if lines else whole).lower()


def batch_words(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """(words of all texts, where each text begins among them and, last, where all end), markup left out."""
    words = _WORD.findall(_MARKUP.sub(" ", folded(texts)))
    ends = np.flatnonzero(np.fromiter((w == END for w in words), bool, len(words)))
    return words, np.concatenate([[0], ends + 1]).astype(np.int64)


_BLOCK = re.compile(r"</?(?:p|div|li|ul|ol|h[1-6]|tr|td|th|table|blockquote|pre|hr)\b[^<>\x00]{0,300}>")
_CODE = re.compile(r"[^\s\x00]{25,}")
#: Letters only; an end of sentence; a blank line; the end of a text.
_PROSE = re.compile("[^\\W\\d_]{2,}|[.!?;\u2026](?=[\\s\"')\\]\x00])|\n(?=[ \t>]*\n)|\x00")
_BREAKS = frozenset(".!?;\u2026\n")


class Numbers(dict):
    """Numbers words from 1 as they come; stops have theirs. A word's own hash is the same in every task."""

    def __init__(self) -> None:
        super().__init__(STOPS)
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        self.words.append(word)
        self[word] = n = len(self.words)
        return n


def batch_sentences(texts: list[str], number: Numbers) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, their numbers, first and last + 1 token of each sentence, text of each sentence).

    Sentences end at full stops, blank lines and block markup, not at line ends. Tokens are words of letters. Runs of
    25 and more characters without a blank are codes and left out.
    """
    whole = _CODE.sub(" ", _MARKUP.sub(" ", _BLOCK.sub("\n\n", folded(texts, lines=True))))
    tokens = _PROSE.findall(whole)
    numbers = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
    stop = numbers < 0
    ends = np.flatnonzero(stop)
    first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    text = np.cumsum(numbers == STOPS[END]) if len(ends) else ends
    text = np.concatenate([[0], text[:-1]])[first] if len(ends) else ends
    filled = ends > first
    return tokens, numbers, first[filled], ends[filled], text[filled]


#: The numbers of tokens that aren't words.
STOPS = {**{c: -1 for c in _BREAKS}, END: -2}
