"""Dense statistics of whole texts for the classifiers, a batch of texts at a time."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

#: The longest word that a worker remembers.
LONGEST = 64
#: Bytes that the statistics tell apart.
_CLASSES = np.zeros(256, np.int64)
for _i, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\x0b\x0c\r", b".,;:", b"!?", b"'\"()-", b"#$%&*@^~|\\/<>[]{}=+_`"), 1):
    _CLASSES[list(_members)] = _i
_CLASSES[128:] = 10

QUALITY = (
    "log_words", "mean_word", "long_words", "distinct", "repeated_next", "top_share", "lower", "upper", "digit", "space", "breaks", "stops", "shouts", "quotes", "symbols", "foreign",
    "marked_ends", "line_words", "distinct_lines", "shouted_words", "short_words",
)


def class_counts(data: bytes) -> np.ndarray:
    """How many bytes of each class; continuation bytes count as foreign."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, np.int64)
    return np.bincount(_CLASSES, weights=counts, minlength=11)


def quality_statistics(text: str | None) -> list[float]:
    """Sizes, repetition, character classes and line structure; null and empty texts are all zero."""
    data = text.encode() if text else b""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(QUALITY)
    kinds = class_counts(data) / len(data)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    shouted = sum(map(bytes.isupper, words))
    marked = sum(w[-1] in b"#$%&*@|!" for w in words)
    return [
        float(np.log1p(n)), float(lengths.mean()), float((lengths > 12).mean()), len(counts) / n, again / n, max(counts.values()) / n, *kinds[[1, 2, 3, 4, 5, 6, 7, 8, 9, 10]],
        marked / n, float(np.log1p(n / max(1, len(lines)))), len(set(lines)) / max(1, len(lines)), shouted / n, float((lengths <= 2).mean()),
    ]


# Words of the second person in the languages of the corpus.
SECOND_PERSON = {"you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "tú", "ti", "tus", "usted", "vosotros"}
# Characters that stand for a letter in disguised words.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGES = ".,;:!?\"'()[]{}<>«»„“”…-*_~#%&|"
_INSIDE = re.compile(r"[.\-_*~+'`^|]")
NEAR = 5

TOXICITY = (
    "word_density", "stem_density", "word_count", "stem_count", "word_top", "stem_top", "near_second", "second_density", "upper", "shouted_words", "shouts", "marks", "symbols", "obfuscated", "obfuscated_listed", "log_words",
)


def plain_word(word: str) -> str:
    return word.strip(_EDGES).lower()


def undisguised(word: str) -> str:
    """The word without marks between its letters and with letters for the digits and signs that stand for them."""
    return _INSIDE.sub("", plain_word(word)).translate(DISGUISES)


def looks_disguised(word: str) -> bool:
    """Letters mixed with marks, digits or signs inside the word."""
    core = word.strip(_EDGES)
    return len(core) > 2 and not core.isalpha() and not core.isdigit() and any(c.isalpha() for c in core)


def stems(word: str) -> list[str]:
    """Beginnings that a list of inflected words may share."""
    return [word[:k] + "*" for k in (4, 5, 6) if len(word) >= k]


class Lexicon:
    """Weights of words and of word beginnings; every word's part in a text's statistics is worked out once."""

    def __init__(self, weights: dict[str, float], remembered: int = 400_000):
        self.words = {w: x for w, x in weights.items() if not w.endswith("*")}
        self.stems = {w: x for w, x in weights.items() if w.endswith("*")}
        self.remembered, self.known = remembered, {}

    def _row(self, word: str) -> tuple:
        """What ``_look_up`` gives, or nothing if the word counts nowhere; very long words aren't remembered."""
        row = self._look_up(word)
        row = () if row == (0.0, 0.0, False, False, False) else row
        if len(word) <= LONGEST:
            self.known[word] = row
        return row

    def _look_up(self, word: str) -> tuple:
        plain, disguised = plain_word(word), looks_disguised(word)
        spelt = undisguised(word) if disguised else plain
        own = max(self.words.get(plain, 0.0), self.words.get(spelt, 0.0))
        stem = max((self.stems.get(s, 0.0) for s in stems(spelt)), default=0.0)
        return own, stem, plain in SECOND_PERSON, len(word) > 1 and word.isupper(), disguised

    def statistics(self, text: str | None) -> list[float]:
        """The ``TOXICITY`` values; null and empty texts are all zero."""
        words = text.split() if text else []
        n = len(words)
        if not n:
            return [0.0] * len(TOXICITY)
        if len(self.known) > self.remembered:
            self.known.clear()
        known, own, stem, second, upper, odd = self.known, [], [], [], 0, []
        for i, word in enumerate(words):
            row = known.get(word)
            if row is None:
                row = self._row(word)
            if row:
                a, b, you, shouted, disguised = row
                upper += shouted
                if a:
                    own.append((i, a))
                if b:
                    stem.append((i, b))
                if you:
                    second.append(i)
                if disguised:
                    odd.append((i, a > 0 or b > 0))
        kinds = class_counts(text.encode())
        size = kinds.sum()
        listed = np.array(sorted({i for i, _ in own} | {i for i, _ in stem}))
        near = float((np.abs(listed[:, None] - np.array(second)[np.clip(np.searchsorted(second, listed)[:, None] + [-1, 0], 0, len(second) - 1)]).min(1) <= NEAR).mean()) if len(listed) and second else 0.0
        return [
            sum(x for _, x in own) / n, sum(x for _, x in stem) / n, float(np.log1p(len(own))), float(np.log1p(len(stem))), max((x for _, x in own), default=0.0), max((x for _, x in stem), default=0.0), near, len(second) / n,
            kinds[2] / size, upper / n, kinds[7] / size, kinds[6] / size, kinds[9] / size, len(odd) / n, sum(x for _, x in odd) / n, float(np.log1p(n)),
        ]
