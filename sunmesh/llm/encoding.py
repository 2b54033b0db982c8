"""Encoding of whole texts with a public tokenizer, a word at a time and each word once per worker.

The vocabulary's normaliser and pattern never let a token cross ASCII white
space, so a text's ids are its words' ids in order. Words repeat, which makes
the table of known words the fast path; a text that may hold a special token
is encoded as one piece.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sunmesh.llm.common import keeps, only

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers, and their bytes, before it starts again.
REMEMBERED, REMEMBERED_BYTES = 1_350_000, 64 << 20
#: Texts that are encoded together.
STEP = 512
#: A word that ends in ASCII marks other than the apostrophe: the pattern cuts between an ASCII letter and these.
_MARKED = re.compile(rb"([a-z\x80-\xff]*[a-z])([!-&(-/:-@\[-`{-~]+)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The place of a public vocabulary; executors ask their own installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Codes(dict):
    """Word to its number; new words queue up in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.held = 0

    def __missing__(self, word):
        code = self[word] = len(self)
        self.held += len(word)
        self.new.append(word)
        return code


class WordEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.remembered = remembered
        self._forget()

    @property
    def size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _forget(self) -> None:
        self.codes = _Codes()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.offset = self.length = np.zeros(0, np.int64)

    def _append(self, codes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Give ``codes`` their ids, which follow one another in ``ids``."""
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.offset[codes] = self.used + np.cumsum(lengths) - lengths
        self.length[codes] = lengths
        self.used += len(ids)

    def _ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = self.length[codes]
        before = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[np.repeat(self.offset[codes] - before[:-1], lengths) + np.arange(before[-1])], before

    def _encode_plain(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Many words are encoded as one text; offsets tell whose an id is."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for begin in range(0, len(words), 5000):
            part = [w.decode() for w in words[begin : begin + 5000]]
            starts = np.cumsum([0] + [len(w) + 1 for w in part[:-1]])
            encoded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids.append(np.array(encoded.ids, np.uint32))
            at = np.fromiter((o[0] for o in encoded.offsets), np.int64, len(ids[-1]))
            lengths.append(np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self) -> None:
        code, plain, marked, letters = len(self.length), [], [], []
        for word in self.codes.new:  # grows by the stems of marked words
            if word.isalpha():
                letters.append((code, word))
            elif cut := _MARKED.fullmatch(word):
                marked.append((code, self.codes[cut[1]], self.codes[cut[2]]))
            else:
                plain.append((code, word))
            code += 1
        grown = np.zeros(code - len(self.length), np.int64)
        self.offset, self.length = np.concatenate([self.offset, grown]), np.concatenate([self.length, grown])
        self._append(np.array([c for c, _ in plain], np.int64), *self._encode_plain([w for _, w in plain]))
        # Words of ASCII letters pass the normaliser and the pattern unchanged, so the model alone gives their ids.
        found = [[t.id for t in self.model.tokenize(w.decode())] for _, w in letters]
        self._append(np.array([c for c, _ in letters], np.int64), np.array([i for ids in found for i in ids], np.uint32), np.array(list(map(len, found)), np.int64))
        if marked:
            parts = np.array(marked, np.int64)
            ids, before = self._ids(parts[:, 1:].ravel())
            self._append(parts[:, 0], ids, np.diff(before[::2]))
        self.codes.new.clear()

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text; null and empty texts have none.

        A batch's words are told apart once in Arrow; only its distinct words are looked up.
        """
        if len(self.codes) > self.remembered or self.codes.held > REMEMBERED_BYTES:
            self._forget()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        special, whole = pc.fill_null(pc.match_substring(texts, "<|"), False), {}
        if special.true_count:
            for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)):
                whole[int(i)] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            texts = pc.if_else(special, "", texts)
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(split.value_lengths(), 0).to_numpy(zero_copy_only=False))])
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if self.codes.new:
            self._learn()
        ids, before = self._ids(codes[coded.indices.to_numpy()])
        lengths = np.diff(before[ends])
        if whole:
            at = before[ends]
            pieces = [whole.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(at, at[1:]))]
            ids, lengths = np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        return ids, lengths

    def lengths(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        return self.encode(texts)[1]


_encoders: dict[str, WordEncoder] = {}


keeps("encoder", _encoders.clear)


def encoder(name: str = VOCABULARY, remembered: int = REMEMBERED) -> WordEncoder:
    """The worker's encoder: it keeps its known words, some 140 bytes each, from one task to the next."""
    only("encoder")
    if name not in _encoders:
        _encoders[name] = WordEncoder(vocabulary_path(name) if os.sep not in name else name)
    _encoders[name].remembered = remembered
    return _encoders[name]
