"""Token ids of whole texts through the tokenizers library, with a cache of words in front of it.

The vocabulary `word_bpe_49k.json` lower-cases, drops white space and splits
letters, digits and other signs, so the ids of a text are the ids of its
white-space words one after the other. Words repeat: each is encoded once per
cache filling, many missing words in one call. That shortcut is taken only for
texts within Latin-1 without the opening of a special token; there the Unicode
normal form is the text itself and lower case maps one letter to one. All other
texts go to the library as they are.
"""

from __future__ import annotations

import re

VOCABULARY = "word_bpe_49k.json"
VOCABULARY_SIZE = 49_408
CACHE_BYTES = 48 << 20  # of a cache generation; two caches hold two each, so memory is bounded whatever the corpus
ENTRY_BYTES = 160  # of the objects around a word and its ids

LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{LETTER}{NUMBER}]+"


def _lowered() -> bytes:
    table = bytearray(range(256))
    for i in range(256):
        low = chr(i).lower()
        if len(low) == 1 and ord(low) < 256:
            table[i] = ord(low)
    table[0x85] = table[0xA0] = 0x20
    return bytes(table)


class Cache(dict):
    """Two generations: words used lately survive the turn, the rest is forgotten and encoded again when met."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old, self.unknown, self.size = limit, {}, set(), 0

    def learn(self, word: bytes, ids: bytes) -> None:
        self[word] = ids
        self.size += len(word) + len(ids) + ENTRY_BYTES

    def __missing__(self, word: bytes) -> bytes | None:
        value = self.old.get(word)
        if value is None:
            self.unknown.add(word)
        else:
            self.learn(word, value)
        return value

    def turn(self) -> None:
        if self.size >= self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0


class Encoder:
    """`encode` gives the ids of each text as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.whole = Tokenizer.from_file(path)
        self.simple = path.endswith(VOCABULARY)
        self.lowered = _lowered()
        self.cut = re.compile(PIECE.encode("latin-1")).findall
        # Pieces are already normalised and cut: the same model without those steps.
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words, self.pieces = Cache(CACHE_BYTES), Cache(CACHE_BYTES)
        self.ends = self._ends()

    def _ends(self):
        import numpy as np

        vocabulary = self.whole.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        return ends

    def _library(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self) -> None:
        """Encode the unknown words: cut them as the library does, encode their new pieces in a few calls."""
        import numpy as np

        words, pieces = self.words, self.pieces
        cut = {w: self.cut(w) for w in words.unknown}
        words.unknown.clear()
        pieces.turn()
        known = {w: list(map(pieces.__getitem__, ps)) for w, ps in cut.items()}
        new = list(pieces.unknown)
        pieces.unknown.clear()
        for first in range(0, len(new), 1000):
            group = new[first : first + 1000]
            ids = np.asarray(self.model.encode_batch_fast([b" ".join(group).decode("latin-1")], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(group):
                raw, begin = ids.tobytes(), 0
                for p, stop in zip(group, (4 * stops).tolist()):
                    pieces.learn(p, raw[begin:stop])
                    begin = stop
            else:
                for p in group:
                    pieces.learn(p, self._library(p.decode("latin-1")))
        for w, values in known.items():
            if None in values:
                values = map(pieces.__getitem__, cut[w])
            words.learn(w, b"".join(values))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        import gc

        on = gc.isenabled()
        gc.disable()  # many short-lived lists and no cycles: the collector would only walk the caches
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[bytes | None]) -> list[bytes]:
        words = self.words
        words.turn()
        split, values = [], []
        for text in texts:
            try:
                if not self.simple or text and b"<|" in text:
                    raise ValueError
                split.append((text or b"").decode("utf-8").encode("latin-1").translate(self.lowered).split())
                values.append(list(map(words.__getitem__, split[-1])))
            except ValueError:
                split.append(None)
                values.append([self._library((text or b"").decode("utf-8"))])
        if words.unknown:
            self._learn()
            for ws, found in zip(split, values):
                at = -1
                try:
                    while True:
                        at = found.index(None, at + 1)
                        found[at] = words[ws[at]]
                except ValueError:  # no more gaps
                    pass
        return [b"".join(found) for found in values]


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder. It hangs on the vocabulary module, so a reused worker keeps its cache from task to task of one operator; `common.released` drops it."""
    import public_tokenizers

    kept = public_tokenizers.__dict__.setdefault("encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
