"""Token ids of whole texts, the same as the tokenizer's own, with each distinct word encoded once.

The tokenizer splits a text at white space and word class before it merges, so
the ids of a text are the ids of its words one after another. Words come back
often; a worker keeps the ids of the words it has met, up to a bound, and only
asks the tokenizer for new ones, many at a time.

The short way is taken for texts of characters whose lower case and white space
need no context; any other text goes through the tokenizer whole.
"""

from __future__ import annotations

import re

import numpy as np
import regex

#: Characters of the short way: printable ASCII, tab and line ends, and Latin letters and signs whose lower case is one character.
_SIMPLE = re.compile("[^\t\n\r -~¡-įı-ɏ]")
#: What the tokenizer's own splitting yields; FIXED VALUE, from the vocabulary file.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_END = "</w>"


_ALNUM_SPACE = b"abcdefghijklmnopqrstuvwxyz0123456789 \n"
_LATIN = bytes(range(0x80, 0xC0)) + bytes(range(0xC3, 0xCA))
_STOPS = b".,"


class _Pieces(dict):
    """Number of each white-space separated piece; pieces not met before wait to be encoded."""

    def __init__(self) -> None:
        self.waiting: list[str] = []

    def __missing__(self, piece: str) -> int:
        k = self[piece] = len(self)
        self.waiting.append(piece)
        return k


def _grown(x: np.ndarray, n: int) -> np.ndarray:
    return x if n <= len(x) else np.concatenate([x, np.empty(max(n - len(x), len(x) // 2), x.dtype)])


class Encoder:
    """Encodes batches of texts. path: a vocabulary file of the tokenizers library."""

    def __init__(self, path: str, most_pieces: int = 900_000) -> None:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, k in vocabulary.items():
            self.ends[k] = token.endswith(_END)
        self.by_word = self.tokenizer.model.end_of_word_suffix == _END
        self.most = most_pieces
        self._reset()

    def _reset(self) -> None:
        self.pieces = _Pieces()
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self) -> None:
        """Encodes the waiting pieces: their words in a row, cut again at the ends of words."""
        waiting, self.pieces.waiting = self.pieces.waiting, []
        words, counts = [], np.ones(len(waiting), np.int64)
        for k, piece in enumerate(waiting):
            if piece.isalpha():
                words.append(piece)
            else:
                own = _WORD.findall(piece)
                counts[k] = len(own)
                words += own
        rows = [" ".join(words[k : k + 256]) for k in range(0, len(words), 256)]
        ids = np.concatenate([np.empty(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False))])
        cuts = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
        if len(cuts) != len(words) + 1 or cuts[-1] != len(ids):
            own = [self._whole(w) for w in words]
            ids = np.concatenate([np.empty(0, np.uint32), *own])
            cuts = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
        last = np.cumsum(counts)
        n, k = len(self.pieces), len(self.pieces) - len(waiting)
        self.ids, self.starts, self.sizes = _grown(self.ids, self.used + len(ids)), _grown(self.starts, n), _grown(self.sizes, n)
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[k:n] = self.used + cuts[last - counts]
        self.sizes[k:n] = cuts[last] - cuts[last - counts]
        self.used += len(ids)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty(0, np.uint32)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        where = np.repeat(self.starts[at] - ends + sizes, sizes)
        where += np.arange(ends[-1])
        return self.ids[where]

    def _split(self, text: str) -> list[str] | None:
        if not self.by_word or _SIMPLE.search(text):
            return None
        low = text.lower()
        if any(s in low for s in self.special):
            return None
        rest = low.encode().translate(None, _ALNUM_SPACE)
        if rest and not rest.translate(None, _LATIN + _STOPS) and "×" not in low and "÷" not in low:
            # words and single stops: the stops stand by themselves, which makes fewer different pieces
            stops = low.count(".") + low.count(",")
            if stops and stops == sum(low.count(x) for x in (". ", ", ", ".\n", ",\n")) + low.endswith((".", ",")):
                low = low.replace(".", " .").replace(",", " ,")
        return low.split()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.pieces) > self.most:
            self._reset()
        get = self.pieces.__getitem__
        split = [self._split(t) for t in texts]
        at = [None if p is None else np.fromiter(map(get, p), np.int64, len(p)) for p in split]
        if self.pieces.waiting:
            self._learn()
        return [self._whole(t) if a is None else self._gather(a) for t, a in zip(texts, at, strict=True)]
