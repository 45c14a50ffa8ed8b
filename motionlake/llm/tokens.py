"""Token ids of whole texts, with the ids of recurring pieces kept in the worker."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: Letters, digits and white space among the first 256 characters.
_LETTER, _DIGIT, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
#: The pieces into which byte-level BPE cuts a text before it merges bytes, for texts of those characters.
PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Pieces of each of a worker's two generations, and the most characters that a kept piece has.
CACHE_PIECES, CACHE_CHARS = 500_000, 64
#: Characters of text whose pieces are looked up together, and new pieces encoded together.
ROUND_CHARS, JOIN_PIECES = 300_000, 20_000


def default_tokenizer() -> str:
    """Path of the vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def narrow(text: str) -> bool:
    """Whether all characters are among the first 256."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Encodes whole texts with a byte-level BPE file of the tokenizers library.

    The ids are those of the plain library, its added tokens (such as an end-of-text mark) included. Such a
    vocabulary cuts a text into pieces first and never joins bytes of two pieces, so a text's ids are
    the ids of its pieces, and the library encodes each distinct piece once while it stays in the cache. Texts
    with other characters than the first 256, or with one of the added tokens, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of each token: the vocabulary writes a sign for each.
        self.size = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.size[i] = len(token)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str], between: str) -> None:
        """Encode pieces as one text, in which ``between`` is a piece of its own, and cut the ids where they end."""
        for at in range(0, len(pieces), JOIN_PIECES):
            some = pieces[at : at + JOIN_PIECES]
            (raw,) = self._ids([between.join(some)])
            ends = np.cumsum(self.size[np.frombuffer(raw, "<u4")])
            stop = np.cumsum([len(p.encode()) + len(between) for p in some]) - len(between)
            last = 4 * (np.searchsorted(ends, stop) + 1)
            first = 4 * np.searchsorted(ends, stop - [len(p.encode()) for p in some], side="right")
            self.pieces.update((p, raw[a:b]) for p, a, b in zip(some, first.tolist(), last.tolist()))

    def _learn(self, new: set[str]) -> None:
        """Get pieces' ids from the older generation, or encode them; a long piece stays for this round alone."""
        known = {p: self.older[p] for p in new if p in self.older}
        self.pieces.update(known)
        rest = [p for p in new if p not in known]
        spaces = [p for p in rest if p.isspace()]
        self.pieces.update(zip(spaces, self._ids(spaces)))
        self._joined([p for p in rest if p[0] == " " and not p.isspace()], "")
        self._joined([p for p in rest if p[0] != " " and not p.isspace()], "\n")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The texts' ids, each as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, list[str]]] = []
        chars = 0
        for i, text in enumerate(texts):
            if any(t in text for t in self.added) or not narrow(text):
                (out[i],) = self._ids([text])
                continue
            held.append((i, PIECE.findall(text)))
            chars += len(text)
            if chars > ROUND_CHARS:
                self._round(held, out)
                held, chars = [], 0
        self._round(held, out)
        return out

    def _round(self, held: list[tuple[int, list[str]]], out: list[bytes]) -> None:
        """Put the ids of cut texts into ``out``. Pieces not used for a whole generation are forgotten."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces, self.older = {}, self.pieces
        get = self.pieces.get
        found = [list(map(get, pieces)) for _, pieces in held]
        new = {p for (_, pieces), ids in zip(held, found) if None in ids for p, x in zip(pieces, ids) if x is None}
        if new:
            self._learn(new)
        for (i, pieces), ids in zip(held, found):
            out[i] = b"".join(map(self.pieces.__getitem__, pieces) if None in ids else ids)
        for p in new:
            if len(p) > CACHE_CHARS:
                del self.pieces[p]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """This worker's encoder for a file."""
    return Encoder(path)
