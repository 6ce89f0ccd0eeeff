"""Token ids of texts by a public tokenizer, word by word."""

from __future__ import annotations

import os
import re
from array import array
from functools import cache

#: Letters that stay one code point when normalised and lowered; ASCII symbols without the apostrophe of contractions.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_SYMBOLS = r"!-&(-/:-@\[-`{-~"
_PIECES = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SYMBOLS}]+")
_ODD = re.compile(rf"[^{_LETTERS}{_SYMBOLS}0-9 \t\n\x0b\f\r]|<\|")
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public tokenizer's file, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """Parts of a text that the tokenizer encodes independently of each other, in order.

    It drops white space and then parts letters, digits and symbols. Where a text holds just plain Latin letters, ASCII
    digits and symbols, those runs are its parts; words with anything else (apostrophes, other scripts, special strings)
    stay whole. White space beyond ASCII is left to the library.
    """
    if not _ODD.search(text):
        return _PIECES.findall(text.lower())
    out: list[str] = []
    for word in _SPACE.split(text):
        if _ODD.search(word):
            out.append(word)
        else:
            out += _PIECES.findall(word.lower())
    return out


class WordEncoder(dict):
    """Ids of whole texts as the tokenizers library gives them, as little-endian bytes of one width.

    For tokenizers that lower and split as word_bpe_49k.json does: the library encodes each distinct piece once; a
    text's ids are those of its pieces. What is remembered is emptied when it holds `most` pieces.
    """

    def __init__(self, path: str, width: int = 4, special: bool = True, most: int = 800_000) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.code, self.most = {2: "H", 4: "I"}[width], most

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > self.most:
            self.clear()
        return b"".join(map(self.__getitem__, pieces(text)))


@cache
def encoder(path: str, width: int = 4, special: bool = True) -> WordEncoder:
    """One encoder a worker."""
    return WordEncoder(path, width, special)
