"""Pre-tokens of the word-BPE tokenizer, exactly as its library cuts them, and the tokens of each distinct one."""

from __future__ import annotations

import re
import unicodedata

#: The pre-tokenizer's pattern as its vocabulary file states it, with the letters and digits of the usual
#: characters below (lower case) spelled out.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^\\sa-zªµºß-öø-ſ0-9²³¹¼-¾]+")
#: Texts of these characters only take the fast path: here both libraries agree on classes, case and composition.
_UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e -įı-ſ‐-―‘-„†-•…€]")


class WordTokens:
    """Splits texts into pre-tokens and knows the token ids of each, both by the tokenizer file's own rules."""

    def __init__(self, path: str, keep: int = 400_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.model = self.tokenizer.model
        self.bytes_of = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.keep = keep

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; a special string of the tokenizer stands for itself."""
        if self.cut is not None and "<|" in text:
            out: list[str] = []
            for part in self.cut.split(text):
                out += [part] if part in self.special else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if _UNUSUAL.search(text):
                return self._by_library(text)
            text = unicodedata.normalize("NFC", text)
        elif _UNUSUAL.search(text):
            return self._by_library(text)
        return PIECES.findall(text.lower())

    def _by_library(self, text: str) -> list[str]:
        if not text:
            return []
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        back = self.bytes_of
        return [bytes(back[c] for c in piece).decode() for piece, _ in cut]

    def ids(self, piece: str) -> list[int]:
        if piece in self.special:
            return [self.special[piece]]
        return [t.id for t in self.model.tokenize("".join(map(_LETTERS.__getitem__, piece.encode())))]


def _byte_letters() -> dict[str, int]:
    return {c: b for b, c in enumerate(_LETTERS)}


def _letters() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level tokenizers: printable Latin-1 as is, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


_LETTERS = _letters()
