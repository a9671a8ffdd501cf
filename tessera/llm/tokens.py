"""Token ids of whole texts by a public tokenizer's vocabulary file.

Ids are those of the ``tokenizers`` library. Its work on a text is per piece
between white space, so texts of common characters are cut there and each
distinct piece is tokenized once and remembered; all other texts, and those that
hold special tokens, go through the library whole.
"""

from __future__ import annotations

import functools

import regex

#: Pieces that a Python worker remembers.
MEMO = 400_000

#: White space of ASCII, its printable characters and those of Latin-1: unchanged by NFC, and alike in both libraries' classes.
_UNUSUAL = regex.compile("[^\t-\r -~¡-ÿ]")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable ones themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(0x100 + next(hidden)) for b in range(256)]


def default_vocabulary() -> str:
    """The vocabulary file of the packing operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        #: Pieces can be looked up alone if nothing but words, in lower case and without white space, is kept.
        self.by_piece = kinds == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"]) if self.by_piece else None
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if len(piece) > 1 and piece[-1] in ".,!?;:" and piece[:-1].isalpha():
            return self._known(piece[:-1]) + self._known(piece[-1])
        if piece.isalpha() and piece.isascii():
            return b"".join([t.id.to_bytes(4, "little") for t in self.whole.model.tokenize(piece)])
        ids = []
        for word in self.pattern.findall(piece):
            if not word.isascii() or not word.isprintable():
                word = "".join(self.letters[b] for b in word.encode())
            ids += [t.id for t in self.whole.model.tokenize(word)]
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _known(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self.known[piece] = self._piece(piece)
        return found

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_piece or _UNUSUAL.search(text) or any(s in text for s in self.special):
            return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)
        pieces = text.lower().split()
        new = set(pieces).difference(self.known)
        if new:
            if len(self.known) > MEMO:
                self.known.clear()
                new = set(pieces)
            for piece in new:
                self._known(piece)
        return b"".join(map(self.known.__getitem__, pieces))


@functools.cache
def encoder(path: str) -> Encoder:
    """This Python worker's encoder for a vocabulary file."""
    return Encoder(path)
