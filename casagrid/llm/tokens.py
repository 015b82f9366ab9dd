"""Token ids of whole texts by a public tokenizer file, with words looked up before the library is called.

A text is cut at single spaces and line ends, where both tokenizer families here cut anyway; the ids of a piece do not
depend on its neighbours. Pieces are remembered; a new one is cut into words and marks by the file's own pattern, and
the library's model gives the ids of those not seen lately. Texts with other white space, runs of white space they
would treat together, or marks of special tokens go through the library whole, so ids always equal those of one call
on the text. A test compares both.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np

# White space besides space and line end, by the broader of the usual definitions.
ODD_SPACES = "".join(map(chr, [0x9, 0xD, 0xB, 0xC, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
ODD_ASCII = ODD_SPACES[:8]
REMEMBERED_PIECES = 900_000
REMEMBERED_WORDS = 200_000
#: Marks that often follow a word; both patterns part them from it.
TAIL = ".,;:!?"
# Fixed value: the pattern of byte-level BPE, which its files imply by "use_regex".
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, int]:
    """Byte to letter: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: 256 + i for i, b in enumerate(others)}


def latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Words(dict):
    """Ids of a word or mark, by the library's model."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, byte_letters()
        self.space = chr(self.letters[32])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        ids = self[word] = self.ids(word)
        return ids

    def ids(self, word: str) -> bytes:
        plain = word.isascii() and word.isprintable()
        found = self.model.tokenize(word.replace(" ", self.space) if plain else word.encode().decode("latin-1").translate(self.letters))
        return array("I", [t.id for t in found]).tobytes()


class Pieces(dict):
    """Ids of pieces as little-endian unsigned 32-bit integers.

    ``sure`` pieces are Latin-1 in the case that the tokenizer wants; others are looked at one by one.
    """

    def __init__(self, of: Encoder, lead: str, sure: bool):
        super().__init__()
        self.of, self.lead, self.sure = of, lead, sure

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED_PIECES:
            self.clear()
        self[piece] = ids = self.found(piece)
        return ids

    def found(self, piece: str) -> bytes:
        of = self.of
        if not self.sure:
            try:
                piece.encode("latin-1")  # beyond, Unicode versions may differ about letters
            except UnicodeEncodeError:
                return of.whole(self.lead + piece)
            piece = piece.lower() if of.mode == "dropped" else piece
        if piece.isalpha():
            return of.words.ids(self.lead + piece)
        word = piece.rstrip(TAIL)
        if word.isalpha() and word != piece:  # most often known already
            return self[word] + b"".join(map(of.words.__getitem__, of.pattern.findall(piece[len(word) :])))
        return b"".join(map(of.words.__getitem__, of.pattern.findall(self.lead + piece)))


class Encoder:
    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.marks = [x["content"] for x in spec.get("added_tokens", ())]
        self.mode, pattern = self.kind(spec)
        self.pattern = regex.compile(pattern)
        self.words = Words(self.tokenizer.model)
        self.first, self.led = Pieces(self, "", False), Pieces(self, " ", False)
        self.sure_first, self.sure_led = Pieces(self, "", True), Pieces(self, " ", True)
        self.line_end = self.whole("\n") if self.mode == "led" else b""
        self.size = self.tokenizer.get_vocab_size()

    @staticmethod
    def kind(spec: dict) -> tuple[str, str]:
        """How spaces count: ``led`` (part of the word behind), ``dropped``, or unknown: ``whole``; and the pattern."""
        before, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec.get("model", {})
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            return "whole", ""
        if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and norm is None:
            return "led", BYTE_LEVEL
        steps = before.get("pretokenizers") or [{}]
        norms = [x.get("type") for x in (norm or {}).get("normalizers", ())]
        if norms == ["NFC", "Replace", "Lowercase"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[-1].get("type") == "ByteLevel":
            return "dropped", steps[0]["pattern"]["Regex"]
        return "whole", ""

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bool:
        if any(c in text for c in (ODD_ASCII if text.isascii() else ODD_SPACES)) or any(m in text for m in self.marks):
            return False
        return self.mode == "dropped" or not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text)

    def __call__(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; a null text has none."""
        if not text:
            return b""
        if self.mode == "whole" or not self.plain(text):
            return self.whole(text)
        first, led = (self.sure_first, self.sure_led) if latin(text) else (self.first, self.led)
        if self.mode == "dropped":
            return b"".join(map(first.__getitem__, (text.lower() if first.sure else text).split()))
        lines = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(first[head] + b"".join(map(led.__getitem__, rest)))
        return self.line_end.join(lines)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker, which keeps its pieces from task to task."""
    return Encoder(path)


def vocabulary_size(path: str) -> int:
    return encoder(path).size


def as_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")
