"""Token ids of a byte-level BPE vocabulary, fast: most texts are pieces between single spaces, seen before.

The vocabulary splits a text before each single space that stands between two other characters, so the ids of
the pieces between such spaces, each with its space, make up the ids of the text. Each Python worker keeps the
ids of up to twice ``MEMO`` pieces of up to ``SHORT`` characters. Texts in which white space meets white space around a space take the slow path over
the whole text, and texts with the end-of-text marker the original tokenizer, so the ids are the same in every case.

Vocabulary and merges are those of the tokenizers file; single pieces are encoded by tiktoken, whose ids are the same (tests hold
them against the tokenizers library) at about half the time.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import public_tokenizers

#: Where the vocabulary files of public tokenizers are, unless another folder is given.
FOLDER = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))
END_OF_TEXT = "<|endoftext|>"
MEMO, SHORT = 160_000, 64
#: Fixed value: how this vocabulary's pre-tokenizer splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Pieces(dict):
    """Piece to the bytes of its ids, or None where its ends aren't safe to cut at.

    When it is full it becomes the older half of the memo, from which pieces that come again are taken over.
    """

    def __init__(self, encode, lead: str):
        super().__init__()
        self.encode, self.lead, self.older = encode, lead, {}

    def __missing__(self, piece: str) -> bytes | None:
        if piece in self.older:
            out = self.older[piece]
        else:
            safe = piece and not piece[0].isspace() and not piece[-1].isspace()
            out = np.array(self.encode(self.lead + piece), "<u4").tobytes() if safe else None
        if len(piece) <= SHORT:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = out
        return out


def byte_alphabet() -> dict[str, int]:
    """How the file writes bytes as characters: printable ones (but the space and the soft hyphen) as themselves, the others, in order, from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    """ids(text): little-endian unsigned 32-bit ids as an array, as the tokenizers file gives them without special tokens added."""

    def __init__(self, folder: str = FOLDER, name: str = "byte_bpe_50k"):
        import tiktoken

        self.json, bytes_of = f"{folder}/{name}.json", byte_alphabet()
        with open(self.json, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # ids are in the order of the merges, so they are the ranks as well
        ranks = {bytes(map(bytes_of.__getitem__, token)): i for token, i in vocab.items() if token != END_OF_TEXT}
        self.plain = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.first, self.rest = _Pieces(self.plain, ""), _Pieces(self.plain, " ")

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if END_OF_TEXT in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")
        head, *tail = text.split(" ")
        found = [self.first[head], *map(self.rest.__getitem__, tail)]
        if None in found:
            return np.array(self.plain(text), "<u4")
        return np.frombuffer(b"".join(found), "<u4")


@functools.lru_cache(maxsize=1)
def byte_bpe(folder: str = FOLDER) -> ByteBPE:
    return ByteBPE(folder)
