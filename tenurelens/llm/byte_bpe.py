"""A public byte-level BPE, read from its tokenizers JSON file.

Ids are those of the ``tokenizers`` library.  Texts of common characters go
through tiktoken with the ranks of the same file, which gives equal ids several
times faster; the two may class rare characters differently (their Unicode
tables differ in age), so any other text goes through ``tokenizers``.
"""
from __future__ import annotations

import json
import os
import re

# FIXED VALUE: how the file's pre-tokenizer splits a text
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RARE = re.compile("[^\t\n\r -~¡-ɏ‘-”]")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}


class ByteBpe:
    """``encode(text)`` gives the ids without template tokens.

    With ``special`` the strings of added tokens inside a text become those
    tokens, as the library does on the file as it is; without it they are
    plain text.
    """

    def __init__(self, path: str, special: bool):
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        if not special:
            self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        of_letter = {c: b for b, c in byte_letters().items()}
        pieces = {bytes(of_letter[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        self.bytes_of: list[bytes | None] = [None] * self.tokenizer.get_vocab_size()
        for token, i in pieces.items():
            self.bytes_of[i] = token
        self.names = re.compile("|".join(map(re.escape, sorted(added)))) if special and added else None
        ranked = all(a < b for a, b in zip(merged, merged[1:], strict=False))  # merges come in order of their ids
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=SPLIT, mergeable_ranks=pieces, special_tokens={}) if ranked else None

    def encode(self, text: str) -> list[int]:
        if self.fast is None or _RARE.search(text) or (self.names and self.names.search(text)):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)
