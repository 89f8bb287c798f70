"""Vocabulary files of public tokenizers, read on the driver and sent to the executors."""

from __future__ import annotations

import base64
import json

BYTE_BPE_JSON, BYTE_BPE_RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def path_of(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def pieces_of_ranks(raw: bytes) -> list[bytes]:
    """Byte strings of a ranks file, by rank."""
    rows = [line.split() for line in raw.splitlines() if line]
    return [piece for _, piece in sorted((int(rank), base64.b64decode(piece)) for piece, rank in rows)]


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def pieces_of_json(raw: bytes) -> list[bytes]:
    """Byte string of each id of a byte-level tokenizer file, added tokens included."""
    whole, letters = json.loads(raw), byte_letters()
    found = {i: bytes(letters[c] for c in s) for s, i in whole["model"]["vocab"].items()}
    for t in whole["added_tokens"]:
        found[t["id"]] = t["content"].encode()
    return [found.get(i, b"") for i in range(max(found) + 1)]
