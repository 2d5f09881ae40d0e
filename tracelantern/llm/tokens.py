"""Whole texts to token ids with a tokenizer file, piece by piece.

A byte-level tokenizer first cuts a text into pieces that its merges never cross, and
most pieces of a corpus are frequent.  So a worker remembers the ids of pieces, up to a
fixed number, and gives the tokenizer only pieces it does not remember.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import regex

from tracelantern.llm.shared import in_worker

# White space in Unicode, as the tokenizer's own regexes see it (fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"
# How byte-level tokenizers cut a text (fixed values).
BYTE_LEVEL = r"'(?:[stmd]|re|ve|ll)| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|[\s]+(?![^\s])|[\s]+"
REMEMBERED = 400_000
# Pieces that the tokenizer gets at once; what it returns is some 100 times larger.
_LEARNED_AT_ONCE = 4096


def added_tokens(config: dict) -> tuple[regex.Pattern | None, dict[str, int]]:
    """The pattern of tokens that are found in a text before anything else, and their ids."""
    ids = {t["content"]: t["id"] for t in config.get("added_tokens") or []}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in config.get("added_tokens") or []):
        raise ValueError("added tokens with options are not supported")
    longest_first = sorted(ids, key=len, reverse=True)
    return (regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if ids else None), ids


def _ranges(name: str) -> str:
    """The first 65,536 characters of a property, as the regex library knows them, for a character class."""
    runs = regex.findall(rf"\p{{{name}}}+", "".join(map(chr, range(1 << 16))))
    return "".join(f"\\u{ord(run[0]):04x}-\\u{ord(run[-1]):04x}" for run in runs)


class Cutter:
    """Pieces of a text by a pattern whose properties stand within character classes."""

    def __init__(self, pattern: str):
        pattern = pattern.replace(r"\s", SPACE)
        self._any = regex.compile(pattern).findall
        # the faster engine looks up what is spelled out in a table of the first 65,536 characters
        self._most = re.compile(re.sub(r"\\p\{(\w+)\}", lambda found: _ranges(found[1]), pattern)).findall
        self._beyond = re.compile("[\U00010000-\U0010ffff]").search
        # the same classes among the first 128 characters, for the faster engine
        plain = pattern.replace(SPACE, r"\t-\r ").replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        self._ascii = re.compile(plain).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self._ascii(text)
        return self._any(text) if self._beyond(text) else self._most(text)


class Encoder:
    """Ids of texts as the tokenizer gives them, without its special tokens, truncation or padding."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        cut = config["pre_tokenizer"] or {}
        self.by_piece = (
            config["normalizer"] is None and cut.get("type") == "ByteLevel"
            and cut.get("use_regex") and not cut.get("add_prefix_space")
        )
        self.added, self.added_ids = added_tokens(config)
        self.cut = Cutter(BYTE_LEVEL)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.all([text])[0]

    def all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; pieces not remembered go to the tokenizer, those of all texts at once."""
        if not self.by_piece:
            return [_packed(found.ids) for found in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        # pieces, and ids where an added token stands
        cut = [self._pieces(text) for text in texts]
        found = [self._remembered(pieces) for pieces in cut]
        new = [k for k, ids in enumerate(found) if ids is None]
        if new:
            self._learn(set().union(*(cut[k] for k in new)))
            for k in new:
                found[k] = self._remembered(cut[k])
        return found

    def _remembered(self, pieces: list[str]) -> bytes | None:
        """The ids of pieces that are all remembered."""
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            return None

    def _pieces(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.cut(text)
        parts = self.added.split(text)
        return [piece for k, part in enumerate(parts) for piece in ([part] if k % 2 else self.cut(part))]

    def _learn(self, pieces: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = []
        for piece in pieces.difference(known):
            if piece in older:
                known[piece] = older[piece]
            elif piece in self.added_ids:
                known[piece] = _packed([self.added_ids[piece]])
            else:
                missing.append(piece)
        for some in itertools.batched(missing, _LEARNED_AT_ONCE):
            for piece, found in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                known[piece] = _packed(found.ids)


def _packed(ids: list[int]) -> bytes:
    return b"".join(k.to_bytes(4, "little") for k in ids)


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return in_worker(("encoder", path), lambda: Encoder(path))
