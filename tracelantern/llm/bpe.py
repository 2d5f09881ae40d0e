"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding.

For each prefix of a word the encoding of that prefix has one last token: the token
that ends there, encodes to itself, and forms with the prefix's earlier last token a
pair that the merges keep apart.  So the encodings of all prefixes are a tree of last
tokens, grown by one symbol at a time.  A later token starts at most as many symbols
back as the longest merge result is long; once the last tokens within that lookahead
meet in one place of the tree, everything before that place is stable and is emitted.
Only the open part of the tree is kept.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator, Sequence

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelantern.llm.shared import in_worker, slices
from tracelantern.llm.tokens import BYTE_LEVEL, SPACE, Cutter, added_tokens

# Pairs of tokens and words a worker remembers at most.
REMEMBERED_PAIRS = 400_000
REMEMBERED_WORDS = 300_000
# Ids that the decoder takes at a time.
DECODED_AT_ONCE = 1 << 14


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Merges:
    """The merge list: plain merging of short runs, and which tokens may stand side by side."""

    def __init__(self, config: dict):
        model = config["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self.parts: dict[str, tuple[str, str]] = {}
        for first, second in pairs:
            self.parts.setdefault(first + second, (first, second))
        self.born = {word: self.rank[pair] for word, pair in self.parts.items()}
        if any(self.born.get(part, -1) >= k for pair, k in self.rank.items() for part in pair):
            raise ValueError("a merge uses a token that a later merge makes")
        self.lookahead = max(map(self._length, self.parts), default=1)
        self.apart: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def _length(self, token: str) -> int:
        """Number of symbols; the mark of a word's end is none of its own."""
        return len(token.removesuffix(self.suffix)) or 1

    def is_whole(self, token: str) -> bool:
        """Whether a token of the vocabulary encodes to itself."""
        known = self.whole.get(token)
        if known is None:
            first, second = self.parts.get(token, ("", ""))
            known = self.whole[token] = not first or (
                self.is_whole(first) and self.is_whole(second) and self._undone(first, second)
            )
        return known

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether the merges leave two neighbouring tokens as they are."""
        pair = (left, right)
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) > REMEMBERED_PAIRS:
                self.apart.clear()
            known = self.apart[pair] = pair not in self.rank and self._undone(left, right)
        return known

    def _undone(self, left: str, right: str) -> bool:
        """Takes the merges of two neighbours back, the latest first, and looks whether at
        some moment a rule that comes earlier would have merged across their border."""
        born, rank = self.born, self.rank
        while True:
            of_left, of_right = born.get(left, -1), born.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                left, before = self.parts[left][1], of_left
            else:  # of equal rules the left place goes first
                right, before = self.parts[right][0], of_right + 1
            if rank.get((left, right), before) < before:
                return False


class Transducer:
    """Tokens of one word as its symbols come; ``feed`` and ``finish`` return what is stable."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self._clear()

    def _clear(self) -> None:
        self.text = ""  # symbols after the last stable place
        self.last = [""]  # last token of each prefix of the open part
        self.start = [0]  # the place where that token starts
        self.held = ""  # the newest symbol, as it may end the word

    def feed(self, symbols: str) -> list[str]:
        """Takes the next symbols; the newest is held, as it may end the word."""
        self._grow(self.held + symbols[:-1], "")
        self.held = symbols[-1]
        return self._stable() if len(self.text) > 2 * self.merges.lookahead else []

    def finish(self) -> list[str]:
        self._grow(self.held, self.merges.suffix)
        tokens = self._path(len(self.text))
        self._clear()
        return tokens

    def _grow(self, symbols: str, suffix: str) -> None:
        """Adds the last tokens of the prefixes that end with each symbol."""
        end = len(self.text)
        text = self.text = self.text + symbols
        last, starts, merges = self.last, self.start, self.merges
        ids, whole, apart, lookahead = merges.ids, merges.whole, merges.apart, merges.lookahead
        while end < len(text):
            end += 1
            for start in range(end - lookahead if end > lookahead else 0, end):
                token = text[start:end] + suffix
                if token in ids and (whole.get(token) or merges.is_whole(token)):
                    before = last[start]
                    fits = apart.get((before, token)) if before else True
                    if fits or fits is None and merges.stay_apart(before, token):
                        last.append(token)
                        starts.append(start)
                        break
            else:
                raise ValueError(f"no token for {text[end - 1]!r}")

    def _path(self, place: int) -> list[str]:
        tokens = []
        while place:
            tokens.append(self.last[place])
            place = self.start[place]
        return tokens[::-1]

    def _stable(self) -> list[str]:
        """Emits up to the place that all last tokens within the lookahead share."""
        end = len(self.text)
        places = set(range(end + 1 - self.merges.lookahead, end + 1))
        while len(places) > 1:
            newest = max(places)
            places.remove(newest)
            places.add(self.start[newest])
        meet = places.pop()
        tokens = self._path(meet)
        self.text, self.last = self.text[meet:], self.last[meet:]
        self.start = [0, *(start - meet for start in self.start[meet + 1:])]
        return tokens


class Decoder:
    """Ids to text, one at a time; bytes of a character that is not whole yet are held back."""

    def __init__(self, config: dict):
        tokens = {k: v for v, k in config["model"]["vocab"].items()}
        tokens |= {t["id"]: t["content"] for t in config.get("added_tokens") or []}
        kind = (config.get("decoder") or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"decoder {kind} is not supported")
        joined = kind is None  # without a decoder, tokens are written with spaces between
        self.gap = b" " if joined else b""
        octet = {s: b for b, s in enumerate(byte_symbols())}
        self.bytes = {
            k: token.encode() if joined or not set(token) <= octet.keys() else bytes(octet[c] for c in token)
            for k, token in tokens.items()
        }
        self.reset()

    def reset(self) -> None:
        self.state, self.first = codecs.getincrementaldecoder("utf-8")("replace"), True

    def feed(self, token_id: int) -> str:
        return self.feed_all([token_id])

    def feed_all(self, ids: Sequence[int]) -> str:
        """What becomes sure with some more ids."""
        if not len(ids):
            return ""
        gap = b"" if self.first else self.gap
        self.first = False
        return self.state.decode(gap + self.gap.join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        rest = self.state.decode(b"", final=True)
        self.reset()
        return rest


class Codec:
    """A tokenizer file: cutting texts into words, their ids, and the text of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.merges, self.decoder = Merges(config), Decoder(config)
        self.added, self.added_ids = added_tokens(config)
        self.cut = Cutter(self._pattern(config))
        self.steps = self._normalizers(config)
        self.symbol = byte_symbols()
        self.known = _Words(self)

    @staticmethod
    def _pattern(config: dict) -> str:
        cut = config["pre_tokenizer"]
        parts = cut["pretokenizers"] if cut["type"] == "Sequence" else [cut]
        if [p["type"] for p in parts] == ["ByteLevel"] and parts[0]["use_regex"] and not parts[0]["add_prefix_space"]:
            return BYTE_LEVEL
        if [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]:
            return parts[0]["pattern"]["Regex"]
        raise ValueError("this way of cutting words is not supported")

    @staticmethod
    def _normalizers(config: dict) -> list[str]:
        rule = config["normalizer"]
        parts = [] if rule is None else rule["normalizers"] if rule["type"] == "Sequence" else [rule]
        kinds = [p["type"] for p in parts]
        if any(kind not in ("NFC", "Lowercase", "Replace") for kind in kinds):
            raise ValueError(f"normalizers {kinds} are not supported")
        if any(p["type"] == "Replace" and (p["pattern"], p["content"]) != ({"Regex": r"\s+"}, " ") for p in parts):
            raise ValueError("this replacement is not supported")
        return kinds

    def normalised(self, text: str) -> str:
        for kind in self.steps:
            if kind == "NFC":
                text = unicodedata.normalize("NFC", text)
            elif kind == "Lowercase":  # character by character: a sigma at a word's end is no exception
                text = text.replace("Σ", "σ").lower()
            else:
                text = re.sub(f"[{SPACE}]+", " ", text)
        return text

    def tokens(self, word: str) -> list[str]:
        """The tokens of one word, by the transducer."""
        transducer = Transducer(self.merges)
        octets = word if word.isascii() and word.isalnum() else "".join([self.symbol[b] for b in word.encode()])
        out: list[str] = []
        for start in range(0, len(octets), self.merges.lookahead):
            out += transducer.feed(octets[start:start + self.merges.lookahead])
        return out + transducer.finish()

    def decode(self, ids: list[int]) -> str:
        self.decoder.reset()
        return "".join(map(self.decoder.feed, ids)) + self.decoder.finish()

    def packed(self, text: str) -> bytes:
        """The ids of a whole text, four bytes each."""
        ids = []
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            if k % 2:
                ids.append(self.added_ids[part].to_bytes(4, "little"))
            else:
                ids += map(self.known.__getitem__, self.cut(self.normalised(part)))
        return b"".join(ids)

    def pieces(self, packed: bytes) -> Iterator[str]:
        """The text of packed ids, as it leaves the decoder."""
        self.decoder.reset()
        for at in range(0, len(packed), 4 * DECODED_AT_ONCE):
            piece = packed[at:at + 4 * DECODED_AT_ONCE]
            yield self.decoder.feed_all(struct.unpack(f"<{len(piece) // 4}I", piece))
        yield self.decoder.finish()

    def both(self, text: str) -> tuple[bytes, str]:
        """Packed ids of a whole text, and the text that they decode to."""
        packed = self.packed(text)
        return packed, "".join(self.pieces(packed))


class _Words(dict):
    """Packed ids of words; the words of the last while are kept."""

    def __init__(self, codec: Codec):
        self.codec, self.older = codec, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = b"".join([self.codec.merges.ids[token].to_bytes(4, "little") for token in self.codec.tokens(word)])
        if len(self) >= REMEMBERED_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


def codec(path: str) -> Codec:
    """One codec per worker and file."""
    return in_worker(("codec", path), lambda: Codec(path))


def encode(documents: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids ARRAY<INT>, decoded`` for each row; a null text counts as empty."""
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _Run(tokenizer, whole=True), "doc_id long, ids array<int>, decoded string"
    )


def digests(documents: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``documents``.

    A null or empty text has no tokens.  Repeated rows give repeated results.  Other
    columns are not read.  Nothing is shuffled.
    """
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _Run(tokenizer, whole=False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


class _Run:
    """Encodes and decodes batches of rows with the worker's codec."""

    def __init__(self, tokenizer: str, whole: bool):
        self.tokenizer, self.whole = tokenizer, whole

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(self.tokenizer)
        for batch in slices(batches):
            if self.whole:
                found = [known.both(text or "") for text in batch.column(1).to_pylist()]
                ids = pa.array([memoryview(i).cast("I").tolist() for i, _ in found], pa.list_(pa.int32()))
                columns, names = [ids, pa.array([t for _, t in found], pa.string())], ["ids", "decoded"]
            else:
                found = [known.packed(text or "") for text in batch.column(1).to_pylist()]
                columns = [
                    pa.array([len(i) // 4 for i in found], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i in found], pa.string()),
                    pa.array([self._digest(known.pieces(i)) for i in found], pa.string()),
                ]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    @staticmethod
    def _digest(pieces: Iterator[str]) -> str:
        value = hashlib.sha256()
        for piece in pieces:
            value.update(piece.encode())
        return value.hexdigest()


def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of all ``documents`` and of what the ids decode to."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return digests(documents, public_tokenizers.path("word_bpe_49k.json"))
