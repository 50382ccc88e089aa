"""Byte-level BPE by dynamic programming over prefixes.

In a BPE encoding every prefix of a piece has one possible last token, so the
encoding needs no merging: for each end the tokens that end there (found with
an automaton over the vocabulary) are tried, and the one that is compatible
with the last token of the prefix before it is kept. Following the kept tokens
back from the end gives the ids. Two neighbours are compatible if no merge
would have joined characters across their border, which the merges that made
the two tokens decide.
"""

from __future__ import annotations

import json
import re
from array import array
from weakref import proxy

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm.texts import annotate, made_of

# Pieces are encoded one by one and remembered; the memory is emptied when full.
MEMORY_PIECES = 300_000
MEMORY_PAIRS = 300_000
MEMORY_LENGTH = 48

# The split of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# First and last code points (hexadecimal) of letters and numbers assigned after Unicode 16,
# which the tokenizers library takes for neither.
LATER = """
558-558 58b-58c 88f-88f c5c-c5c cdc-cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2
a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9
11df1-11df1 1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda
18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81
1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f
2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def _exact_pattern() -> str:
    later = "".join(
        "-".join(f"\\U{int(end, 16):08x}" for end in span.split("-")) for span in LATER.split()
    )
    pattern = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[{later}]|[^\s\p{{L}}\p{{N}}])")
    return pattern.replace(r"\p{L}+", rf"(?:(?![{later}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{later}])\p{{N}})+")


PIECE = regex.compile(PATTERN)
PIECE_EXACT = regex.compile(_exact_pattern())
FIRST_LATER = re.compile("[\u0558-\U0010ffff]")


def pieces(text: str) -> list[str]:
    """The plain pattern serves texts without any character from the first later one on."""
    return (PIECE_EXACT if FIRST_LATER.search(text) else PIECE).findall(text)


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Vocabulary file of a byte-level BPE tokenizer.

    Inside, tokens are numbered by rank: bytes are 0 to 255 and the result of
    merge ``i`` is ``256 + i``, so a smaller number was merged earlier.
    """

    def __init__(self, content: str):
        spec = json.loads(content)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex", True):
            raise ValueError("only byte-level BPE vocabularies with the standard split are supported")
        if spec.get("normalizer") or split.get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError("normalizers, a prefix blank and ignored merges are not supported")
        alphabet, vocabulary = byte_alphabet(), model["vocab"]
        as_bytes = lambda token: bytes(alphabet[c] for c in token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.length = [1] * 256
        public = [vocabulary[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        rank = {c: b for c, b in alphabet.items()}
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            token = left + right
            if token in rank:
                raise ValueError(f"two merges make the token {token!r}")
            pair = (rank[left], rank[right])
            rank[token] = self.merged[pair] = len(self.parts)
            self.parts.append(pair)
            self.length.append(self.length[pair[0]] + self.length[pair[1]])
            public.append(vocabulary[token])
        self.public = array("I", public)
        self.bytes_of: dict[int, bytes] = {i: as_bytes(t) for t, i in vocabulary.items()}
        self.added = {}
        for token in spec.get("added_tokens", []):
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError(f"token {token['content']!r} takes its surroundings into account")
            self.added[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.automaton = ahocorasick.Automaton()
        for token, number in rank.items():
            self.automaton.add_word(as_bytes(token).decode("latin-1"), number)
        self.automaton.make_automaton()
        self._whole: dict[int, bool] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces = _Pieces(self)

    def compatible(self, left: int, right: int, limit: int | None = None) -> bool:
        """Whether the two stay apart: no pair across their border merges before they are whole.

        The two are taken apart again, the later merged first. ``limit`` is the
        rank below which a merge across the border would still come first.
        """
        merged, parts = self.merged, self.parts
        limit = len(parts) if limit is None else limit
        while True:
            joined = merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit = left
                left = parts[left][1]
                if left == limit:
                    limit = right + 1
                    right = parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = parts[right][0]
                if right + 1 == limit:
                    limit = left
                    left = parts[left][1]
                    if left == limit:
                        return True

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token."""
        if token < 256:
            return True
        known = self._whole.get(token)
        if known is None:
            left, right = self.parts[token]
            known = self.whole(left) and self.whole(right) and self.compatible(left, right, token)
            self._whole[token] = known
        return known

    def _stays(self, left: int, right: int) -> bool:
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= MEMORY_PAIRS:
                self._pairs.clear()
            known = self._pairs[left, right] = self.compatible(left, right)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Public ids of one piece."""
        text = piece.encode().decode("latin-1")
        last = [-1] * len(text)
        length = self.length
        for end, token in self.automaton.iter(text):
            if last[end] < 0:
                before = end - length[token]
                if self.whole(token) and (before < 0 or self._stays(last[before], token)):
                    last[end] = token
        ids = []
        at = len(text) - 1
        while at >= 0:
            ids.append(self.public[last[at]])
            at -= length[last[at]]
        ids.reverse()
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known = self._pieces.__getitem__
        if self.cut is None or not any(token in text for token in self.added):
            return b"".join(map(known, pieces(text)))
        found = []
        for i, span in enumerate(self.cut.split(text)):
            found.append(_pack([self.added[span]]) if i % 2 else b"".join(map(known, pieces(span))))
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class _Pieces(dict):
    """Encoded pieces, filled on demand."""

    def __init__(self, bpe: ByteBpe):
        super().__init__()
        self.bpe = proxy(bpe)  # else both would stay until cycles are collected

    def __missing__(self, piece: str) -> bytes:
        ids = _pack(self.bpe.encode_piece(piece))
        if len(piece) <= MEMORY_LENGTH:
            if len(self) >= MEMORY_PIECES:
                self.clear()
            self[piece] = ids
        return ids


def load(content: str) -> ByteBpe:
    return ByteBpe(content)


def encode_decode(docs: DataFrame, vocabulary: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``ids`` (little-endian unsigned 32-bit integers) and ``decoded`` text of each row.

    ``vocabulary`` is the path of a tokenizer file on the driver; its content is
    broadcast, a few megabytes at most. A null or empty text has no ids and
    decodes to empty text. Rows stay as many as they are, with null ids and
    repeats; an empty table gives none. Nothing is shuffled.
    """
    with open(vocabulary, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def start():
        bpe = made_of(content, load)

        def work(texts):
            ids = [bpe.encode(t or "") for t in texts]
            return [len(i) // 4 for i in ids], ids, [bpe.decode(i) for i in ids]

        return work

    return annotate(docs, [id], text, "n_tokens long, ids binary, decoded string", start)


def digest(encoded: DataFrame, id: str = "doc_id") -> DataFrame:
    """Token counts, and digests of ids and decoded texts."""
    return encoded.select(
        id,
        "n_tokens",
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
