"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a word exactly one token can stand last in its encoding: the one that ends there, matches the
word's symbols, and is compatible with the last token of the prefix before it. Matches come from an automaton
over the vocabulary, compatibility from the merge ranks alone, and back-pointers give the ids. Each distinct word of
a task is encoded once while its memo lasts; memos are bounded.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the vocabulary's format splits a text, names white space, and ends a word.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter for each byte: printable ones stand for themselves, the others count up from 256."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a tokenizer file of the kind "BPE with word ends"."""

    def __init__(self, path: str, memo: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        # One character a symbol: the last letter of a word is another symbol than the same letter elsewhere.
        self.ids = {self.symbols(t): i for t, i in model["vocab"].items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = model["vocab"][a], model["vocab"][b], model["vocab"][a + b]
            self.rank[a, b] = rank
            self.parts.setdefault(c, (a, b, rank))
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            if len(s) == 1 or i in self.parts:
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.compatible = lru_cache(maxsize=1 << 18)(self._compatible)
        self.words = lru_cache(maxsize=memo)(self._word)
        self.spine = lru_cache(maxsize=None)(self._spine)
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @staticmethod
    def symbols(token: str) -> str:
        return token[: -len(WORD_END) - 1] + chr(ord(token[-len(WORD_END) - 1]) + 0x10000) if token.endswith(WORD_END) and len(token) > len(WORD_END) else token

    def _spine(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The token and its first (0) or last (1) parts down to a symbol, each with the ranks at which it appears and goes."""
        out, until = [], float("inf")
        while True:
            split = self.parts.get(token)
            out.append((token, split[2] if split else -1, until))
            if not split:
                return out
            token, until = split[side], split[2]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens: no merge across their border comes while both its sides are there.

        At equal ranks merges go from left to right.
        """
        for a, since_a, until_a in self.spine(left, 1):
            for b, since_b, until_b in self.spine(right, 0):
                rank = self.rank.get((a, b))
                if rank is not None and rank > since_a and rank > since_b and rank < until_a and rank <= until_b:
                    return False
        return True

    def encode_symbols(self, s: str) -> list[int]:
        last: list[int | None] = [None] * (len(s) + 1)  # of each prefix: its last token,
        begin = [0] * (len(s) + 1)  # and where that starts
        for end, (length, token) in self.automaton.iter(s):
            end += 1
            start = end - length
            if last[end] is None and (start == 0 or self.compatible(last[start], token)):
                last[end], begin[end] = token, start
        out, at = [], len(s)
        while at:
            out.append(last[at])
            at = begin[at]
        return out[::-1]

    def _word(self, word: str) -> tuple[str, str]:
        """Of a piece of text: its ids as text, and its tokens as decoded text."""
        letters = [self.letters[b] for b in word.encode("utf-8")]
        letters[-1] = chr(ord(letters[-1]) + 0x10000)
        ids = self.encode_symbols("".join(letters))
        return " ".join(map(str, ids)), self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """The format has no decoder of its own: tokens stand as they are, joined by a space."""
        return " ".join([self.token[i] for i in ids])

    @staticmethod
    def normal(text: str) -> str:
        """Composed and lower case letter by letter (a final sigma is no other letter). Pieces hold no white space, so it may stay."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "σ".join(part.lower() for part in text.split("Σ"))

    def _chunk(self, chunk: str) -> tuple[str, str]:
        found = list(map(self.words, self.split.findall(chunk)))
        return " ".join([x[0] for x in found]), " ".join([x[1] for x in found])

    def _plain(self, texts: list[str]) -> list[tuple[str, str]]:
        """Ids as text and decoded text of texts without special tokens.

        Pieces never go beyond a space or line end, so what stands between these is encoded once for all texts.
        """
        chunks = pc.split_pattern(pa.array([self.normal(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = chunks.flatten().dictionary_encode()
        found = [self._chunk(c) for c in coded.dictionary.to_pylist()]
        full = pa.array([bool(x[0]) for x in found], pa.bool_()).take(coded.indices)
        ends = np.r_[0, np.cumsum(full.to_numpy(zero_copy_only=False))][chunks.offsets.to_numpy()]
        codes = coded.indices.filter(full)
        out = []
        for k in (0, 1):
            strings = pa.array([x[k] for x in found], pa.string()).take(codes)
            out.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings), " ").to_pylist())
        return list(zip(*out, strict=True))

    def run(self, texts: list[str]) -> list[tuple[str, str]]:
        """Ids as text and decoded text of each whole text; strings of special tokens stand for these."""
        parts: list[str] = []
        plan: list[list[int | str]] = []  # of each text: the numbers of its parts, and special tokens between them
        for text in texts:
            at, steps = 0, []
            for m in self.cut.finditer(text) if self.cut else ():
                steps += [len(parts), m.group()]
                parts.append(text[at : m.start()])
                at = m.end()
            steps.append(len(parts))
            parts.append(text[at:])
            plan.append(steps)
        done = self._plain(parts)
        if len(parts) == len(texts):
            return done
        out = []
        for steps in plan:
            own = [done[x] if isinstance(x, int) else (str(self.special[x]), self.decode([self.special[x]])) for x in steps]
            own = [x for x in own if x[0]]
            out.append((" ".join([x[0] for x in own]), " ".join([x[1] for x in own])))
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.run([text])[0][0].split()]


def portions(texts: list[str], size: int = 6_000_000) -> Iterator[list[str]]:
    """texts in order, in lists of about `size` characters at most, or of one longer text."""
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > size:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of docs(doc_id, text), and ids as an array if asked for.

    path is a tokenizer file that every executor has at the same place. Whole texts are encoded; null counts as
    empty, an empty text has no tokens. Rows are independent, so repeated rows and columns beside these don't matter.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path)
        for b in batches:
            count, ids_hash, text_hash, ids = [], [], [], []
            texts = [t or "" for t in b.column(1).to_pylist()]
            for as_text, decoded in (x for part in portions(texts) for x in bpe.run(part)):
                count.append(as_text.count(" ") + 1 if as_text else 0)
                ids_hash.append(hashlib.sha256(as_text.encode()).hexdigest())
                text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    ids.append([int(i) for i in as_text.split()])
            columns = [b.column(0), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
