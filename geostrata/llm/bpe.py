"""BPE encoding and decoding with forced-boundary splitting.

Two adjacent bytes that no vocabulary token holds next to each other can never
be merged over, so every such place inside a pre-token is a certain cut: the
fragments between cuts are encoded on their own and their ids concatenated.
Only a pre-token's last fragment carries the word end.  Fragments, and the
white-space-separated words made of them, are kept in dictionaries bounded in
entries and in their length, so each is encoded once per worker as long as it
stays there.

Words in characters up to U+024F are split into pre-tokens here, others (where
normalisation may compose or reorder) by the library's own normaliser and
pre-tokeniser; both then go the same way.  Only words that hold a special string
go to the library whole.  White space always ends a pre-token and is dropped, so
words are independent of each other.

Defined results: null counts as empty, with no ids and an empty decoded text;
every row gives a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, small_batches, worker_state

#: Entries of a generation of a worker's dictionaries.  When one is full, it is
#: kept as the older generation, from which words in use are taken over.
WORDS, FRAGMENTS = 200_000, 150_000
#: Characters of a word or fragment that is kept; longer ones are encoded each time,
#: so that a dictionary's bytes are bounded too.
LONG = 128
_PLAIN = re.compile("[\x00-ɏ]*")
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_SHOWN))}
_MAP = [_BYTE[b] for b in range(256)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Codec:
    """Encodes and decodes as the library of one lower-casing vocabulary does."""

    def __init__(self, path: str, words: int = WORDS, fragments: int = FRAGMENTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        inside = set()
        for t in spec["model"]["vocab"]:
            t = t.removesuffix(self.suffix)
            inside.update(zip(t, t[1:]))
        self.inside = frozenset(a + b for a, b in inside)
        bare = spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "decoder": None}
        self.last = Tokenizer.from_str(json.dumps(bare))
        self.mid = Tokenizer.from_str(json.dumps(bare | {"model": spec["model"] | {"end_of_word_suffix": None}}))
        self.word: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.frag: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.raw = [i.to_bytes(4, "little") for i in range(max(self.names) + 1)]
        # Of lower-case letters, the pairs that are certain cuts; most words have none.
        letters = "abcdefghijklmnopqrstuvwxyz"
        cuts = [a + b for a in letters for b in letters if a + b not in self.inside]
        self.has_cut = re.compile("|".join(cuts)).search if cuts else lambda _: None
        self.most = words, fragments

    def pretokens(self, word: str) -> list[str]:
        """The pre-tokens of a word, in the vocabulary's alphabet."""
        if not _PLAIN.fullmatch(word):
            return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))]
        low = word.lower()
        parts = [low] if low.isalpha() else self.pattern.findall(low)
        return ["".join([_MAP[b] for b in p.encode()]) if not p.isascii() or not p.isprintable() else p for p in parts]

    def fragments(self, pre: str) -> list[str]:
        """A pre-token cut wherever its byte pair is in no vocabulary token."""
        inside, cuts = self.inside, [0]
        cuts += [k for k in range(1, len(pre)) if pre[k - 1 : k + 1] not in inside]
        return [pre[a:b] for a, b in zip(cuts, [*cuts[1:], len(pre)])]

    def learn(self, words: list[str], rotate: bool = True) -> None:
        """Put the encodings of new words into the dictionary."""
        mid, last = self.frag
        cut: list[tuple[str, list[list[str]]]] = []
        need: tuple[set, set] = (set(), set())
        if rotate and len(self.word) + len(words) > self.most[0]:
            self.word, self.older = {}, self.word
        known = [w for w in words if w in self.older]
        self.word.update((w, self.older[w]) for w in known)
        if known:
            words = [w for w in words if w not in self.word]
        if len(mid) + len(last) > self.most[1]:
            mid.clear()
            last.clear()
        single: list[tuple[str, str, str]] = []
        for w in words:
            # Letters alone, or with a point or comma behind them, are one or two pre-tokens.
            end = w[-1] if w[-1] in ".," else ""
            low = w[:-1] if end else w
            if low.isascii() and low.isalpha():
                low = low.lower()
                if not self.has_cut(low):
                    if low not in last:
                        need[1].add(low)
                    if end and end not in last:
                        need[1].add(end)
                    single.append((w, low, end))
                    continue
            if "<" in w and any(s in w for s in self.special):
                self.word[w] = self._bytes(self.library.encode(w, add_special_tokens=False).ids)
                continue
            parts = [self.fragments(p) for p in self.pretokens(w)]
            for p in parts:
                need[0].update(f for f in p[:-1] if f not in mid)
                if p[-1] not in last:
                    need[1].add(p[-1])
            cut.append((w, parts))
        for tok, held, new in ((self.mid, mid, need[0]), (self.last, last, need[1])):
            new = list(new)
            for f, e in zip(new, tok.encode_batch_fast(new, add_special_tokens=False) if new else []):
                held[f] = self._bytes(e.ids)
        held = self.word
        for w, low, end in single:
            a = last[low]
            if end:
                b = last[end]
                a = a + b
            held[w] = a
        for w, parts in cut:
            held[w] = b"".join([x for p in parts for x in [*(mid[f] for f in p[:-1]), last[p[-1]]]])
        for held, new in ((mid, need[0]), (last, need[1])):
            for f in new:
                if len(f) > LONG:
                    del held[f]

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.raw[i] for i in ids])

    def decode(self, ids: bytes) -> str:
        """The text of ids as little-endian 32-bit integers; the vocabulary has no
        decoder, so tokens' names are joined by spaces, special ones included."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def __call__(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids as little-endian 32-bit integers, and the decoded text, of each."""
        out = []
        for t in texts:
            words = _SPLIT.findall(t)
            held = self.word
            new = [w for w in dict.fromkeys(words) if w not in held]
            if new:
                self.learn(new)
                if self.word is not held:  # a new generation: this text needs words of both
                    self.learn([w for w in dict.fromkeys(words) if w not in self.word], False)
                held = self.word
            ids = b"".join([held[w] for w in words])
            for w in new:
                if len(w) > LONG:
                    held.pop(w, None)
            out.append((ids, self.decode(ids)))
        return out


def codec(path: str) -> Codec:
    return worker_state(("bpe", path), lambda: Codec(path))


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` for every row, ids as binary."""
    small_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            got = c(["" if t is None else t for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(i) // 4 for i, _ in got], pa.int64()), pa.array([i for i, _ in got], pa.binary()), pa.array([d for _, d in got], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digest_rows(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` and the kept columns.

    The digests are taken in the worker, so that ids and decoded texts need not
    travel back.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *keep)
    names = ["doc_id", *keep, "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            got = c(["" if t is None else t for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), *[b.column(2 + k) for k in range(len(keep))], pa.array([len(i) // 4 for i, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in got]), pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in got]),
                ],
                names,
            )

    kept = "".join(f"`{k}` {kinds[k]}, " for k in keep)
    return rows.mapInArrow(run, f"doc_id long, {kept}n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded texts of all ``documents``, as digests."""
    return digest_rows(load(spark, sf_dir, "documents"))
