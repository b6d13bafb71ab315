"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to ``HUGE`` characters is encoded at once.  A longer one is
encoded in chunks of ``CHUNK`` characters that overlap by ``OVERLAP``, each with
offsets.  Two neighbours are spliced at a pre-token boundary that both have.
Such a boundary p is proven: the splitting scan of a byte-level vocabulary
keeps no state but its position, so from p on the right chunk's tokens are the
text's own; and the left chunk's tokens up to p are too when it began at a
proven boundary and p lies ``MARGIN`` before its end, where no special string
or look-ahead can reach past it.  Where the overlap has no common boundary it
is doubled, up to the whole chunk; then the chunk itself doubles.

Short texts in common Latin characters are counted with the vocabulary as
ranks (the merges' order is checked when it is loaded); every other text goes
to the vocabulary's own library.  Both give the library's tokens: no begin or
end tokens, special strings as its default has them, no truncation or padding.

Defined results: null counts as empty, with 0 bytes and 0 tokens; every row
gives a row; an empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, small_batches, worker_state

HUGE, CHUNK, OVERLAP = 32768, 16384, 256
LIMIT = 1024
_LATIN = re.compile("[\x00-ɏ‐-‧€]*")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks by bytes, if its merges' order is its ids'."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab, pre = spec["model"]["vocab"], spec.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    made = [vocab.get(a + b) for a, b in merges]
    if None in made or sorted(set(made)) != made or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec.get("normalizer"):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(byte_of[c] for c in k): v for k, v in vocab.items() if k not in special}


class Counter:
    """Counts the tokens of a text as the library of one vocabulary file does."""

    def __init__(self, path: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.margin = max([8, *(len(s) + 1 for s in self.special)])
        self.huge, self.chunk, self.overlap = huge, chunk, overlap
        self.fast = None
        if ranks := _ranks(spec):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> int:
        if len(text) > self.huge:
            return self.spliced(text)
        if self.fast is not None and _LATIN.fullmatch(text) and not any(s in text for s in self.special):
            return len(self.fast.encode_ordinary(text))
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _encode(self, text: str, start: int, end: int) -> tuple[int, dict[int, int]]:
        """Tokens of ``text[start:end]``, and tokens before each boundary."""
        e = self.library.encode(text[start:end], add_special_tokens=False)
        bounds, before = {}, -1
        for k, (w, (a, _)) in enumerate(zip(e.word_ids, e.offsets)):
            if w is None or w != before:
                bounds.setdefault(start + a, k)
            before = w
        return len(e.ids), bounds

    def spliced(self, text: str) -> int:
        total, at, end = 0, 0, min(len(text), self.chunk)
        n, bounds = self._encode(text, at, end)
        skip = 0  # tokens of the current chunk that lie before the proven boundary
        while end < len(text):
            overlap = self.overlap
            while True:
                start = max(at, end - overlap)
                # Past a chunk without any boundary the next one doubles, so that runs stay linear.
                until = min(len(text), end + (self.chunk if start > at else max(self.chunk, end - at)))
                m, right = self._encode(text, start, until)
                last = max((p for p in right if p <= end - self.margin and p >= at and p in bounds), default=-1)
                if last > at and (start > at or last in right):
                    break
                if start == at:  # the overlap is the whole chunk: encode on from its proven start
                    last = -1
                    break
                overlap *= 2
            if last < 0:
                n, bounds, skip, end = m, right, 0, until
                continue
            total += bounds[last] - skip
            n, bounds, skip, at, end = m, right, right[last], last, until
        return total + n - skip


def _counter(path: str) -> Counter:
    return worker_state(("counts", path), lambda: Counter(path))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row."""
    small_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            n = [count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token counts of all ``documents``."""
    return token_counts(load(spark, sf_dir, "documents"))
