"""Token counts of whole texts, by overlap resynchronisation for huge ones.

A text of at most ``chunk_chars`` is encoded at once. A longer one is encoded
in chunks that overlap. A boundary is proven stable where both encodings start
a token at a space that follows a non-space and precedes one: the tokenizer's
splitting pattern always starts a piece there and never looks back, so all
tokens before it come from the left chunk and all after it from the right one.
If the overlap has no such boundary it is doubled, up to the end of the text.

Short texts of common Latin characters take the merge table's other encoder
(same ranks, same pieces), which is several times faster; any other character
or a special string sends the text to the reference library. A test holds the
two against each other over every character of that class.

Cases: a null or empty text has no bytes and no tokens; special strings inside
a text are handled as the library does by default; a text without any space
is one chunk in the end, however long.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veinwork.llm.common import append_columns, arrow_batches

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
LIMIT = 1024
CHUNK_CHARS = 1 << 14
OVERLAP_CHARS = 1 << 8

#: Characters on which both encoders split alike.
COMMON = re.compile("[\t\n\r -~¡-¬®-ɏ‐-‧€]*")
SPECIAL = "<|endoftext|>"
_STABLE = re.compile(r"(?<=[^\s]) (?=[^\s])")


class Counter:
    """Counts tokens as the library of the vocabulary file does."""

    def __init__(self, vocabulary: str, ranks: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def whole(self, text: str) -> int:
        if self.fast is not None and SPECIAL not in text and COMMON.fullmatch(text):
            return len(self.fast.encode_ordinary(text))
        return len(self.library.encode(text, add_special_tokens=False))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return self.whole(text) if len(text) <= self.chunk else self.spliced(text)

    def _starts(self, start: int, end: int, text: str) -> list[int]:
        return [start + a for a, _ in self.library.encode(text[start:end], add_special_tokens=False).offsets]

    def spliced(self, text: str) -> int:
        """Tokens of a huge text: one chunk and one overlap are in memory, not the text's tokens."""
        n, total, begin = len(text), 0, 0
        end = min(n, self.chunk)
        left = self._starts(begin, end, text)
        while end < n:
            overlap = self.overlap
            while True:
                back = max(begin, end - overlap)
                ahead = min(n, end + self.chunk)
                right = self._starts(back, ahead, text)
                cut = self._common(left, right, back, end, text)
                if cut is not None or back == begin:
                    break
                overlap *= 2
            if cut is None:  # no boundary in all of the left chunk: it grows
                end = min(n, end + max(self.chunk, end - begin))
                left = self._starts(begin, end, text)
                continue
            total += sum(a < cut for a in left)
            begin, end, left = cut, ahead, [a for a in right if a >= cut]
        return total + len(left)

    @staticmethod
    def _common(left: list[int], right: list[int], back: int, end: int, text: str) -> int | None:
        """The last stable boundary inside the overlap at which both encodings start a token."""
        both = set(left) & set(right)
        stable = [m.start() for m in _STABLE.finditer(text, back, min(end, len(text))) if back < m.start() < end - 1]
        return next((p for p in reversed(stable) if p in both), None)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``vocabulary`` is a file that every executor can open; by default the one
    that the installed package of public tokenizers holds.
    """
    arrow_batches(docs.sparkSession)
    own = vocabulary

    def make() -> Callable:
        count = _counter(own, chunk_chars, overlap_chars).count
        return lambda texts: {"n_tokens": pa.array([count(t) for t in texts], pa.int64())}

    out = append_columns(docs, [T.StructField("n_tokens", T.LongType())], make)
    return out.withColumns({"n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"), "over_limit": F.col("n_tokens") > limit})


_kept: dict = {}


def _counter(vocabulary: str | None, chunk_chars: int, overlap_chars: int) -> Counter:
    key = (vocabulary, chunk_chars, overlap_chars)
    if key not in _kept:
        if vocabulary is None:
            import public_tokenizers

            _kept[key] = Counter(str(public_tokenizers.path(VOCABULARY)), str(public_tokenizers.path(RANKS)), chunk_chars, overlap_chars)
        else:
            _kept[key] = Counter(vocabulary, None, chunk_chars, overlap_chars)
    return _kept[key]


def token_counts(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``op6``."""
    return count_tokens(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
