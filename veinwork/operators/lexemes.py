"""Where each lexeme stands in each text, by Arrow batches: words of many texts are told apart, numbered and sorted at once.

A row holds one lexeme of one block of texts: (lexeme, block, most, ids, ends, positions). ``positions`` are the places of its
occurrences in all of these texts, ``ends`` where those of each id end, ``most`` the largest number that any id has. So a
lexeme that many texts share costs a row for many of them, and no list in Python or row in the JVM is made for each.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinwork.functions import spanish
from veinwork.functions import text as text_functions

ROWS = "lexeme string, block int, most int, ids array<long>, ends array<int>, positions array<int>"
WORD = re.compile(r"[^\W_]+")
#: Texts of so many characters are worked on at once.
CHARACTERS = 16 << 20
#: Blocks of one class of text lengths; classes are powers of two of the number of characters.
SHARES = 8


def _table(folded: bool) -> bytes:
    """What each Latin-1 character becomes: its (folded) lower case if it belongs to a word, else a space."""
    same = text_functions.plain_text if folded else str.lower
    return "".join(same(c) if WORD.match(c) else " " for c in map(chr, range(256))).encode("latin-1")


_FOLDED, _LOWER = _table(True), _table(False)


def spaced(text: str, folded: bool) -> str:
    """The text's words in lower case, without diacritics if ``folded``, with white space between them."""
    try:
        return text.encode("latin-1").translate(_FOLDED if folded else _LOWER).decode("latin-1").strip()
    except UnicodeEncodeError:
        return " ".join(WORD.findall(text_functions.plain_text(text) if folded else text.lower()))


def _lexeme(word: str) -> str | None:
    return None if word in spanish.STOP else text_functions.plain_text(spanish.stem(word))


def _renamed(codes: np.ndarray, names: pa.Array, name: Callable) -> tuple[np.ndarray, pa.Array]:
    """``codes`` of words as codes of what ``name`` makes of them, -1 for nothing."""
    found = pa.array([name(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False)[codes], found.dictionary


def located(ids: list[int], texts: list[str], form: str) -> pa.RecordBatch:
    """ROWS of texts with a word; ``form`` is folded (text folded, then words), plain (words, then folded) or stemmed (stems of words with a meaning)."""
    # In the order of their blocks: then a word's number in the batch orders the places of its lexeme by block, text and place.
    # Texts of one batch are one share of their class, so their common lexemes share rows.
    block, ids, texts = zip(*sorted((len(t).bit_length() * SHARES + ids[0] % SHARES, i, t) for i, t in zip(ids, texts)))
    words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    starts = words.offsets.to_numpy()
    encoded = words.flatten().dictionary_encode()
    codes, names = encoded.indices.to_numpy(), encoded.dictionary.cast(pa.string())
    if form != "folded":
        codes, names = _renamed(codes, names, _lexeme if form == "stemmed" else text_functions.plain_text)
    key = np.sort((codes.astype(np.int64) << 32) | np.arange(len(codes)))
    key = key[np.searchsorted(key, 0) :]  # without stop words
    code, word = key >> 32, key & 0xFFFFFFFF
    of = np.repeat(np.arange(len(ids)), np.diff(starts))[word]
    at = (word - starts[of]).astype(np.int32)
    changed = np.diff(code, prepend=-1) != 0
    each = np.flatnonzero(changed | (np.diff(of, prepend=-1) != 0))  # where a text of a lexeme begins
    code, text, blocks = code[each], of[each], np.array(block, dtype=np.int32)
    row = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(blocks[text], prepend=-1) != 0))  # where a block of a lexeme begins
    rows = pa.array(np.append(row, len(each)).astype(np.int32))
    ends = np.append(each[1:], len(key))
    first = each[row]  # the first place of each row
    columns = [
        names.take(pa.array(code[row])),
        pa.array(blocks[text[row]]),
        pa.array(np.maximum.reduceat(ends - each, row).astype(np.int32)) if len(row) else pa.array([], pa.int32()),
        pa.ListArray.from_arrays(rows, pa.array(np.array(ids, dtype=np.int64)[text])),
        pa.ListArray.from_arrays(rows, pa.array((ends - np.repeat(first, np.diff(np.append(row, len(each))))).astype(np.int32))),
        pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(at)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ROWS.split(", ")])


def by_id(rows: DataFrame, positions: bool = True) -> DataFrame:
    """(lexeme, block, id, size, and positions if wanted) of ROWS: one row for each id of a lexeme."""
    begin = lambda i: F.coalesce(F.get("ends", i - 1), F.lit(0))
    one = lambda x, i: F.struct(x.alias("id"), (F.get("ends", i) - begin(i)).alias("size"), *([F.slice("positions", begin(i) + 1, F.get("ends", i) - begin(i)).alias("positions")] if positions else []))
    return rows.select("lexeme", "block", F.inline(F.transform("ids", one)))


def lexeme_rows(texts: DataFrame, form: str) -> DataFrame:
    """ROWS of ``texts`` (id, text; ids once, null texts hold nothing); a lexeme and block may have several rows."""
    for module in (spanish, text_functions, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)  # executors need no copy of this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        held: list[str] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own := spaced(text.as_py(), form == "folded"):
                    ids.append(i)
                    held.append(own)
                    size += len(own)
                if size > CHARACTERS:
                    yield located(ids, held, form)
                    ids, held, size = [], [], 0
        if held:
            yield located(ids, held, form)

    return texts.filter("text is not null").select("id", "text").mapInArrow(run, ROWS)
