"""Line-first cleaning of texts, and the verdict on what is left.

Each line with a word is judged by itself: a line fails as navigation (menus and
tables: separators between most words, or a short list of menu words), as
boilerplate (licence, copyright, cookie and sign-in notices), or on punctuation
(shouting, signs glued to most words, a word said again and again, or a longer
line without any sentence mark). Failing lines go; a document that loses more
than ``most_lost`` of its words to that is rejected.

All of it is done where a row is read; nothing is shuffled.

Defined results: a NULL or empty text has no words, fails the base rule and
loses nothing. A text whose every word goes is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as t

from caselight.llm import text as T

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
MOST_LOST = 0.5

# What menus and notices say.
NAVIGATION_WORDS = (
    "home", "menu", "search", "login", "register", "next", "previous", "contact", "about", "sitemap", "share",
    "tweet", "print", "top", "more", "faq", "help", "blog", "archive", "categories", "tags",
)
BOILERPLATE = (
    "all rights reserved", "copyright", "licensed under", "license, version", "released under the", "terms of use",
    "terms of service", "privacy policy", "cookie", "enable javascript", "lorem ipsum", "sign in", "sign up",
    "log in", "subscribe to", "click here", "read more",
)

_SEPARATORS = frozenset([b"|", b">", b">>", b"/", b"-", b"*", "»".encode(), "›".encode(), "•".encode(), "·".encode()])
_NAVIGATION = frozenset(x.encode() for x in NAVIGATION_WORDS)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_SENTENCE = re.compile(rb"[.!?:;,]|\xe2\x80\xa6|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xd8\x9f|\xe0\xa5\xa4")
_SHOUT = re.compile(rb"[!?]{2,}(?:\s|$)")
_GLUED = re.compile(rb"[#*$%&<>]{2,}(?:\s|$)")
SYMBOLS = b"#*$%&|<>"


def line_fault(line: bytes, found: list[bytes]) -> str | None:
    """Why a line fails, given its words; None if it does not."""
    n = len(found)
    separators = sum(w in _SEPARATORS for w in found)
    if separators >= 3 and 4 * separators >= n or n <= 12 and 2 * sum(w.lower() in _NAVIGATION for w in found) > n:
        return "navigation"
    if n <= 30 and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if n >= 4:
        if 2 * len(_SHOUT.findall(line)) > n or 2 * len(_GLUED.findall(line)) > n:
            return "punctuation"
        if n >= 12 and 3 * sum(a == b for a, b in zip(found, found[1:])) > n:
            return "punctuation"
        if n >= 20 and not _SENTENCE.search(line):
            return "punctuation"
    return None


def repeated_words(found: list[bytes]) -> int:
    """Words in a three-word window that stands twice or more in the text."""
    n = len(found)
    if n < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), dtype=np.int64, count=n)
    pairs = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, times = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : k + n - 2] |= again
    return int(covered.sum())


def judged_lines(raw: bytes) -> tuple[list[bytes], int, int, int]:
    """Lines that stay, words that go, lines equal to an earlier one, and words
    in all. Lines without a word stay and count for nothing."""
    stay, lost, twice, total = [], 0, 0, 0
    seen: set[bytes] = set()
    for line in raw.split(b"\n"):
        found = line.split()
        if found:
            total += len(found)
            twice += line in seen
            seen.add(line)
            if line_fault(line, found):
                lost += len(found)
                continue
        stay.append(line)
    return stay, lost, twice, total


def clean_lines(df: DataFrame, text: str = "text", kept: str = "kept", most_lost: float = MOST_LOST) -> DataFrame:
    """``df`` with failing lines taken out of ``text``, and ``kept``: whether
    enough of it is left. Other columns pass through."""
    fields = [f for f in df.schema.fields if f.name != kept]
    schema = t.StructType([*fields, t.StructField(kept, t.BooleanType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, verdicts = [], []
            for value in batch.column(text).to_pylist():
                stay, lost, _, total = judged_lines((value or "").encode())
                texts.append(None if value is None else b"\n".join(stay).decode())
                verdicts.append(lost <= most_lost * total and (lost < total or not total))
            columns = [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(verdicts, pa.bool_())], names=schema.names)

    return df.mapInArrow(run, schema)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(df: DataFrame, key: str = "doc_id", text: str = "text", most_lost: float = MOST_LOST) -> DataFrame:
    """Per row: its key, the base counts, ``base_failed`` and ``kept``, the
    verdict of line-first cleaning on texts that pass the base rule."""
    schema = t.StructType([df.schema[key], *(t.StructField(n, t.LongType()) for n in _MEASURES)])
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("lost_words", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.parts(batch, text):
                data, bounds = T.buffer(part.column(text))
                signs = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~T.SPACE[data])])[bounds]
                raw = data.tobytes()
                rows = []
                for first, last in zip(bounds.tolist(), bounds[1:].tolist()):
                    own = raw[first:last]
                    found = own.split()
                    _, lost, twice, n = judged_lines(own)
                    repeated = repeated_words(found)
                    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED_PERCENT * n
                    symbols = len(own) - len(own.translate(None, SYMBOLS))
                    rows.append((n, symbols, twice, repeated, failed, not failed and lost <= most_lost * n, lost))
                n, symbols, twice, repeated, failed, kept, lost = zip(*rows)
                chars = np.diff(signs)
                columns = [part.column(key), *map(pa.array, (n, chars, symbols, twice, repeated, failed, kept, lost))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
