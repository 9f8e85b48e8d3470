"""Fill-in-middle: a text is cut at two of its units and its parts are put into another order.

A unit is a run of ASCII letters or any other single character. One automaton
looks for the pairs of ASCII characters at which a run begins or ends, and for
the sentinels; characters beyond ASCII count as one that is no letter. Between
two such events lies one class only, so the gap says by arithmetic how many
units it holds: one for letters, its length for anything else. A unit's place
is looked up among the events alone; the units themselves are never made.
"""

from __future__ import annotations

import string
from functools import cache
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Of a hundred documents so many are transformed, and of a hundred of these so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Texts of an output batch hold so many bytes, or one text.
BATCH_BYTES = 32 << 20


@cache
def automaton() -> ahocorasick.Automaton:
    """Pairs of a letter and another character, in both orders, and the sentinels; the value tells which."""
    found = ahocorasick.Automaton()
    others = [chr(c) for c in range(128) if chr(c) not in string.ascii_letters]
    for letter in string.ascii_letters:
        for other in others:
            found.add_word(letter + other, 0)
            found.add_word(other + letter, 0)
    for s in SENTINELS:
        found.add_word(s, 1)
    found.make_automaton()
    return found


def events(text: str) -> tuple[np.ndarray, bool]:
    """Where the class of the characters changes, and whether the text holds a sentinel."""
    plain = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")
    # A sentinel's event is negative: it needs no second pass.
    at = np.fromiter((-1 if kind else k for k, kind in automaton().iter(plain)), np.int64)
    held = at < 0
    return at[~held], bool(held.any())


class Units:
    """The units of a text, by its events."""

    def __init__(self, text: str):
        self.chars = len(text)
        found, self.marked = events(text)
        self.starts = np.concatenate(([0], found)) if self.chars else np.zeros(0, np.int64)
        lengths = np.diff(np.append(self.starts, self.chars))
        first = bool(text) and text[0] in string.ascii_letters
        self.letters = (np.arange(len(self.starts)) % 2 == 0) == first
        self.before = np.concatenate(([0], np.cumsum(np.where(self.letters, 1, lengths))))
        self.n = int(self.before[-1])

    def end_of(self, k: int) -> int:
        """The characters that the first k units take."""
        if k >= self.n:
            return self.chars
        gap = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[gap]) + (0 if self.letters[gap] else k - int(self.before[gap]))


def cut(text: str, doc_id, seed: int = 1) -> tuple[int, str, int, int]:
    """The number of units, the form (plain, psm or spm) and where prefix and middle end."""
    units = Units(text)
    hashed = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hashed[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or units.marked or h3 % 100 >= TRANSFORMED:
        return units.n, "plain", 0, 0
    low, high = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    return units.n, "spm" if h4 % 100 < SUFFIX_FIRST else "psm", units.end_of(low), units.end_of(high)


def output_of(text: str, form: str, low: int, high: int) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text, from the output and its form alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    a, rest = output[len(first) :].split(second, 1)
    b, middle = rest.split(MIDDLE, 1)
    return b + middle + a if form == "spm" else a + middle + b


def decoded(text: bytes | None) -> str:
    return (text or b"").decode("utf-8", "surrogateescape")


def encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def rows_of(batch: pa.RecordBatch, seed: int, whole: bool):
    """Record batches of the transformed rows: outputs as text, or as digests with those of the restored texts."""
    out, held = [], 0
    ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
    for k in range(batch.num_rows):
        text = decoded(texts[k].as_py())
        n, form, low, high = cut(text, ids[k].as_py(), seed)
        made = output_of(text, form, low, high)
        parts = (None, None) if form == "plain" else (low, high - low)
        last = (encoded(made),) if whole else (sha256(encoded(made)).hexdigest(), sha256(encoded(restore(made, form))).hexdigest())
        out.append((k, n, form, *parts, *last))
        held += len(last[0]) if whole else 0
        if held > BATCH_BYTES:
            yield packed(out, ids, whole)
            out, held = [], 0
    if out:
        yield packed(out, ids, whole)


def packed(rows: list[tuple], ids: pa.Array, whole: bool) -> pa.RecordBatch:
    at, *columns = zip(*rows, strict=True)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *([pa.binary()] if whole else [pa.string(), pa.string()])]
    arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
    if whole:
        arrays[-1] = pa.Array.from_buffers(pa.string(), len(rows), arrays[-1].buffers())
    names = ["n", "form", "prefix_chars", "middle_chars", *(["output"] if whole else ["output_sha256", "restored_sha256"])]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *arrays], names=["doc_id", *names])


def transform(spark: SparkSession, docs: DataFrame, seed: int = 1, digests: bool = False) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of each row of docs.

    With digests, output_sha256 and restored_sha256 (of the text rebuilt from
    the output) stand in the output's place. The two cuts, whether a document
    is transformed and the order of its parts depend on seed and doc_id alone.
    A null text counts as an empty one, which stays plain, as do texts that
    hold a sentinel; a null doc_id is hashed as an empty string; repeated rows
    give repeated rows; bytes that aren't UTF-8 count as a character each and
    are kept; other columns are ignored; an empty table gives an empty one.
    """
    ship(spark)

    def run(batches):
        from loomtab.llm import fill_in_middle as f

        for batch in batches:
            yield from f.rows_of(batch, seed, not digests)

    kind = docs.schema["doc_id"].dataType.simpleString()
    last = "output_sha256 string, restored_sha256 string" if digests else "output string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, {last}")
