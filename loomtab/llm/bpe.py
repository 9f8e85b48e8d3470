"""BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a block of rows become one flat array of symbols
with links to the next and previous symbol. The index maps the rank of each
pair to all positions where that pair stands. Active ranks are taken in
ascending order; all occurrences of a rank are merged at once, and only the
lists of the pairs to the left and right of a merge change.

A merge list in which each merge makes a new token, and uses only tokens made
before it, never makes a pair of a lower rank than the merge, so the ascending
sweep gives what merging the lowest rank first in each word gives. Other merge
lists are refused.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# What the tokenizer file has to say about normalising, splitting and its model, for plain texts to be split by SPLIT.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}

NONE = np.int64(1 << 40)
#: Characters whose lower case and composed form are the same everywhere and
#: among which there is no white space. Pieces of text with others are normalised
#: and split by the tokenizers library's own parts, and then merged like the rest.
PLAIN = regex.compile(r"[\x21-\x7e\xa1-įı-ſ\n]*")
SPLIT = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Bytes of text whose new pre-tokens are merged together.
BLOCK_BYTES = 16 << 20
#: Pieces and ids that a worker keeps before it starts afresh.
CACHE_ENTRIES = 500_000
CACHE_IDS = 8_000_000


def byte_letters() -> list[str]:
    """The letter for each byte in byte-level BPE: itself where it prints, else 256 and up."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


def check(file: dict) -> None:
    """Refuse a tokenizer file that says anything else than what this module does."""
    parts = {
        "normalizer": (file.get("normalizer") or {}).get("normalizers") == NORMALIZERS,
        "pre_tokenizer": (file.get("pre_tokenizer") or {}).get("pretokenizers") == PRE_TOKENIZERS,
        "model": all(file["model"].get(k, v) == v for k, v in MODEL.items()),
        "post_processor": file.get("post_processor") is None,
        "decoder": file.get("decoder") is None,
        "added_tokens": all(t[k] == v for t in file.get("added_tokens", []) for k, v in ADDED.items()),
    }
    if wrong := [k for k, holds in parts.items() if not holds]:
        raise ValueError(f"this tokenizer file needs other rules: {', '.join(wrong)}")


class Slots(dict):
    """A number for each piece of text; new ones are noted in the order of their numbers."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = at = len(self)
        self.new.append(piece)
        return at

    def taken(self) -> list[bytes]:
        new, self.new = self.new, []
        return new


class Encoder:
    """ids of texts by the vocabulary file, as the tokenizers library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        check(model)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.suffix = model["model"]["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.final = np.array([vocab[x + self.suffix] for x in letters], np.int64)
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in merges]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[self.made] = np.arange(len(pairs))
        if len(set(self.made.tolist())) != len(pairs) or (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError("this merge list isn't in the order of its tokens' making")
        self.twin = left == right
        keys = left << 20 | right
        self.by_key = np.argsort(keys, kind="stable")
        self.keys = keys[self.by_key]
        self.added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.byte_of = {x: b for b, x in enumerate(letters)}
        size = max([*vocab.values(), *(t["id"] for t in model.get("added_tokens", []))]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *((t["content"], t["id"]) for t in model.get("added_tokens", []))]:
            self.tokens[i] = token
        self.pieces = Slots()
        self.forget()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.by_key[at], NONE)

    def merge(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of words that stand one after another in raw and end before ends, none of them empty.

        Returns all ids and the number of them up to each word's end.
        """
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        end = len(raw)  # stands for no neighbour
        sym = np.append(self.inner[raw], 0)
        sym[ends - 1] = self.final[raw[ends - 1]]
        after, before = np.arange(1, end + 2), np.arange(-1, end)
        after[ends - 1], before[starts] = end, end
        rank = np.full(end + 1, NONE)
        rank[:end] = np.where(after[:end] == end, NONE, self.ranks(sym[:end], sym[after[:end]]))
        alive = np.ones(end, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(at: np.ndarray) -> None:
            own = rank[at]
            at, own = at[own < NONE], own[own < NONE]
            if not len(at):
                return
            order = np.argsort(own, kind="stable")
            at, own = at[order], own[order]
            cuts = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                r = int(own[i])
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(heap, r)

        post(np.arange(end))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            at = at[rank[at] == r]
            if not len(at):
                continue
            if self.twin[r]:
                taken, blocked = [], -1
                for p in np.sort(at).tolist():
                    if p != blocked:
                        taken.append(p)
                        blocked = int(after[p])
                at = np.array(taken)
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.made[r]
            alive[gone] = False
            rank[gone] = NONE
            after[at] = beyond
            before[beyond] = at
            back = before[at]
            touched = np.concatenate((at, back[back != end]))
            to = after[touched]
            rank[touched] = np.where(to == end, NONE, self.ranks(sym[touched], sym[to]))
            post(touched)
        return sym[:end][alive].astype(np.uint32), np.cumsum(alive)[ends - 1]

    def learn(self, pieces: list[bytes]) -> None:
        """Append the ids of these pieces of text, which hold no ASCII white space, to the store."""
        if not pieces:
            return
        whole = b"\n".join(pieces).decode("utf-8", "replace")
        if PLAIN.fullmatch(whole) and not any(x in whole for x in self.added):
            words = SPLIT.findall(whole.lower())
            raw = np.frombuffer("".join(words).encode(), np.uint8)
            first = np.append(np.flatnonzero(raw & 0xC0 != 0x80), len(raw))  # the byte where each character begins
            ends = first[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
            line = raw[ends - 1] == 10 if len(ends) else np.zeros(0, bool)
            real = np.cumsum(np.concatenate(([0], raw != 10)))[ends] if len(ends) else ends  # ends without line feeds
            ids, upto = self.merge(raw[raw != 10], real[~line])
            upto = np.concatenate(([0], upto))[np.concatenate((np.cumsum(~line)[line], [(~line).sum()]))]  # ids up to each piece's end
        else:
            words, counts, taken = [], [], {}
            for piece in whole.split("\n"):
                before = len(words)
                words += self.split(piece, len(words), taken)
                counts.append(len(words) - before)
            ids, upto = self.merge(np.frombuffer(b"".join(words), np.uint8), np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))
            lengths = np.diff(upto, prepend=0)
            for at in taken:
                lengths[at] = 1
            upto = np.concatenate(([0], np.cumsum(lengths)))
            if taken:
                # An added token stands as a word of one letter, which makes one id.
                ids = ids.copy()
                ids[upto[list(taken)]] = list(taken.values())
            upto = upto[np.cumsum(counts)]
        self.ids = np.concatenate((self.ids, ids))
        self.upto = np.concatenate((self.upto, self.upto[-1] + upto))

    def split(self, piece: str, at: int, taken: dict[int, int]) -> list[bytes]:
        """The words of a piece of text as bytes; those from number at on that are added tokens go to taken, with their ids."""
        words = []
        for part in self.cuts.split(piece) if self.cuts else [piece]:
            if part in self.added:
                taken[at + len(words)] = self.added[part]
                words.append(b"x")
            elif part:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    words.append(bytes(map(self.byte_of.__getitem__, word)))
        return words

    def forget(self) -> None:
        self.pieces.clear()
        self.ids, self.upto = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK_BYTES):
                size += len(texts[j])
                j += 1
            if len(self.pieces) > CACHE_ENTRIES or len(self.ids) > CACHE_IDS:
                self.forget()
            slot = self.pieces.__getitem__
            parts = [array("q", map(slot, t.split())) for t in texts[i:j]]
            counts = np.fromiter(map(len, parts), np.int64, j - i)
            at = np.frombuffer(b"".join(parts), np.int64)
            del parts
            self.learn(self.pieces.taken())
            start, length = self.upto[at], self.upto[at + 1] - self.upto[at]
            total = np.concatenate(([0], np.cumsum(length)))
            ids = self.ids[np.repeat(start - total[:-1], length) + np.arange(total[-1])].astype("<u4").tobytes()
            cuts = (total[np.concatenate(([0], np.cumsum(counts)))] * 4).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield ids[a:b]
            i = j

    def decode(self, ids: bytes) -> str:
        """The text of ids; a file without a decoder joins its tokens by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for the file; its cache lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def encoded(docs: DataFrame, path: str | None, schema: str, row: Callable, columns: list[str]) -> DataFrame:
    """For each row, what row(encoder, ids) gives (a list of tuples), after the named columns of the row."""
    ship(docs.sparkSession)

    def run(batches):
        from loomtab.llm import bpe

        coder = bpe.encoder(bpe.vocabulary(path))
        for batch in batches:
            made, source = [], []
            for k, ids in enumerate(coder.encode(bpe.texts_of(batch, "text"))):
                for x in row(coder, ids):
                    made.append(x)
                    source.append(k)
            kept = pa.RecordBatch.from_arrays([batch.column(c) for c in columns], names=columns).take(pa.array(source, pa.int64()))
            width = len(fields)
            cols = [pa.array([m[i] for m in made], fields[i].type) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *cols], names=[*columns, *(f.name for f in fields)])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(schema)
    fields = list(to_arrow_schema(out))
    full = StructType([docs.schema[c] for c in columns] + out.fields)
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, full)


def encode_table(docs: DataFrame, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and decoded text of each row of docs.

    A null text counts as an empty one and has no ids; equal rows give equal
    rows; a null doc_id stays null; other columns of docs are ignored; an empty
    table gives an empty one. Texts of any length are encoded whole.
    """

    def row(coder, ids):
        return [(len(ids) // 4, np.frombuffer(ids, "<u4").astype(np.int32) if keep_ids else None, coder.decode(ids))]

    return encoded(docs, tokenizer, "n_tokens long, ids array<int>, decoded string", row, ["doc_id"])


def digest_table(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The digests of encode_table's results, made where the ids are, so that they needn't travel."""

    def row(coder, ids):
        from hashlib import sha256

        return [(len(ids) // 4, sha256(ids).hexdigest(), sha256(coder.decode(ids).encode("utf-8", "replace")).hexdigest())]

    return encoded(docs, tokenizer, "n_tokens long, ids_sha256 string, decoded_sha256 string", row, ["doc_id"])


def decode_table(df: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and text of a table of doc_id and ids (array of int); null ids give a null text."""
    ship(df.sparkSession)

    def run(batches):
        from loomtab.llm import bpe

        coder = bpe.encoder(bpe.vocabulary(tokenizer))
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select("doc_id", F.col("ids")).mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, text string")
