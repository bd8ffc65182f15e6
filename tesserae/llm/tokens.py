"""Byte-level BPE over cached space-delimited chunks, and exact token counts at every prefix.

A text is cut before every space whose next character is no white space. The
library's pre-tokenizer never joins what lies on both sides of such a cut, so
what a chunk yields can be computed once and gathered for all its occurrences.

Prefix counts follow from dynamic programming: the last token of the encoding
of a prefix is the one vocabulary item that ends there and is compatible with
the last token of the prefix before it, that is, the pair encodes to itself. So
one pass over a piece gives the token count of each of its prefixes, and
truncation and budget questions need no second encoding.

Defined results: a null text counts as empty and has 0 tokens; strings of
special tokens inside texts are special, as is the library's default; an empty
table gives an empty result; other columns of the input play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import small_batches, text_or_empty

VOCABULARY = "byte_bpe_50k.json"
# A space before white space: texts with one, and those that begin or end with a space, are not cut into chunks.
_UNEVEN = tuple(" " + chr(c) for c in range(1 << 16) if chr(c).isspace())
_UNEVEN_ASCII = tuple(x for x in _UNEVEN if x.isascii())
# From this character on, libraries may differ in the Unicode version by which they tell letters.
PLAIN_SCRIPTS = "\u0530"
_AFTER_BLANK = re.compile(r"(?<=\s) ")
# Longer chunks go to the library as well: the ranked encoder's pattern fails on runs of white space of a megabyte.
LONG_CHUNK = 20_000
CACHED_CHUNKS, CACHED_VALUES = 1_000_000, 1 << 25


class Gathered:
    """Arrays per chunk, kept end to end, for chunks numbered in order of arrival; ``fill`` gives them end to end, and the length of each."""

    def __init__(self, fill: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype):
        self.fill, self.dtype = fill, dtype
        self.clear()

    def clear(self) -> None:
        self.inner, self.first = _Numbered(), _Numbered()
        self.flat = np.zeros(1 << 16, self.dtype)
        self.start, self.length, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.inner.total = self.first.total = [0]

    def numbers(self, text: str) -> list[int]:
        """Numbers of the chunks of a text that is cut at its spaces."""
        head, *rest = text.split(" ")
        return [self.first[head], *map(self.inner.__getitem__, rest)]

    def settle(self) -> None:
        """Compute what chunks seen for the first time yield."""
        new = [(n, s) for s, n in self.first.new] + [(n, " " + s) for s, n in self.inner.new]
        self.first.new, self.inner.new = [], []
        if not new:
            return
        flat, lengths = self.fill([s for _, s in new])
        need = self.used + len(flat)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need - len(self.flat), len(self.flat)), self.dtype)])
        count = self.first.total[0]
        if count > len(self.start):
            more = np.zeros(max(count - len(self.start), len(self.start)), np.int64)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        at = np.fromiter((n for n, _ in new), np.int64, len(new))
        self.length[at] = lengths
        self.start[at] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : need] = flat
        self.used = need

    def gather(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' arrays end to end, and the length of each."""
        lengths = self.length[chunks]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[chunks] - ends + lengths, lengths) + np.arange(total)
        return self.flat[at], lengths


class _Numbered(dict):
    """Numbers unseen keys as they are asked for and remembers them in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[tuple[str, int]] = []
        self.total = [0]

    def __missing__(self, key: str) -> int:
        number = self[key] = self.total[0]
        self.total[0] += 1
        self.new.append((key, number))
        return number


class BytePairs:
    """The vocabulary, its encoders and the prefix counts of pieces."""

    def __init__(self, name: str):
        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        byte_of = {letter: byte for byte, letter in _byte_letters().items()}
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = sorted(added, key=len, reverse=True)
        self.vocab = {bytes(map(byte_of.__getitem__, s)): i for s, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if s not in added}
        self.bytes_of = {i: s for s, i in self.vocab.items()}
        self.token_bytes = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.token_bytes[list(self.bytes_of)] = [len(x) for x in self.bytes_of.values()]
        # ids rank the merges in this vocabulary, so the ranked encoder gives the same ids for a piece
        self.ranked = tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.vocab, special_tokens={})
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.longest = max(map(len, self.vocab))
        self.pair_ok: dict[int, bool] = {}
        self.pieces: dict[str, np.ndarray] = {}
        self.held = 0  # characters of the pieces known
        # for the array form: tokens of up to 8 bytes by length, packed big-endian, and the last 8 bytes of longer ones
        packed = lambda x: int.from_bytes(x, "big")
        self.short = {}
        for n in range(1, 9):
            found = sorted((packed(s), i) for s, i in self.vocab.items() if len(s) == n)
            self.short[n] = np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found], np.int64)
        self.long_ends = np.unique(np.array([packed(s[-8:]) for s in self.vocab if len(s) > 8], np.uint64))
        self.memo_key, self.memo_ok = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of chunks, end to end, and the number of each.

        Chunks that begin with a space are cut from texts where the pre-tokenizer cuts too, so they are encoded in one go and told apart by
        the bytes of the tokens. Those of the plain scripts, on which both agree, go to the ranked encoder.
        """
        out, counts = [], np.zeros(len(chunks), np.int64)
        kinds = np.fromiter(((not c.startswith(" ")) + 2 * (len(c) > LONG_CHUNK or (not c.isascii() and max(c) >= PLAIN_SCRIPTS)) for c in chunks), np.int64, len(chunks))
        place = np.zeros(len(chunks), np.int64)
        for kind in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == kind)
            for group in [own] if kind in (0, 2) else own[:, None]:
                text = "".join([chunks[k] for k in group])
                ids = np.array(self.ranked.encode_ordinary(text) if kind < 2 else self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
                ends = np.cumsum([len(chunks[k].encode()) for k in group])
                upto = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends, side="right")
                counts[group], place[group] = np.diff(upto, prepend=0), sum(map(len, out)) + np.append(0, upto[:-1])
                out.append(ids.astype(np.uint32))
        flat = np.concatenate(out) if out else np.zeros(0, np.uint32)
        at = np.repeat(place - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        return flat[at], counts

    def library_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def follows(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes encode to just these two tokens; left is -1 at the start of a piece."""
        key = (left + 1) << 32 | right
        known = self.pair_ok.get(key)
        if known is None:
            if len(self.pair_ok) >= 1 << 21:
                self.pair_ok.clear()
            pair = [left, right] if left >= 0 else [right]
            known = self.pair_ok[key] = self._encode(pair) == pair
        return known

    def _encode(self, tokens: list[int]) -> list[int]:
        return self.ranked._core_bpe.encode_single_piece(b"".join(map(self.bytes_of.__getitem__, tokens)))

    def byte_prefixes(self, raw: bytes) -> np.ndarray:
        """Token counts of all prefixes of a piece, the empty one first."""
        vocab, counts, last = self.vocab, [0], [-1]
        for end in range(1, len(raw) + 1):
            for begin in range(end - 1, max(0, end - self.longest) - 1, -1):
                token = vocab.get(raw[begin:end])
                if token is not None and self.follows(last[begin], token):
                    counts.append(counts[begin] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {end} of {raw!r}")
        return np.array(counts, np.int32)

    def _follows(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """follows() for arrays, by way of a table of answers that new ones overwrite."""
        key = (left + 1) << 32 | right
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)
        ok = self.memo_ok[slot]
        for k in np.flatnonzero(self.memo_key[slot] != key):
            ok[k] = self.memo_ok[slot[k]] = self.follows(int(left[k]), int(right[k]))
            self.memo_key[slot[k]] = key[k]
        return ok

    def many_byte_prefixes(self, raws: list[bytes]) -> list[np.ndarray]:
        """byte_prefixes() of many pieces: the same recurrence, one end position of all pieces at a time."""
        out: list[np.ndarray | None] = [None] * len(raws)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        for low, width in ((0, 4), (4, 6), (6, 8), (8, 11), (11, 16), (16, 32)):
            own = np.flatnonzero((sizes > low) & (sizes <= width))
            if not len(own):
                continue
            letters = np.frombuffer(b"".join(raws[k].ljust(width, b"\0") for k in own), np.uint8).reshape(len(own), width).astype(np.uint64)
            within = np.arange(1, width + 1)[None, :] <= sizes[own][:, None]
            tokens, packed, slow = {}, np.zeros_like(letters), np.zeros(len(own), bool)
            for n in range(1, min(8, width) + 1):
                packed[:, n - 1 :] = (packed[:, n - 2 : -1] if n > 1 else 0) << np.uint64(8) | letters[:, n - 1 :]
                keys, ids = self.short[n]
                at = np.minimum(np.searchsorted(keys, packed), len(keys) - 1)
                tokens[n] = np.where(keys[at] == packed, ids[at], -1)
            if width > 8:
                at = np.minimum(np.searchsorted(self.long_ends, packed), len(self.long_ends) - 1)
                slow = ((self.long_ends[at] == packed) & within)[:, 8:].any(axis=1)
            counts, last = np.zeros((len(own), width + 1), np.int32), np.full((len(own), width + 1), -1, np.int64)
            for end in range(1, width + 1):
                open_ = np.flatnonzero(within[:, end - 1] & ~slow)
                for n in range(1, min(8, end) + 1):
                    token = tokens[n][open_, end - 1]
                    here = np.flatnonzero(token >= 0)
                    rows = open_[here]
                    fits = self._follows(last[rows, end - n], token[here])
                    rows = rows[fits]
                    counts[rows, end], last[rows, end] = counts[rows, end - n] + 1, token[here][fits]
                    open_ = np.delete(open_, here[fits])
                slow[open_] = True
            for j, k in enumerate(own):
                if not slow[j]:
                    out[k] = counts[j, : sizes[k] + 1]
        return [self.byte_prefixes(raws[k]) if x is None else x for k, x in enumerate(out)]

    def learn(self, pieces: list[str]) -> None:
        """Make known the token counts after each character of pieces of the pre-tokenizer."""
        raws = [p.encode() for p in pieces]
        for piece, raw, counts in zip(pieces, raws, self.many_byte_prefixes(raws), strict=True):
            counts = counts[1:] if len(raw) == len(piece) else counts[np.cumsum([len(c.encode()) for c in piece])]
            if piece in ("'re", "'ve", "'ll"):  # cut after one letter these are no contraction but two pieces
                counts = np.array([1, 2, counts[2]], np.int32)
            self.pieces[piece] = counts
            self.held += len(piece)

    def forget(self) -> None:
        """Drop the known pieces where there are too many, or too long ones."""
        if len(self.pieces) > CACHED_CHUNKS or self.held > CACHED_VALUES:
            self.pieces.clear()
            self.held = 0

    def piece_prefixes(self, piece: str) -> np.ndarray:
        if piece not in self.pieces:
            self.learn([piece])
        return self.pieces[piece]

    def piece_count(self, piece: str) -> int:
        """Tokens of a piece."""
        return int(self.pieces[piece][-1]) if piece in self.pieces else len(self.ranked._core_bpe.encode_single_piece(piece.encode()))

    def pretokenize(self, text: str) -> list[str]:
        if not text or max(text) < PLAIN_SCRIPTS:
            if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
                return [text]
            return self.split(text)
        return [text[begin:end] for _, (begin, end) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def plain_prefixes(self, text: str, pieces: list[str] | None = None) -> np.ndarray:
        """Token counts after each character of a text without special tokens."""
        pieces = self.pretokenize(text) if pieces is None else pieces
        if len(pieces) == 1:
            return self.piece_prefixes(pieces[0])
        out, base, at, blank = [], 0, 0, None
        for piece in pieces:
            counts = self.piece_prefixes(piece)
            total = int(counts[-1])
            if base:
                counts = counts + np.int32(base)
            if blank is not None and piece[0].isspace():  # a prefix that ends here has one run of white space
                counts = counts.copy()
                counts[0] = blank[1] + int(self.piece_prefixes(text[blank[0] : at + 1])[-1])
            blank = (at, base) if piece.isspace() else None
            out.append(counts)
            base, at = base + total, at + len(piece)
        return np.concatenate(out)

    def text_prefixes(self, text: str) -> np.ndarray:
        """Token counts after each character of any text."""
        self.forget()
        parts = re.split(f"({'|'.join(map(re.escape, self.special))})", text) if self.special else [text]
        out, base = [], 0
        for k, part in enumerate(parts):
            if k % 2:
                before = parts[k - 1]
                tail = self.pretokenize(before)[-1] if before else ""
                kept = base - (int(self.piece_prefixes(tail)[-1]) if tail else 0)
                inside = [kept + int(self.plain_prefixes(tail + part[:n])[-1]) for n in range(1, len(part))]
                base += 1
                out.append(np.array([*inside, base], np.int32))
            elif part:
                out.append(self.plain_prefixes(part) + base)
                base = int(out[-1][-1])
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def chunk_prefixes(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.forget()
        pieces = [self.pretokenize(c) if c else [] for c in chunks]
        self.learn([p for p in {p for own in pieces for p in own} if p not in self.pieces])
        parts = [self.plain_prefixes(c, own) if c else np.zeros(0, np.int32) for c, own in zip(chunks, pieces, strict=True)]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


def _byte_letters() -> dict[int, str]:
    """The printable letter for each byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return table


_models: dict[str, BytePairs] = {}
_stores: dict[tuple[str, str], Gathered] = {}


def byte_pairs(name: str = VOCABULARY) -> BytePairs:
    if name not in _models:
        _models[name] = BytePairs(name)
    return _models[name]


def _store(name: str, kind: str) -> Gathered:
    model = byte_pairs(name)
    if (name, kind) not in _stores:
        _stores[name, kind] = Gathered(model.ids, np.uint32) if kind == "ids" else Gathered(model.chunk_prefixes, np.int32)
    store = _stores[name, kind]
    if store.first.total[0] > CACHED_CHUNKS or len(store.flat) > CACHED_VALUES:
        store.clear()
    return store


def _even(text: str, model: BytePairs) -> bool:
    if text[0] == " " or text[-1] == " " or any(s in text for s in model.special):
        return False
    return not any(x in text for x in (_UNEVEN_ASCII if text.isascii() else _UNEVEN))


def batch_ids(texts: list[str], name: str = VOCABULARY) -> list[np.ndarray]:
    """The ids of each text, as the library gives them."""
    model, store = byte_pairs(name), _store(name, "ids")
    even = [k for k, t in enumerate(texts) if t and _even(t, model)]
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    chunks = [store.numbers(texts[k]) for k in even]
    store.settle()
    if chunks:
        flat, lengths = store.gather(np.concatenate([np.array(c, np.int64) for c in chunks]))
        firsts = np.cumsum([0, *map(len, chunks)])
        ends = np.concatenate([[0], np.cumsum(lengths)])[firsts]
        for j, k in enumerate(even):
            out[k] = flat[ends[j] : ends[j + 1]]
    odd = sorted(set(range(len(texts))) - set(even))
    for k, ids in zip(odd, model.library_ids([texts[k] for k in odd]), strict=True):
        out[k] = ids
    return out


def batch_prefixes(texts: list[str], name: str = VOCABULARY) -> list[np.ndarray]:
    """For each text, the token count of its prefix after each character."""
    model, store = byte_pairs(name), _store(name, "prefixes")
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
    even = [k for k, t in enumerate(texts) if t and _even(t, model)]
    chunks = [np.array(store.numbers(texts[k]), np.int64) for k in even]
    store.settle()
    if chunks:
        joined = np.concatenate(chunks)
        flat, lengths = store.gather(joined)
        ends = np.cumsum(lengths)
        last = np.where(lengths > 0, flat[np.maximum(ends - 1, 0)], 0).astype(np.int64)
        before = np.cumsum(last) - last
        firsts = np.cumsum([0, *map(len, chunks)])
        before -= np.repeat(before[firsts[:-1]], np.diff(firsts))
        flat = flat + np.repeat(before, lengths).astype(np.int32)
        bounds = np.concatenate([[0], ends])[firsts]
        for j, k in enumerate(even):
            counts = flat[bounds[j] : bounds[j + 1]]
            text = texts[k]
            for m in _AFTER_BLANK.finditer(text):  # white space before a cut space: one run where a prefix ends there
                first = m.start()
                while first and text[first - 1].isspace():
                    first -= 1
                kept = int(counts[first - 1]) if first else 0
                counts[m.start()] = kept + model.piece_count(text[first : m.end()])
            out[k] = counts
    for k in set(range(len(texts))) - set(even):
        if texts[k]:
            out[k] = model.text_prefixes(texts[k])
    return out


def pack_counts(counts: np.ndarray) -> bytes:
    """A prefix table: steps from each prefix's count to the next, as bytes, with an escape for wide ones."""
    steps = np.diff(counts, prepend=0)
    wide = (steps < -127) | (steps > 127)
    body = np.where(wide, -128, steps).astype(np.int8).tobytes()
    return zlib.compress(len(counts).to_bytes(8, "little") + body + steps[wide].astype("<i4").tobytes(), 1)


def unpack_counts(table: bytes) -> np.ndarray:
    raw = zlib.decompress(table)
    n = int.from_bytes(raw[:8], "little")
    steps = np.frombuffer(raw, np.int8, n, 8).astype(np.int32)
    steps[steps == -128] = np.frombuffer(raw, "<i4", -1, 8 + n)
    return np.cumsum(steps, dtype=np.int32)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that encodes to at most ``budget`` tokens."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, keep_table: bool = True, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_chars (longest prefix within the limit) and, if kept, the prefix table."""
    small_batches(docs.sparkSession)
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.simpleString()[7:-1].replace(":", " ", 1)
    schema += ", n_bytes long, n_tokens long, over_limit boolean, limit_chars long" + ", prefix_table binary" * keep_table

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in pieces_of_batch(batch):
                tables = batch_prefixes(list(part["text"]), vocabulary)
                n = np.array([int(c[-1]) if len(c) else 0 for c in tables], np.int64)
                out = pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "n_bytes": part["n_bytes"].to_numpy(), "n_tokens": n, "over_limit": n > limit})
                out["limit_chars"] = [longest_prefix(c, limit) for c in tables]
                if keep_table:
                    out["prefix_table"] = [pack_counts(c) for c in tables]
                yield out

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInPandas(count, schema)


def pieces_of_batch(batch: pd.DataFrame, text: str = "text", chars: int = 1_000_000) -> Iterator[pd.DataFrame]:
    """Runs of rows with a bounded number of characters, a longer row alone."""
    if len(batch):
        group = (batch[text].str.len().cumsum() // chars).to_numpy()
        for g in np.unique(group):
            yield batch[group == g]


def op10_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the table of all prefixes' counts of every document."""
    return prefix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_prefix_counts": op10_prefix_counts}
ORACLES: dict[str, str] = {}
