"""Byte-pair encoding as a streaming transducer, and decoding as a byte-to-text machine.

Merges happen in the order of the merge list. Whether a token may end at byte p therefore depends on the bytes after p
only through chains of ever earlier merges, and each link of a chain reaches as far as the right half of its merge. The
longest chain is the *lookahead* of the merge list: the tokens of a buffer that end at least that many bytes before its
end are those of every continuation. The encoder emits them and keeps the rest, so its memory does not follow the input.

Null text encodes to no tokens; empty text too. Decoding null gives null.
"""

from __future__ import annotations

import codecs
import functools
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse, islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.words import give_back, small_batches
from scoreloom.session import ship_package

# Fixed value: the split into pieces that byte-level vocabularies of this kind are made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same split by the faster built-in module, for texts without numerals other than digits and without rare scripts.
QUICK = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
BEYOND_QUICK = re.compile("[^\x00-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20b0]")
CHUNK_CHARS = 1 << 16
CHUNK_BYTES = 256  # what a run takes in at a time, beyond the lookahead
RUN_CHARS = 256  # a longer run of one kind of character goes through the transducer
CACHE_WORDS = 1 << 16
PART_BYTES = 1 << 20  # of texts (or ids) that are worked on at a time
BATCH_CHARS = 1 << 19  # new words of so much text are merged together
_EXACT = regex.compile(PATTERN)
_SPREAD = 0x9E3779B97F4A7C15
_U64 = (1 << 64) - 1
_NEVER = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file, by letter."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairs:
    """A byte-level vocabulary: ``vocab`` in letters, ``merges`` in order, ``special`` strings with their ids."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], special: dict[str, int] | None = None):
        letters = byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        self.special = dict(special or {})
        self.of_byte = {spell(t)[0]: i for t, i in vocab.items() if len(t) == 1}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = spell(token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.lookahead = self._lookahead()
        self._table = self._hashed()
        self._words: dict[str, bytes] = {}  # tokens as four bytes each
        self._cuts = _EXACT.finditer
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _cut(self, text: str) -> list[str]:
        return _EXACT.findall(text) if BEYOND_QUICK.search(text) else QUICK.findall(text)

    @classmethod
    def parse(cls, text: str) -> BytePairs:
        made = json.loads(text)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in made["model"]["merges"]]
        return cls(made["model"]["vocab"], pairs, {t["content"]: t["id"] for t in made.get("added_tokens", [])})

    def _lookahead(self) -> int:
        """Longest chain of merges: ``(u, v)`` at a place needs v, which an earlier merge of v's tail could take away."""
        spine: dict[int, tuple[int, ...]] = {}
        reach: dict[int, int] = {}
        for (a, b), (_, made) in self.merges.items():  # in order of rank
            tail = spine.setdefault(b, (b,))
            far = len(self.bytes[b]) + max(reach.get(t, 0) for t in tail)
            reach[a] = max(reach.get(a, 0), far)
            spine[made] = (*tail, made)
        return max(reach.values(), default=0)

    def _hashed(self, bits: int = 19) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]:
        """The merge list as a hash table of pairs: keys, ranks, and the token made by each rank."""
        while (1 << bits) < 4 * len(self.merges):
            bits += 1
        size, shift = 1 << bits, np.uint64(64 - bits)
        keys, ranks = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int64)
        made = np.zeros(max((r for r, _ in self.merges.values()), default=0) + 1, dtype=np.int64)
        for (a, b), (rank, token) in self.merges.items():
            at = (((a << 32 | b) * _SPREAD) & _U64) >> (64 - bits)
            while keys[at] >= 0:
                at = (at + 1) % size
            keys[at], ranks[at], made[rank] = a << 32 | b, rank, token
        return keys, ranks, made, shift

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair, or NEVER."""
        keys, ranks, _, shift = self._table
        pair = left << 32 | right
        at = ((pair.astype(np.uint64) * np.uint64(_SPREAD)) >> shift).astype(np.int64)
        out = np.full(len(pair), _NEVER)
        open_ = np.arange(len(pair))
        while len(open_):
            seen = keys[at[open_]]
            hit = seen == pair[open_]
            out[open_[hit]] = ranks[at[open_[hit]]]
            open_ = open_[(seen >= 0) & ~hit]
            at[open_] = (at[open_] + 1) % len(keys)
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Tokens of many short non-empty pieces at once: in each turn, every piece makes its earliest merge everywhere."""
        of_byte = np.zeros(256, dtype=np.int64)
        of_byte[list(self.of_byte)] = list(self.of_byte.values())
        made = self._table[2]
        token = of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            rank = np.full(len(token), _NEVER)
            inner = np.flatnonzero(piece[1:] == piece[:-1])
            rank[inner] = self._ranks(token[inner], token[inner + 1])
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            best = np.minimum.reduceat(rank, first)
            least = np.repeat(best, np.diff(np.r_[first, len(token)]))
            over = least == _NEVER
            if over.any():
                done.append((piece[over], token[over]))
            take = (rank == least) & ~over
            at = np.flatnonzero(take)
            if len(at):  # of overlapping places, as in aaa, every second one from the left
                run = np.maximum.accumulate(np.where(np.diff(at, prepend=at[0] - 2) > 1, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
                token[at] = made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            token, piece = token[keep], piece[keep]
        if not done:
            return []
        order = np.argsort(np.concatenate([p for p, _ in done]), kind="stable")
        flat = np.concatenate([t for _, t in done])[order].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(np.concatenate([p for p, _ in done]), minlength=len(pieces)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the tokens of short pieces into the cache, all new ones together."""
        fresh = [p for p in set(filterfalse(self._words.__contains__, pieces)) if len(p) <= RUN_CHARS]
        self._words.update(zip(fresh, self.merge_many([p.encode() for p in fresh])))

    def forget(self) -> None:
        """Drop the words that are cached; a worker may wait long for its next task."""
        self._words = {}

    def encode_many(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Tokens of many texts; those that fit into a batch share the merging of new words."""
        some: list[list[str] | str] = []
        size = 0
        for text in chain(texts, [None]):
            if text is None or size >= BATCH_CHARS:
                if len(self._words) >= CACHE_WORDS:  # what this batch has again is likely to come again
                    now = {p for x in some if not isinstance(x, str) for p in x}
                    self._words = {p: t for p, t in self._words.items() if p in now}
                self.learn(chain.from_iterable(x for x in some if not isinstance(x, str)))
                for x in some:
                    yield np.frombuffer(b"".join(self._blocks(x)) if isinstance(x, str) else self._joined(x), dtype="<i4")
                some, size = [], 0
            if text is not None:
                plain = len(text) <= CHUNK_CHARS and not (self._special and self._special.search(text))
                some.append(self._cut(text) if plain else text)
                size += len(text)

    def merge(self, piece: bytes) -> list[int]:
        """Tokens of a whole piece."""
        parts = [self.of_byte[b] for b in piece]
        merges = self.merges
        while len(parts) > 1:
            best = min((merges[p] for p in zip(parts, parts[1:]) if p in merges), default=None)
            if best is None:
                break
            out, i, n = [], 0, len(parts)
            while i < n:
                if i + 1 < n and merges.get((parts[i], parts[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one piece that arrives in chunks; at most lookahead + CHUNK_BYTES + one token are held."""
        held = b""
        limit = self.lookahead + max(map(len, self.bytes)) + CHUNK_BYTES
        for chunk in chunks:
            for at in range(0, len(chunk), CHUNK_BYTES):
                held += chunk[at : at + CHUNK_BYTES]
                if len(held) < limit:
                    continue
                end, stable = 0, len(held) - self.lookahead
                for token in self.merge(held):
                    if end + len(self.bytes[token]) > stable:
                        break
                    end += len(self.bytes[token])
                    yield token
                held = held[end:]
        yield from self.merge(held)

    def _tokens(self, pieces: list[str]) -> bytes:
        """Tokens of whole pieces, four bytes each; new short ones are merged together."""
        self.learn(pieces)
        return self._joined(pieces)

    def _joined(self, pieces: list[str]) -> bytes:
        known = self._words
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:  # a long run
            return b"".join(known[p] if p in known else np.fromiter(self.stream([p.encode()]), "<i4").tobytes() for p in pieces)

    def encode(self, text: str | Iterable[str]) -> Iterator[int]:
        """Tokens of a text, given whole or in chunks, as its pieces become certain. Special strings are looked for in
        texts given whole."""
        for block in self._blocks(text):
            yield from np.frombuffer(block, "<i4").tolist()

    def _blocks(self, text: str | Iterable[str]) -> Iterator[bytes]:
        if not isinstance(text, str):
            yield from self._chunks(text)
            return
        for i, part in enumerate(self._special.split(text) if self._special else [text]):
            if i % 2:
                yield np.array([self.special[part]], "<i4").tobytes()
            elif len(part) <= CHUNK_CHARS:
                yield self._tokens(self._cut(part))
            else:
                yield from self._chunks(part[i : i + CHUNK_CHARS] for i in range(0, len(part), CHUNK_CHARS))

    def _chunks(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Pieces of a text without special strings. A piece is certain three characters after its end (contractions
        look that far) and once another follows; a run longer than RUN_CHARS is streamed while it goes on."""
        source, held, more = iter(chunks), "", True
        while more:
            chunk = next(source, None)
            more = chunk is not None
            held += chunk or ""
            pieces = [m.span() for m in self._cuts(held)]
            keep = 0 if not more else max(1, sum(end > len(held) - 3 for _, end in pieces[-4:]))
            yield self._tokens([held[start:end] for start, end in pieces[: len(pieces) - keep]])
            held = held[pieces[-keep][0] :] if keep and pieces else ""
            if more and keep == 1 and len(held) > RUN_CHARS:
                rest: list[str] = []
                yield np.fromiter(self.stream(self._run(held, source, rest)), "<i4").tobytes()
                held = rest[0]

    @staticmethod
    def _run(held: str, source: Iterator[str], rest: list[str]) -> Iterator[bytes]:
        """Bytes of the run that ``held`` is, as long as chunks continue it; what follows it goes to ``rest``."""
        kind = next(k for k in (r"\p{L}", r"\p{N}", r"\s", r"[^\s\p{L}\p{N}]") if regex.match(k, held[-1]))
        again = regex.compile(f"{kind}*")
        back = 1 if kind == r"\s" else 0  # the last space of a run belongs to what follows
        for chunk in source:
            yield held[: len(held) - back].encode()
            held = held[len(held) - back :]
            end = again.match(chunk).end()
            if end < len(chunk):
                if back:
                    yield (held + chunk[:end])[:-1].encode()
                    rest.append((held + chunk[:end])[-1] + chunk[end:])
                else:
                    yield chunk[:end].encode()
                    rest.append(chunk[end:])
                return
            held += chunk
        yield held.encode()
        rest.append("")

    def decode(self, tokens: Iterable[int], block: int = 1 << 14) -> Iterator[str]:
        """Text of tokens, as soon as its bytes make whole characters."""
        machine, tokens = codecs.getincrementaldecoder("utf-8")("replace"), iter(tokens)
        while some := list(islice(tokens, block)):
            yield machine.decode(b"".join(map(self.bytes.__getitem__, some)))
        yield machine.decode(b"", True)


@functools.lru_cache(maxsize=1)
def parsed(text: str) -> BytePairs:
    """One vocabulary per Python worker."""
    return BytePairs.parse(text)


def _shipped(df: DataFrame, tokenizer: str):
    """The vocabulary file, read once here: a few megabytes, fixed by the vocabulary."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))


def _parts(batches, column: str) -> Iterator[pa.RecordBatch]:
    """Batches cut by bytes of one column, so that what a task holds besides a batch stays small."""
    for batch in batches:
        at, n = 0, batch.num_rows
        while at < n:
            step = max(1, min(n - at, n * PART_BYTES // max(1, batch.column(column).nbytes)))
            yield batch.slice(at, step)
            at += step


def _ids(pairs: BytePairs, batch: pa.RecordBatch, text: str) -> pa.ListArray:
    flat = list(pairs.encode_many(t.as_py() or "" for t in batch.column(text)))
    ends = np.cumsum([0, *map(len, flat)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*flat, np.zeros(0, np.int32)]), pa.int32()))


def _texts(pairs: BytePairs, ids: pa.ListArray) -> pa.Array:
    return pa.array([None if v.values is None else "".join(pairs.decode(v.values.to_numpy().tolist())) for v in ids], pa.string())


def _coded(df: DataFrame, tokenizer: str, column: str, make: dict[str, Callable], kinds: list[T.DataType]) -> DataFrame:
    shipped = _shipped(df, tokenizer)
    fields = [f for f in df.schema.fields if f.name not in make]

    def run(batches):
        pairs = parsed(shipped.value)
        for batch in _parts(batches, column):
            made: dict[str, pa.Array] = {}
            for name, call in make.items():
                made[name] = call(pairs, batch, made)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *made.values()], [*(f.name for f in fields), *made])
        pairs.forget()

    return df.mapInArrow(give_back(run), T.StructType([*fields, *(T.StructField(n, k) for n, k in zip(make, kinds))]))


_IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of every whole text as an array ``out`` (replaced if it exists); null and empty give an empty array."""
    return _coded(df, tokenizer, text, {out: lambda pairs, batch, _: _ids(pairs, batch, text)}, [_IDS])


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of the token ids as ``out`` (replaced if it exists); null gives null."""
    return _coded(df, tokenizer, ids, {out: lambda pairs, batch, _: _texts(pairs, batch.column(ids))}, [T.StringType()])


def encode_and_decode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Both in one pass over the rows: the ids, and the text that they decode to."""
    make = {ids: lambda pairs, batch, _: _ids(pairs, batch, text), out: lambda pairs, batch, made: _texts(pairs, made[ids])}
    return _coded(df, tokenizer, text, make, [_IDS, T.StringType()])


def digests(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of rows with ``ids`` and ``decoded``, beside the columns ``keep``."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return df.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *keep,
    )
