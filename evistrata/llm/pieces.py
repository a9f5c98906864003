"""SentencePiece (BPE) encoding and decoding by vectorised merge rounds.

No piece of the vocabulary continues past a word into a following space, so a text is a sequence of independent words
(each with the spaces before it) and every distinct word is encoded once per task. The words of a batch lie in one flat
numpy array of symbols. Each round looks up the rank of every adjacent pair, takes the minimum per word, merges that
pair's occurrences from left to right in all words at once, and compacts; words without a mergeable pair leave. Where a
merge could create a better-ranked pair (or ranks tie), only the leftmost occurrence is merged, which keeps the
result equal to merging one pair at a time. Characters outside the vocabulary become byte pieces.

Supports models with identity normalisation, a dummy prefix space, escaped white space and byte fallback.

Defined cases: null text = empty text = no ids; any other text starts with the dummy prefix; U+2581 is a space;
repeated rows each get a result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: Memory bounds only: words kept encoded per task (twice: those used lately), the longest word that is kept, bytes of
#: text taken at a time, and characters of new words merged at a time.
CACHE_WORDS = 100_000
CACHE_CHARS = 64
SLICE_BYTES = 1 << 20
MERGE_CHARS = 1 << 18
_WORD = re.compile(" *[^ ]+| +")
_NONE = np.int32(2**31 - 1)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Vocabulary:
    """Lookup tables built from a model file; a few MB, fixed by the model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = len(sp)
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        byte = [sp.is_byte(i) for i in range(n)]
        names = [sp.id_to_piece(i) for i in range(n)]
        self.surface = [bytes([int(p[3:5], 16)]) if byte[i] else b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for i in range(n):
            if byte[i]:
                self.byte_ids[self.surface[i][0]] = i
        normal = {p: i for i, p in enumerate(names) if not special[i] and not byte[i]}
        if any(a != SPACE and b == SPACE for p in normal for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("pieces that continue past a word into a space aren't supported")
        self.size = n
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p}):
            symbols.setdefault(c, len(symbols) + n)  # a character that is no piece may still be part of one
        self.chars = np.full(0x110000, -1, dtype=np.int32)
        for p, i in symbols.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self.char_of = {i: p for p, i in symbols.items() if i >= n}
        self.base = max(symbols.values(), default=0) + 1
        rank_of = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        rank = {i: rank_of[sp.get_score(i)] for i in normal.values()}
        left, right, into = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    into.append(i)
        keys = np.array(left, dtype=np.int64) * (1 << 32) + np.array(right, dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.into = keys[order], np.array(into, dtype=np.int32)[order]
        self.ranks = np.array([rank[i] for i in into], dtype=np.int32)[order]
        count = np.bincount([rank[i] for i in set(into)], minlength=len(rank_of))
        safe = {i: count[rank[i]] == 1 for i in set(into)}
        for a, b, i in zip(left, right, into, strict=True):
            for x in (a, b):
                if x in safe and rank[i] <= rank[x]:
                    safe[x] = False
        self.safe = np.zeros(len(rank_of), dtype=bool)
        for i, ok in safe.items():
            self.safe[rank[i]] = ok

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        want = a.astype(np.int64) * (1 << 32) + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        ok = self.keys[at] == want
        return np.where(ok, self.ranks[at], _NONE), self.into[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and each word's number of ids; spaces stand for the escaped space."""
        flat = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sym = self.chars[flat].astype(np.int64)
        sym = np.where(sym < 0, self.base + flat, sym)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, into = np.full(len(sym), _NONE), np.zeros(len(sym), dtype=np.int32)
        fresh = np.arange(len(sym) - 1)
        while len(sym):
            fresh = fresh[(fresh >= 0) & (fresh < len(sym) - 1)]
            same = word[fresh] == word[fresh + 1]
            rank[fresh[~same]] = _NONE
            fresh = fresh[same]
            rank[fresh], into[fresh] = self._pairs(sym[fresh], sym[fresh + 1])
            rank[-1] = _NONE
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            length = np.diff(np.r_[start, len(sym)])
            over = least == _NONE
            if over.any():
                out = np.repeat(over, length)
                done.append((word[out], sym[out]))
                keep = ~out
                sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
                least, length = least[~over], length[~over]
                if not len(sym):
                    break
                start = np.r_[0, np.cumsum(length)[:-1]]
            hit = np.flatnonzero(rank == np.repeat(least, length))
            of = np.repeat(np.arange(len(least)), length)[hit]
            first = np.r_[True, of[1:] != of[:-1]]
            run = np.r_[True, np.diff(hit) != 1] | first
            even = (np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0
            hit = hit[np.where(self.safe[least[of]], even, first)]
            sym[hit] = into[hit]
            stay = np.ones(len(sym), dtype=bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols stand after compaction
            sym, word, rank, into = sym[stay], word[stay], rank[stay], into[stay]
            fresh = np.unique(np.r_[at - 1, at])
        w = np.concatenate([x[0] for x in done]) if done else np.zeros(0, dtype=np.int64)
        s = np.concatenate([x[1] for x in done]) if done else np.zeros(0, dtype=np.int64)
        s, count = s[np.argsort(w, kind="stable")], np.bincount(w, minlength=len(words))
        odd = np.flatnonzero(s >= self.size)
        if len(odd):  # characters without a piece: their bytes instead
            raw = [self.byte_ids[list((self.char_of.get(i) or chr(i - self.base)).encode())] for i in s[odd].tolist()]
            extra = np.array([len(r) - 1 for r in raw])
            np.add.at(count, np.repeat(np.arange(len(words)), count)[odd], extra)
            width = np.ones(len(s), dtype=np.int64)
            width[odd] += extra
            s = np.repeat(s, width)
            s[np.repeat(np.isin(np.arange(len(width)), odd), width)] = np.concatenate(raw)
        return s, count

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.surface[i] for i in ids])[1:].decode("utf-8", "replace")


def split(text: str) -> list[str]:
    """The words of a text with its dummy prefix; each carries the spaces before it."""
    return _WORD.findall(" " + text.replace(SPACE, " ")) if text else []


def _bounded(words: Iterable[str]) -> Iterator[list[str]]:
    """The words, about MERGE_CHARS characters at a time."""
    held, size = [], 0
    for w in words:
        held.append(w)
        size += len(w)
        if size >= MERGE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _digests(values: pa.Array, skip: int = 0) -> pa.Array:
    """SHA-256 of each value without its first `skip` bytes."""
    return pa.array([hashlib.sha256(memoryview(v.as_buffer())[skip:] if v.as_buffer().size else b"").hexdigest() for v in values], pa.string())


def encode_documents(docs: DataFrame, vocabulary: Vocabulary | None = None, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids array<int>."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary or Vocabulary(default_model())))  # plain arrays: executors lack this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = Vocabulary.__new__(Vocabulary)
        vars(vocab).update(shared.value)
        names, surface = pa.array(map(str, range(vocab.size))), pa.array(vocab.surface, pa.binary())
        known: dict[str, bytes] = {}
        older: dict[str, bytes] = {}
        for batch in batches:
            for b in byte_slices(batch, "text", SLICE_BYTES):
                words = [split(t.as_py() or "") for t in b["text"]]
                if len(known) > CACHE_WORDS:
                    known, older = {}, known
                found, new = {}, []
                for w in set().union(*words):
                    held = known.get(w) or older.get(w)
                    if held is None:
                        new.append(w)
                    else:
                        found[w] = known[w] = held
                for some in _bounded(new):
                    flat, count = vocab.encode_words(some)
                    raw, begin = flat.astype(np.int32).tobytes(), 0
                    for w, end in zip(some, (4 * np.cumsum(count)).tolist(), strict=True):
                        found[w] = raw[begin:end]
                        begin = end
                    known.update((w, found[w]) for w in some if len(w) <= CACHE_CHARS)
                parts = [b"".join([found[w] for w in ws]) for ws in words]
                n = np.array([len(p) // 4 for p in parts], dtype=np.int64)
                ids = pa.array(np.frombuffer(b"".join(parts), dtype=np.int32))
                ends = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                joined = pc.binary_join(pa.ListArray.from_arrays(ends, names.take(ids)), ",")
                text = pc.binary_join(pa.ListArray.from_arrays(ends, surface.take(ids)), b"")
                cols = [b["doc_id"], pa.array(n), _digests(joined), _digests(text, 1)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(ends, ids))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
