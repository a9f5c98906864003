"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants. Every word (the end token too) has a context restaurant for the words that follow it, however rare it is; a
word not seen in training has an empty one. Their common parent is the root restaurant, whose base is uniform over the V
training words and one unknown word. A context restaurant's tables are the root's customers.

Seating. Synchronous blocked Gibbs sweeps: in each sweep the customers of every (word, context) type are seated anew,
one after the other, given the table totals and root probabilities of the sweep before; then the tables of the root
likewise. Beyond EXACT customers of a type, seats are drawn in doubling blocks (new tables Poisson with the block's
summed probability). After BURN sweeps, SAMPLES sweeps give predictive probabilities, which are averaged.

Distribution. Words of at least one token in CONTEXTS (at most CONTEXTS of them, plus the end token) are frequent: their
totals, as contexts and in the root, go through the driver between sweeps. Types (a word after a context) are dealt to
buckets: those of a rare word by the word's hash, so that a bucket knows all counts of its rare words; those of a frequent
word by the hash of a rare context, or by both where both are frequent. A rare context is owned by the bucket of its hash:
buckets send the owner the tables of their types in it, and the owner answers with its total, in each sweep. Types of count
one always have one table, so sweeps carry the others only, and the seating goes from job to job.

Documents are read three times: for the counts of words, for those of types, and for all occurrences, which meet the last
seating of their bucket and give sums per document.

All counts cover all training documents. Words are compared by 64-bit hash.

Defined cases: null text = empty text, which has the end token only; repeated rows are documents of their own; a null
doc_id is a training document; without training documents both scores are 0; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_slices, keep, partitions

CONTEXTS = 1 << 15  # bounds what goes through the driver, not the restaurants
SPREAD = 64
BURN = 2
SAMPLES = 3
EXACT = 64
STRENGTH = 1.0
SEED = 42
HELD_OUT = (7, 2)
SCALE = float(1 << 24)
CHUNK_TOKENS = 2_000_000
CHUNK_DOCS = 60_000
END = np.uint64(xxhash.xxh64_intdigest(b" "))  # no word holds a space


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % HELD_OUT[0] == HELD_OUT[1]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts, in order, and the number of tokens of each text."""
    flat = pc.fill_null(texts.cast(pa.large_binary()), b"")
    edges = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = edges[:-1][edges[:-1] < len(data)]
    first[begins] = solid[begins]
    owner = np.searchsorted(edges, np.flatnonzero(first), side="right") - 1
    word_of = np.cumsum(first)[solid] - 1
    offsets = np.r_[0, np.cumsum(np.bincount(word_of, minlength=len(owner)))].astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[solid]])]).dictionary_encode()
    names = words.dictionary.to_pylist()
    h64 = xxhash.xxh64_intdigest
    table = np.append(np.fromiter((h64(w) for w in names), dtype=np.uint64, count=len(names)), END)
    count = np.bincount(owner, minlength=len(flat))
    out = np.full(len(owner) + len(flat), len(names), dtype=np.int64)
    body = np.ones(len(out), dtype=bool)
    body[np.cumsum(count + 1) - 1] = False
    out[body] = words.indices.to_numpy(zero_copy_only=False)
    return table[out], count + 1


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *[len(a) for a in arrays]], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * (1 + len(kinds)), []
    for n, kind in zip(np.frombuffer(raw, dtype=np.int64, count=len(kinds), offset=8).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        at += n * np.dtype(kind).itemsize
    return out


def _thin(v: np.ndarray) -> np.ndarray:
    """Counts or indices below 2**32 as byte planes, whose upper ones pack to nothing."""
    return v.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel()


def _thick(planes: np.ndarray) -> np.ndarray:
    return planes.reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)


def _rising(v: np.ndarray) -> np.ndarray:
    """Sorted 64-bit numbers as byte planes of their steps."""
    return np.diff(v, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.ravel()


def _risen(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def _sparse(v: np.ndarray) -> bytes:
    at = np.flatnonzero(v)
    return _pack(at, v[at].astype(np.float64))


ROWS = "bucket long, tag long, src long, payload binary"
COLUMNS = ("bucket", "tag", "src", "payload")
TYPES, OCCURRENCES, DOCUMENTS, COUNTS, ACTIVE, TOTALS, ASK, OWN, ASKED_ALL, ASKED_SEATING, TABLES, RARE = range(12)
SUMS, STATE = 100, 200  #: and the number of the sweep


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    b, tag, src, p = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(tag, pa.int64()), pa.array(src, pa.int64()), pa.array(p, pa.binary())], names=list(COLUMNS))


def _fixed(v: np.ndarray) -> np.ndarray:
    """v in units of 2**-24 as byte planes of 64-bit integers: sums stay exact and the upper planes pack to nothing."""
    return np.rint(v * SCALE).astype(np.int64).view(np.uint8).reshape(-1, 8).T.ravel()


def _floats(planes: np.ndarray) -> np.ndarray:
    return planes.reshape(8, -1).T.copy().view(np.int64).ravel() / SCALE


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_ids, tokens of each, token hashes, training flags) of a bounded number of documents at a time."""
    ids, counts, hashes, size = [], [], [], 0
    for b in batches:
        for part in byte_slices(b, "text"):
            for start in range(0, part.num_rows, CHUNK_DOCS):
                p = part.slice(start, CHUNK_DOCS)
                if ids and len(ids) + p.num_rows > CHUNK_DOCS:
                    yield ids, np.concatenate(counts), np.concatenate(hashes), np.array([not is_held_out(i) for i in ids])
                    ids, counts, hashes, size = [], [], [], 0
                h, n = tokens(p["text"])
                ids += p["doc_id"].to_pylist()
                counts.append(n)
                hashes.append(h)
                size += len(h)
                if size >= CHUNK_TOKENS:
                    yield ids, np.concatenate(counts), np.concatenate(hashes), np.array([not is_held_out(i) for i in ids])
                    ids, counts, hashes, size = [], [], [], 0
    if ids:
        yield ids, np.concatenate(counts), np.concatenate(hashes), np.array([not is_held_out(i) for i in ids])


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of values of each."""
    if not len(keys):
        return keys, values.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    k, v = keys[order], values[order].astype(np.int64)
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[start], np.add.reduceat(v, start)


class Words:
    """What the first pass tells: N, V, the root's discount, sorted hashes of the frequent context words, and of the words
    whose types are spread, with their training counts; and whether rarer contexts have restaurants of their own."""

    def __init__(self, n: int, v: int, d0: float, contexts: np.ndarray, spread: np.ndarray, spread_counts: np.ndarray, whole: bool):
        self.n, self.v, self.d0, self.contexts, self.spread, self.spread_counts, self.whole = n, v, d0, contexts, spread, spread_counts, whole
        self.k = len(contexts) + 1  #: indices below are frequent contexts and the shared one; those from k on, rarer ones


def word_totals(docs: DataFrame, buckets: int, contexts: int = CONTEXTS, spread: int = SPREAD, whole: bool = True) -> Words:
    """The words of at least one token in `contexts` are listed at the driver; no other word is dropped: see Distribution."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, n, h, train in _chunks(batches):
            w, c = np.unique(h[np.repeat(train, n)], return_counts=True)
            b = (w % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            w, c, cuts = w[order], c[order], np.searchsorted(b[order], np.arange(buckets + 1))
            rows = [(i, _pack(w[s:e], c[s:e].astype(np.int32))) for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if e > s]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])

    def merge(t: pa.Table) -> pa.Table:
        got = [_unpack(p.as_py(), np.uint64, np.int32) for p in t["payload"]]
        w, c = _sums(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
        top = np.lexsort((w, -c))[:contexts]  # no more words than that can hold one token in `contexts` each
        return pa.table({"n": [int(c.sum())], "v": [len(w)], "n1": [int((c == 1).sum())], "n2": [int((c == 2).sum())], "words": [w[top].view(np.int64).tolist()], "counts": [c[top].tolist()]})

    made = keep(docs.mapInArrow(count, "bucket long, payload binary").groupBy("bucket").applyInArrow(merge, "n long, v long, n1 long, n2 long, words array<long>, counts array<long>"))
    n, v, n1, n2 = made.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "n1", "n2")]).first()
    end = int(END.astype(np.int64))
    often = made.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts").where((F.col("counts") * contexts >= n) | (F.col("words") == end)).collect()
    hashes, counts = np.array([r[0] for r in often], dtype=np.int64).view(np.uint64), np.array([r[1] for r in often], dtype=np.int64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    wide = counts * spread >= max(1, n)
    held = hashes if END in hashes else np.sort(np.append(hashes, END))
    return Words(n, v, discount(n1, n2), held, hashes[wide], counts[wide], whole)


def discount(n1: int, n2: int) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def _places(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted value in a sorted array, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def _deal(docs: DataFrame, known: Words, buckets: int, scoring: bool) -> DataFrame:
    """(bucket, tag, src, payload): the types of each chunk that fall into each bucket, with their training counts (tag
    TYPES, src the chunk) or with all their occurrences (OCCURRENCES); then also the documents of each chunk (DOCUMENTS, in
    buckets from `buckets` on)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for number, (ids, n, h, train) in enumerate(_chunks(batches)):
            chunk = (part << 24) + number
            words, index = np.unique(h, return_inverse=True)
            del h
            names = words
            at, ok = _places(known.contexts, words)
            mine = np.where(ok, at, known.k + np.arange(len(words)) if known.whole else known.k - 1)[index]
            ctx = np.r_[0, mine[:-1]]  # the token before, the end token at the start of a document
            ctx[np.r_[0, np.cumsum(n)[:-1]]] = np.flatnonzero(known.contexts == END)[0]
            del mine
            bucket = (words % np.uint64(buckets)).astype(np.int64)
            at, wide = _places(known.spread, words)
            token = np.flatnonzero(wide[index])
            if len(token):  # a spread word is one word per bucket that its contexts fall into
                place, c = at[index[token]], ctx[token]
                pair = (c + known.k * place if known.whole else c).astype(np.uint64)
                sub = ((pair * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                rare = c >= known.k
                sub[rare] = bucket[c[rare] - known.k]
                key = place * buckets + sub
                there = np.zeros(len(known.spread) * buckets, dtype=bool)
                there[key] = True
                index[token] = len(words) + np.cumsum(there, dtype=np.int32)[key] - 1
                key = np.flatnonzero(there)
                words, bucket = np.append(words, known.spread[key // buckets]), np.append(bucket, key % buckets)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(words), dtype=np.int64)
            rank[order] = np.arange(len(words))
            words, bucket = words[order], bucket[order]
            bits, docs_bits = (known.k + len(names)).bit_length(), len(n).bit_length()
            kind, doc = rank[index] << bits | ctx, np.repeat(np.arange(len(n), dtype=np.int64), n)
            del index, ctx
            if len(words).bit_length() + bits + docs_bits < 64:
                every = kind << docs_bits | doc
                every.sort()
                kind, doc = every >> docs_bits, (every & ((1 << docs_bits) - 1)).astype(np.uint16)
                del every
            else:  # documents of very many words
                order = np.argsort(kind, kind="stable")
                kind, doc = kind[order], doc[order].astype(np.uint16)
            start = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
            kind = kind[start]
            end = np.r_[start[1:], len(doc)]
            if not scoring:
                seen = np.r_[0, np.cumsum(train[doc])]
                occ = (seen[end] - seen[start]).astype(np.uint32)
            else:
                occ = (end - start).astype(np.uint32)
            word, ctx = kind >> bits, kind & ((1 << bits) - 1)
            per_word = np.bincount(word, minlength=len(words)).astype(np.uint32)
            w_cut = np.searchsorted(bucket, np.arange(buckets + 1))
            t_cut = np.r_[0, np.cumsum(per_word)][w_cut]
            o_cut = np.r_[start, len(doc)][t_cut]
            rows = []
            if scoring:
                rows.append((buckets + chunk % buckets, DOCUMENTS, chunk, _pack(np.array([i or 0 for i in ids], dtype=np.int64), np.array([i is None for i in ids]).astype(np.uint8), n.astype(np.int32))))
            for b in range(buckets):
                ws, we, ts, te = w_cut[b], w_cut[b + 1], t_cut[b], t_cut[b + 1]
                if te > ts:
                    some = per_word[ws:we] > 0
                    w, c = words[ws:we][some], ctx[ts:te]
                    rare = c >= known.k
                    listed, to = np.unique(np.append(w, names[c[rare] - known.k]), return_inverse=True)
                    c[rare] = known.k + to[len(w) :]
                    types = (_rising(listed), _thin(to[: len(w)]), _thin(per_word[ws:we][some]), _thin(c), _thin(occ[ts:te]))
                    rows.append((b, OCCURRENCES, chunk, _pack(*types, doc[o_cut[b] : o_cut[b + 1]])) if scoring else (b, TYPES, chunk, _pack(*types)))
            yield _rows(rows)

    return docs.mapInArrow(deal, ROWS)


def _types(payload: bytes, *more: type) -> tuple[np.ndarray, ...]:
    """names, words, types of each word, contexts, counts, and what else there is of a payload that _deal made."""
    names, word, per_word, ctx, occ, *rest = _unpack(payload, *[np.uint8] * 5, *more)
    names = _risen(names)
    return names, names[_thick(word)], _thick(per_word), _thick(ctx), _thick(occ), *rest


def occurrences(docs: DataFrame, known: Words, buckets: int) -> DataFrame:
    """The training counts of each bucket (COUNTS), what its seating needs (ACTIVE), its part of the totals (TOTALS, which
    end with the numbers of types of count one and two), and what it asks the owners of its rare contexts (ASK)."""

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        b, k = key[0].as_py(), known.k
        ws, cs, us, ns = [], [], [], []
        for p in t["payload"]:
            names, words, per_word, ctx, occ = _types(p.as_py())
            rare = ctx >= k
            ws.append(np.repeat(words, per_word))
            us.append(names[ctx[rare] - k])
            cs.append(ctx)
            ns.append(occ)
        rare, to = np.unique(np.concatenate(us), return_inverse=True)
        w, c, n = np.concatenate(ws), np.concatenate(cs), np.concatenate(ns)
        c[c >= k] = k + to
        w, c, n = w[n > 0], c[n > 0], n[n > 0]
        words, index = np.unique(w, return_inverse=True)
        kinds, n = _sums(index.astype(np.int64) << 32 | c, n)
        rows = [(b, COUNTS, 0, _pack(_rising(words), _rising(kinds.view(np.uint64)), _thin(n), _rising(rare)))]
        word, ctx, many = kinds >> 32, kinds & 0xFFFFFFFF, n > 1
        live = _live(word, many, len(words))
        place, wide = _places(known.spread, words)
        live |= wide
        size = k + len(rare)
        ones, customers = np.bincount(ctx[~many], minlength=size), np.bincount(ctx, weights=n, minlength=size)
        quiet = int((~live).sum())
        asked = np.zeros(size, dtype=bool)
        asked[ctx[many]] = True
        asked = np.flatnonzero(asked[k:])  # rare contexts of types that sweeps seat anew
        owner = (rare % np.uint64(buckets)).astype(np.int64)
        mine = ctx[many].copy()
        mine[mine >= k] = k + np.searchsorted(asked, mine[mine >= k] - k)
        singles = np.bincount(word[~many], minlength=len(words))[live]
        live_at = np.cumsum(live) - 1
        rows.append((b, ACTIVE, 0, _pack(_thin(singles), _thin(np.where(wide, place + 1, 0)[live]), _thin(live_at[word[many]]), _thin(mine), _thin(n[many]), _thin(owner[asked]))))
        first = Seating(singles, np.where(wide, place, -1)[live], live_at[word[many]], mine, n[many], owner[asked], b, known)
        totals = first.totals()
        totals[:k] += ones[:k]
        totals[-2:] += quiet
        rows.append((b, TOTALS, 0, _sparse(np.r_[totals, customers[:k], ones[:k], quiet, (n == 1).sum(), (n == 2).sum()])))
        sums = np.zeros(len(rare), dtype=np.int64)
        sums[asked] = first.sums()
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(buckets + 1))
        active = np.zeros(len(rare), dtype=np.uint8)
        active[asked] = 1
        for g in np.flatnonzero(np.diff(cut)).tolist():
            at = order[cut[g] : cut[g + 1]]
            rows.append((g, ASK, b, _pack(_rising(rare[at]), _thin(customers[k:][at]), _thin(ones[k:][at]), active[at], _thin(sums[at]))))
        return pa.Table.from_batches([_rows(rows)])

    return keep(_deal(docs, known, buckets, False).groupBy("bucket").applyInArrow(merge, ROWS), "tag")


def owners(asked: DataFrame) -> DataFrame:
    """Of the rare contexts that each bucket owns: customers and tables of types of count one (OWN), where the contexts that
    other buckets ask for are among them (ASKED_SEATING for sweeps, ASKED_ALL for scores), and the tables before the first
    sweep (TABLES)."""

    def own(key: tuple, t: pa.Table) -> pa.Table:
        g, got = key[0].as_py(), [(src, _unpack(p, *[np.uint8] * 5)) for src, p in zip(t["src"].to_pylist(), t["payload"].to_pylist(), strict=True)]
        all_, to = np.unique(np.concatenate([_risen(x[0]) for _, x in got]), return_inverse=True)
        add = lambda i: np.bincount(to, weights=np.concatenate([_thick(x[i]) for _, x in got]), minlength=len(all_)).astype(np.int64)
        customers, ones, tables = add(1), add(2), add(4)
        tables += ones
        rows, at = [(g, OWN, 0, _pack(_thin(customers), _thin(ones)))], 0
        for src, x in got:
            mine = to[at : at + len(x[3])]
            at += len(x[3])
            seats = mine[x[3] > 0]
            rows.append((g, ASKED_ALL, src, _pack(_rising(mine.astype(np.uint64)))))
            if len(seats):
                rows += [(g, ASKED_SEATING, src, _pack(_rising(seats.astype(np.uint64)))), (src, TABLES, g, _pack(_thin(tables[seats])))]
        return pa.Table.from_batches([_rows(rows)])

    return keep(asked.groupBy("bucket").applyInArrow(own, ROWS), "tag")


def _owned(t: pa.Table, samples: list[int]) -> tuple[np.ndarray, list[np.ndarray], dict, dict]:
    """Customers of an owner's contexts, their tables after each of the sweeps, and what buckets ask for."""
    customers = ones = None
    asked, seats, sums = {}, {}, []
    for tag, src, p in zip(t["tag"].to_pylist(), t["src"].to_pylist(), t["payload"].to_pylist(), strict=True):
        if tag == OWN:
            customers, ones = map(_thick, _unpack(p, np.uint8, np.uint8))
        elif tag == ASKED_ALL:
            asked[src] = _risen(_unpack(p, np.uint8)[0]).astype(np.int64)
        elif tag == ASKED_SEATING:
            seats[src] = _risen(_unpack(p, np.uint8)[0]).astype(np.int64)
        else:
            sums.append((tag - SUMS, src, p))
    tables = {i: ones.copy() for i in samples}
    for i, src, p in sums:
        tables[i][seats[src]] += _thick(_unpack(p, np.uint8)[0])
    return customers, [tables[i] for i in samples], asked, seats


def _answers(owned: DataFrame, sums: DataFrame, sweep: int) -> DataFrame:
    """The tables of the rare contexts after a sweep, for the buckets that seat types in them (TABLES)."""

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        _, (tables,), _, seats = _owned(t, [sweep])
        return pa.Table.from_batches([_rows([(src, TABLES, key[0].as_py(), _pack(_thin(tables[at]))) for src, at in seats.items()])])

    return owned.where(F.col("tag").isin(OWN, ASKED_SEATING)).select(*COLUMNS).union(sums).groupBy("bucket").applyInArrow(answer, ROWS)


def _last_answers(owned: DataFrame, sums: DataFrame) -> DataFrame:
    """Customers and averaged sweeps' tables of the rare contexts, for all buckets that score them (RARE)."""

    def answer(key: tuple, t: pa.Table) -> pa.Table:
        customers, tables, asked, _ = _owned(t, list(range(BURN, BURN + SAMPLES)))
        return pa.Table.from_batches([_rows([(src, RARE, key[0].as_py(), _pack(_thin(customers[at]), *[_thin(x[at]) for x in tables])) for src, at in asked.items()])])

    return owned.where(F.col("tag").isin(OWN, ASKED_SEATING, ASKED_ALL)).select(*COLUMNS).union(sums).groupBy("bucket").applyInArrow(answer, ROWS)


def _seat(c: np.ndarray, new: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each type after seating its c customers; `new` is its weight of opening a table."""
    t = np.minimum(c, 1)
    for k in range(2, EXACT + 1):
        live = np.flatnonzero(c >= k)
        if not len(live):
            return t
        a = new[live]
        t[live] += rng.random(len(live)) * (a + (k - 1) - d * t[live]) < a
    k = EXACT
    while len(live := np.flatnonzero(c > k)):
        a, to = new[live], np.minimum(c[live], 2 * k)
        base = a - d * t[live]
        t[live] += np.minimum(rng.poisson(a * np.log((base + to) / (base + k))), to - k)
        k *= 2
    return t


def _live(word: np.ndarray, many: np.ndarray, words: int) -> np.ndarray:
    """Which words may have more than one table: all but those with a single type of count one."""
    live = np.bincount(word, minlength=words) > 1
    live[word[many]] = True
    return live


class Seating:
    """Gibbs seating of the words of one bucket. A type of count one always has one table, so those are only counted
    (`singles`, per word); word, ctx and counts are of the others. Words left out have one customer and one root table."""

    def __init__(self, singles: np.ndarray, place: np.ndarray, word: np.ndarray, ctx: np.ndarray, counts: np.ndarray, owner: np.ndarray, bucket: int, known: Words):
        self.singles, self.place, self.word, self.ctx, self.counts, self.owner, self.bucket, self.known = singles, place, word, ctx, counts, owner, bucket, known
        self.wide = place >= 0
        self.tables = np.ones(len(word), dtype=np.int64)
        self.root = np.minimum(self.customers(), 1)

    def customers(self) -> np.ndarray:
        """Of the root, per word: the tables of its types in this bucket."""
        return self.singles + np.bincount(self.word, weights=self.tables, minlength=len(self.singles)).astype(np.int64)

    def root_probability(self, m: dict) -> np.ndarray:
        own = root_probability(m, self.customers(), self.root)
        own[self.wide] = root_probability(m, m["spread_customers"], m["spread_root"])[self.place[self.wide]]
        return own

    def sweep(self, m: dict, number: int, rare_tables: np.ndarray) -> None:
        rng = np.random.default_rng([SEED, self.bucket + 1, number])
        p0 = self.root_probability(m)
        new = (STRENGTH + m["d1"] * np.append(m["tables"], rare_tables)[self.ctx]) * p0[self.word]
        self.tables = _seat(self.counts, new, m["d1"], rng)
        self.root = _seat(self.customers(), np.full(len(self.singles), (STRENGTH + m["d0"] * m["root_tables"]) * m["base"]), m["d0"], rng)

    def totals(self) -> np.ndarray:
        """Tables per frequent context, customers of the spread words, the root's customers, and the root's tables but those
        of spread words."""
        k, customers = self.known.k, self.customers()
        spread = np.bincount(self.place[self.wide], weights=customers[self.wide], minlength=len(self.known.spread))
        return np.r_[np.bincount(self.ctx, weights=self.tables, minlength=k)[:k], spread, customers.sum(), self.root[~self.wide].sum()]

    def sums(self) -> np.ndarray:
        """Tables per rare context of these types."""
        return np.bincount(self.ctx, weights=self.tables, minlength=self.known.k + len(self.owner)).astype(np.int64)[self.known.k :]


def root_probability(m: dict, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return (customers - m["d0"] * tables + (STRENGTH + m["d0"] * m["root_tables"]) * m["base"]) / (STRENGTH + m["root_customers"])


def _state(totals: np.ndarray, known: Words, fixed: dict, before: dict | None, number: int) -> dict:
    """What a sweep needs to know of the seating of all buckets; seats the spread words' tables in the root."""
    k, s = known.k, len(known.spread)
    customers = totals[k : k + s].astype(np.int64)
    if before is None:
        root = np.minimum(customers, 1)
    else:
        weight = (STRENGTH + before["d0"] * before["root_tables"]) * before["base"]
        root = _seat(customers, np.full(s, weight), before["d0"], np.random.default_rng([SEED, 0, number]))
    return fixed | {"tables": totals[:k], "spread_customers": customers, "spread_root": root, "root_customers": totals[-2], "root_tables": totals[-1] + root.sum()}


def _total(table: DataFrame, size: int) -> np.ndarray:
    """The sum of all buckets' totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for b in batches:
            for p in b["payload"].to_pylist():
                at, x = _unpack(p, np.int64, np.float64)
                sums[at] += x
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["i", "x"])

    total = np.zeros(size)
    got = table.where(F.col("tag") == TOTALS).select("payload").mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    total[got["i"].to_numpy()] = got["x"].to_numpy()
    return total


def _sweep(known: Words, m: dict, number: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """One sweep of a bucket, from the totals m, the tables of its rare contexts and its seating before."""

    def sweep(key: tuple, t: pa.Table) -> pa.Table:
        b, rare, state = key[0].as_py(), {}, None
        for tag, src, p in zip(t["tag"].to_pylist(), t["src"].to_pylist(), t["payload"].to_pylist(), strict=True):
            if tag == ACTIVE:
                singles, place, word, ctx, counts, owner = map(_thick, _unpack(p, *[np.uint8] * 6))
            elif tag == TABLES:
                rare[src] = _thick(_unpack(p, np.uint8)[0])
            else:
                state = [_thick(x) for x in _unpack(p, np.uint8, np.uint8)]
        s = Seating(singles, place - 1, word, ctx, counts, owner, b, known)
        if state is not None:
            s.tables, s.root = state
        tables = np.zeros(len(owner), dtype=np.int64)
        by = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[by], np.arange(owner.max(initial=-1) + 2))
        asked = [(g, by[cut[g] : cut[g + 1]]) for g in np.flatnonzero(np.diff(cut)).tolist()]
        for g, at in asked:
            tables[at] = rare[g]
        s.sweep(m, number, tables)
        sums = s.sums()
        rows = [(b, STATE + number, 0, _pack(_thin(s.tables), _thin(s.root))), (b, TOTALS, 0, _sparse(s.totals()))]
        return pa.Table.from_batches([_rows(rows + [(g, SUMS + number, b, _pack(_thin(sums[at]))) for g, at in asked])])

    return sweep


def gibbs(table: DataFrame, owned: DataFrame, known: Words, fixed: dict, first: np.ndarray, ones: np.ndarray, quiet: int) -> tuple[list[dict], list[DataFrame]]:
    """The totals before each sweep and after the last, and the seating after each sweep (STATE, and for the owners of rare
    contexts SUMS). `first` are the totals before, `ones` and `quiet` what of them no sweep changes."""
    states, kept = [_state(first, known, fixed, None, 0)], []
    answers = owned.where(F.col("tag") == TABLES).select(*COLUMNS)
    active = table.where(F.col("tag") == ACTIVE).select(*COLUMNS)
    for number in range(BURN + SAMPLES):
        rows = active.union(answers)
        if kept:
            rows = rows.union(kept[-1].where(F.col("tag") == STATE + number - 1).select(*COLUMNS))
        kept.append(keep(rows.groupBy("bucket").applyInArrow(_sweep(known, states[-1], number), ROWS), "tag"))
        total = _total(kept[-1], len(first))
        total[: known.k] += ones
        total[-2:] += quiet
        states.append(_state(total, known, fixed, states[-1], number + 1))
        answers = _answers(owned, kept[-1].where(F.col("tag") == SUMS + number).select(*COLUMNS), number)
    return states, kept


class Predictive:
    """Averaged predictive probabilities of a bucket's types."""

    def __init__(self, counts: bytes, seatings: list[bytes], rare: dict, states: list[dict], customers: np.ndarray, known: Words, buckets: int):
        words, kinds, n, names = _unpack(counts, *[np.uint8] * 4)
        self.words, self.kinds, self.names, self.known, n = _risen(words), _risen(kinds).view(np.int64), _risen(names), known, _thick(n)
        word, ctx, many = self.kinds >> 32, self.kinds & 0xFFFFFFFF, n > 1
        place, wide = _places(known.spread, self.words)
        live = _live(word, many, len(self.words)) | wide
        self.count = np.bincount(word, weights=n, minlength=len(self.words))
        told = np.zeros((1 + SAMPLES, len(self.names)))
        owner = (self.names % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(buckets + 1))
        for g, p in rare.items():
            told[:, order[cut[g] : cut[g + 1]]] = [_thick(x) for x in _unpack(p, *[np.uint8] * (1 + SAMPLES))]
        customers = np.append(customers, told[0])
        self.root, self.own, self.lower, self.after = [], [], [], states[BURN + 1 :]
        for m, seating, rare_tables in zip(self.after, seatings, told[1:], strict=True):
            tables, root = np.ones(len(n), dtype=np.int64), np.ones(len(self.words), dtype=np.int64)
            tables[many], root[live] = [_thick(x) for x in _unpack(seating, np.uint8, np.uint8)]
            p0 = root_probability(m, np.bincount(word, weights=tables, minlength=len(self.words)), root)
            p0[wide] = root_probability(m, m["spread_customers"], m["spread_root"])[place[wide]]
            self.root.append(p0)
            self.own.append((n - m["d1"] * tables) / (STRENGTH + customers[ctx]))
            self.lower.append((STRENGTH + m["d1"] * np.append(m["tables"], rare_tables)) / (STRENGTH + customers))

    def look_up(self, names: np.ndarray, words: np.ndarray, per_word: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each type (words repeated per_word times, with ctx, rare ones by name) and training count of its
        word."""
        rare = ctx >= self.known.k
        ctx[rare] = self.known.k + np.searchsorted(self.names, names[ctx[rare] - self.known.k])
        count, owner = np.zeros(len(words)), np.repeat(np.arange(len(words)), per_word)
        at, ok = _places(self.words, words)
        wat, wide = _places(self.known.spread, words)
        count[ok] = self.count[at[ok]]
        count[wide] = self.known.spread_counts[wat[wide]]
        kat, kok = _places(self.kinds, (at[owner] << 32) | ctx)
        kok &= ok[owner]
        total = np.zeros(len(ctx))
        for n, root, own, lower in zip(self.after, self.root, self.own, self.lower, strict=True):
            p0 = np.full(len(words), root_probability(n, np.zeros(1), np.zeros(1))[0])
            p0[ok] = root[at[ok]]
            p0[wide] = root_probability(n, n["spread_customers"], n["spread_root"])[wat[wide]]
            p = lower[ctx] * p0[owner]
            p[kok] += own[kat[kok]]
            total += p
        return total / len(self.after), count


def _score(docs: DataFrame, table: DataFrame, owned: DataFrame, kept: list[DataFrame], known: Words, states: list[dict], fixed: dict, customers: np.ndarray, buckets: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score)."""
    shared = docs.sparkSession.sparkContext.broadcast((known, states, customers))  # at most 2 * CONTEXTS numbers a state
    denominator = math.log10(fixed["n"] + fixed["v"] + 1)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bucket, (known, states, customers) = key[0].as_py(), shared.value
        if bucket >= buckets:
            return t.select(["src", "bucket", "payload"]).rename_columns(["chunk", "bucket", "payload"])
        counts, seatings, rare, rows = None, {}, {}, []
        tags, src = t["tag"].to_pylist(), t["src"].to_pylist()
        for i, tag in enumerate(tags):
            if tag == COUNTS:
                counts = t["payload"][i].as_py()
            elif tag == RARE:
                rare[src[i]] = t["payload"][i].as_py()
            elif tag >= STATE:
                seatings[tag - STATE] = t["payload"][i].as_py()
        model = Predictive(counts, [seatings[i] for i in sorted(seatings)], rare, states, customers, known, buckets)
        for i, tag in enumerate(tags):
            if tag == OCCURRENCES:
                names, words, per_word, ctx, occ, doc = _types(t["payload"][i].as_py(), np.uint16)
                probability, count = model.look_up(names, words, per_word, ctx)
                base = np.repeat(np.log10(count + 1) - denominator, per_word)
                seen = np.repeat(count > 0, per_word)
                present, index = np.unique(doc, return_inverse=True)
                add = lambda v: np.bincount(index, weights=np.repeat(v, occ), minlength=len(present))  # noqa: B023, E731
                rows.append((src[i], bucket, _pack(present, _fixed(-add(np.log10(probability))), _fixed(-add(base)), add(seen).astype(np.uint32))))
        c, b, p = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"chunk": pa.array(c, pa.int64()), "bucket": pa.array(b, pa.int64()), "payload": pa.array(p, pa.binary())})

    def add_up(t: pa.Table) -> pa.Table:
        t = t.sort_by("bucket")
        ids = missing = n = None
        parts = []
        for bucket, p in zip(t["bucket"].to_pylist(), t["payload"].to_pylist(), strict=True):
            if bucket >= buckets:
                ids, missing, n = _unpack(p, np.int64, np.uint8, np.int32)
            else:
                parts.append(_unpack(p, np.uint16, np.uint8, np.uint8, np.uint32))
        score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), dtype=np.int64)
        for d, s, q, k in parts:
            score[d] -= _floats(s)
            base[d] -= _floats(q)
            known[d] += k
        doc_ids = [None if m else i for i, m in zip(ids.tolist(), missing.tolist(), strict=True)]
        return pa.table(
            {"doc_id": pa.array(doc_ids, pa.int64()), "held_out": [is_held_out(i) for i in doc_ids], "n_tokens": n.astype(np.int64), "n_known": known, "base_score": base, "score": score}
        )

    last = range(BURN, BURN + SAMPLES)
    pick = lambda i, tag: kept[i].where(F.col("tag") == tag + i).select(*COLUMNS)
    asked = pick(BURN, SUMS)
    rows = _deal(docs, known, buckets, True).union(table.where(F.col("tag") == COUNTS).select(*COLUMNS)).union(pick(BURN, STATE))
    for i in last[1:]:
        asked, rows = asked.union(pick(i, SUMS)), rows.union(pick(i, STATE))
    if known.whole:
        rows = rows.union(_last_answers(owned, asked))
    sums = rows.groupBy("bucket").applyInArrow(run, "chunk long, bucket long, payload binary")
    return sums.groupBy("chunk").applyInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, contexts: int | None = None, spread: int = SPREAD, driver: int = CONTEXTS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Every word has a context restaurant; totals of words of at least one token in `driver` go through the driver. A number
    of `contexts` asks for a smaller model: contexts of less than one token in so many share one restaurant, and words of at
    least one token in `spread` are dealt by context.
    """
    buckets = partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = word_totals(docs, buckets, driver, driver) if contexts is None else word_totals(docs, buckets, contexts, spread, False)
    table = occurrences(docs, known, buckets)
    owned = owners(table.where(F.col("tag") == ASK).select(*COLUMNS))
    size = known.k + len(known.spread) + 2
    first, customers, ones, (quiet, n1, n2) = np.split(_total(table, size + 2 * known.k + 3), [size, size + known.k, size + 2 * known.k])
    fixed = {"n": known.n, "v": known.v, "base": 1 / (known.v + 1), "d0": known.d0, "d1": discount(int(n1), int(n2))}
    states, kept = gibbs(table, owned, known, fixed, first, ones, int(quiet))
    out = _score(docs, table, owned, kept, known, states, fixed, customers, buckets)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(known.n).cast("long").alias("train_tokens"), "base_score", "score")


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
