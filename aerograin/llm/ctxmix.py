"""Language-model scoring by online logistic mixing of hashed-context bit predictors.

A text is coded as decisions and bits. For each token (word, or the end):

* Where the four words before it also stand in a training text of another place, that text's next word is predicted. Whether
  the token is that word is one bit; its predictor counts the document's own hits so far, by how long the last run of hits
  is. A hit leaves a choice among the words that share 16 bits of hash, by their counts.
* Else it is first known or new to the training texts. Known: it is among the document's own words (a cache that adapts with
  every token) or goes bit by bit along its 12-bit code, the top bits of its hash; then it is one of the words of its code,
  by their counts. Four predictors give each bit a probability from counts of the training texts: no context; the word
  before; the last short word, of at most four bytes; the last two of these (contexts are hashed to 10 bits).
* New: whether the document had this new word before (its share among them), else its bytes and an end mark bit by bit, from
  byte contexts of order 1 to 4 inside the word, hashed. The byte counts are of each
  document's distinct words, since a word that is new resembles rare ones.

Predictions are mixed in the logistic domain. The weights are gated by the place of the bit; they start from fixed values and
are refined online within each document, after every `STEP` tokens, by the gradient of the coding cost. A last stage, adapted
the same way, rescales and shifts the mixed log odds for each place of the bit. The escape's probability is refined likewise
by the document's own count of new words. A document's score so depends on its text and the training texts only, never on
other rows or on how rows are dealt. A word that belies its prediction is coded in full, so all texts together have a
probability of at most 1.

What is gathered grows with the corpus: word counts are summed in hash buckets, every chunk of texts sending each of its words
once and getting back what it needs; so are the continuations, one for each content-chosen place (one in 32) of a training
text: the words up to the next such place, 16 bits of hash each. The context tables are of a fixed size (22 million counts),
summed blockwise in two steps; so is what is broadcast (45 MB).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, ship, shuffle_partitions
from .arrays import U64 as _U
from .arrays import GRAM_KEY, Words, blocks, mix

CODE_BITS = 12
CONTEXT_BITS = 10
SHORT = 4
CHUNK = 1 << 20
STEP = 32
RATE = 0.01
LAST_RATE = 0.002
#: Starting weights: what each context adds to the prediction without context.
WORD_START = (0.5, 0.75, 0.85)
BYTE_START = (0.15, 0.25, 0.35, 0.45)
#: The cache speaks for a share of at most CACHE of the tokens, fully once the document has some CACHE_WORDS words.
CACHE, CACHE_WORDS = 0.12, 40.0
#: Continuations: words of context, bits of the hash that choose a place, and P(hit) by the length of the last run of hits.
BEFORE, PLACE_BITS = 4, 5
RUNS = (1, 2, 4, 8, 16)
HIT_START = np.array([0.35, 0.6, 0.75, 0.85, 0.93, 0.985])
HIT_STRENGTH = 4.0
SUMS = 32
PRIOR = 64.0
BACKING = 4.0
BLOCK = 1 << 16
SCALE = 2048.0

_CODES = 1 << CODE_BITS
_CONTEXTS = 1 << CONTEXT_BITS
END = np.uint64(0x0DDB1A5E5BAD5EED)
#: Leaves of each table: contexts x symbols.
TABLES = {"none": (1, _CODES), "before": (_CONTEXTS, _CODES), "short": (_CONTEXTS, _CODES), "shorts": (_CONTEXTS, _CODES), "byte1": (256, 256), "byte2": (4096, 256), "byte3": (16384, 256), "byte4": (16384, 256), "tail": (1, 65536)}
WORD_TABLES, BYTE_TABLES = ("none", "before", "short", "shorts"), ("byte1", "byte2", "byte3", "byte4")

CODED = "kind string, chunk bigint, docs binary, lengths binary, held binary, sizes binary, codes binary, words binary, short binary, new_ids binary, new_ends binary, new_bytes binary, n_train bigint, bucket int, hashes binary, counts binary, offer_keys binary, offer_sums binary, offer_times binary, offer_ends binary, offer_words binary, ask_keys binary, name string, block int, low binary, high binary"
OFFERS = ("offer_keys", "offer_sums", "offer_times", "offer_ends", "offer_words", "ask_keys")
CHUNK_ROW = ("docs", "lengths", "held", "sizes", "codes", "words", "short", "new_ids", "new_ends", "new_bytes")
SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def code_of(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - CODE_BITS)).astype(np.int64)


def _hashed(x: np.ndarray, bits: int) -> np.ndarray:
    return (mix(x + _U(0x632BE59BD9B4E019)) >> _U(64 - bits)).astype(np.int64)


def last_short(h: np.ndarray, short: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the last short word before every token of its document, and of the one before that; `first` as in contexts()."""
    n = len(h)
    last = np.where(short, np.arange(n), -1)
    last = np.maximum.accumulate(np.concatenate(([-1], last[:-1]))) if n else last
    has = last >= first
    second = np.where(has, last[np.maximum(last, 0)], -1)
    return np.where(has, h[np.maximum(last, 0)], _U(2)), np.where(second >= first, h[np.maximum(second, 0)], _U(3))


def contexts(h: np.ndarray, short: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Context numbers of every token for WORD_TABLES; `first` is the index of its document's first token."""
    before = np.where(np.arange(len(h)) > first, np.roll(h, 1), _U(1))
    one, two = last_short(h, short, first)
    with np.errstate(over="ignore"):
        return [np.zeros(len(h), np.int64), _hashed(before, CONTEXT_BITS), _hashed(one, CONTEXT_BITS), _hashed(mix(one) * _U(3) + two, CONTEXT_BITS)]


def spelled(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Symbols (bytes, and a blank as end mark), their contexts for BYTE_TABLES, and the word of each; `ends` cut `data` into words."""
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    length = ends - starts + 1
    word = np.repeat(np.arange(len(ends)), length)
    at = np.arange(int(length.sum()))
    open_at = np.repeat(np.cumsum(length) - length, length)
    symbol = np.full(len(at), 0x20, np.int64)
    symbol[at - open_at < np.repeat(length - 1, length)] = data
    back = [np.where(at - open_at >= j, np.roll(symbol, j), 0) for j in (1, 2, 3, 4)]
    c2 = _hashed((back[0] | back[1] << 8).astype(_U), 12)
    c3 = _hashed((back[0] | back[1] << 8 | back[2] << 16 | 1 << 40).astype(_U), 14)
    c4 = _hashed((back[0] | back[1] << 8 | back[2] << 16 | back[3] << 24 | 2 << 40).astype(_U), 14)
    return symbol, [back[0], c2, c3, c4], word


def taken(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some ranges one after another, and where each ends."""
    length = end - start
    stops = np.cumsum(length)
    return data[np.arange(int(length.sum())) - np.repeat(stops - length, length) + np.repeat(start, length)], stops


def places(h: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, end, key) of the chosen places: tokens whose BEFORE words before hash to a number of PLACE_BITS zeros.

    The text of a place ends where the next one begins, or with its document.
    """
    n = len(h)
    if n <= BEFORE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    with np.errstate(over="ignore"):
        key = np.zeros(n - BEFORE, _U)
        for j in range(BEFORE):
            key += h[j : n - BEFORE + j] * GRAM_KEY[j]
        key = mix(key)
    at = np.flatnonzero(((key >> _U(64 - PLACE_BITS)) == 0) & (np.arange(BEFORE, n) - first[BEFORE:] >= BEFORE))
    key, at = key[at] << _U(PLACE_BITS), at + BEFORE
    last = (np.cumsum(lengths)[np.searchsorted(np.cumsum(lengths), at, side="right")]) if len(at) else at
    return at, np.minimum(np.append(at[1:], n), last), key


def text_sums(h: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash of the words of each place's text."""
    if not len(at):
        return np.zeros(0, _U)
    length = end - at
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    with np.errstate(over="ignore"):
        value = mix((h[within + np.repeat(at, length)] & _U(0xFFFF)) + within.astype(_U) * GRAM_KEY[0])
        return mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(_U))


def distinct_places(h: np.ndarray, train: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> tuple:
    """(at, end, group) of all places, and (first place, how many, key, text sum, in training) of each group of equal ones.

    Groups are what a chunk offers (training texts) and then asks (others), each by key and text: sent once, answered once.
    """
    at, end, key = places(h, first, lengths)
    own = train[at] if len(at) else np.zeros(0, bool)
    sums = np.where(own, text_sums(h, at, end), _U(0))
    order = np.lexsort((sums, key, ~own))
    new = np.ones(len(order), bool)
    k, t, o = key[order], sums[order], own[order]
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (o[1:] != o[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    lead = order[new]
    return at, end, group, lead, np.bincount(group, minlength=len(lead)), key[lead], sums[lead], own[lead]


class _Tables:
    """Running counts of one task, and their form for sending."""

    def __init__(self):
        self.counts = {k: np.zeros(a * b, np.int32) for k, (a, b) in TABLES.items()}

    def add(self, name: str, context: np.ndarray, symbol: np.ndarray) -> None:
        np.add.at(self.counts[name], context * TABLES[name][1] + symbol, np.int32(1))

    def rows(self):
        for name, counts in self.counts.items():
            for b in range(0, len(counts), BLOCK):
                part = counts[b : b + BLOCK]
                if part.any():
                    over = np.flatnonzero(part >> 8)
                    high = np.stack([over, part[over] >> 8]).astype(np.uint64).tobytes()
                    yield name, b // BLOCK, zlib.compress((part & 255).astype(np.uint8).tobytes(), 1), high


def read_block(low: bytes, high: bytes) -> np.ndarray:
    part = np.frombuffer(zlib.decompress(low), np.uint8).astype(np.int64)
    over = np.frombuffer(high, np.uint64).reshape(2, -1)
    part[over[0].astype(np.int64)] += over[1].astype(np.int64) << 8
    return part


def squeezed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def opened(data, size: int):
    return pa.decompress(data, decompressed_size=size, codec="zstd")


def planes(x: np.ndarray) -> bytes:
    """An integer array byte plane by byte plane: the high planes are nearly all zero and vanish when compressed."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplaned(data, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _record(**values) -> pa.RecordBatch:
    names = [x.strip().split(" ") for x in CODED.split(",")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    n = max(len(v) for v in values.values())
    return pa.RecordBatch.from_arrays([pa.array(values.get(k, [None] * n), kinds[t]) for k, t in names], [k for k, _ in names])


def coded(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of CODED: chunks of coded texts, their words by hash bucket, and the task's context tables.

    `docs`: doc_id, text, held.
    """
    ship(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, serial = TaskContext.get().partitionId(), 0
        tables = _Tables()
        held_back: dict[str, list] = {}

        def clear():
            held_back.clear()
            held_back.update({k: [] for k in ("docs", "lengths", "held", "sizes", "hash", "short", "spell_hash", "spell")})

        def flush():
            nonlocal serial
            chunk = part << 32 | serial
            serial += 1
            h = np.concatenate(held_back["hash"])
            lengths = np.concatenate(held_back["lengths"])
            held = np.concatenate(held_back["held"])
            words, where, inverse, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.int64)
            by_rank = np.argsort(-n, kind="stable")
            rank[by_rank] = np.arange(len(words))
            train = ~np.repeat(held, lengths)
            counts = np.bincount(inverse[train], minlength=len(words))
            short = np.concatenate(held_back["short"])
            first = np.repeat(np.cumsum(lengths) - lengths, lengths)
            ctx, symbol = contexts(h, short, first), code_of(h)
            for name, c in zip(WORD_TABLES, ctx, strict=True):
                tables.add(name, c[train], symbol[train])
            tables.add("tail", 0, (h[train] & _U(0xFFFF)).astype(np.int64))
            # Only held-out texts can have new words: the bytes of those unseen in this chunk's training texts are kept.
            spell: dict[int, bytes] = {}
            for hashes, texts in zip(held_back["spell_hash"], held_back["spell"], strict=True):
                spell.update(zip(hashes.tolist(), texts, strict=True))
            lone = np.flatnonzero(counts == 0)
            texts = [spell.get(int(x), b"") for x in words[lone]]
            yield _record(
                kind=["chunk"], chunk=[chunk], docs=[np.concatenate(held_back["docs"]).tobytes()], lengths=[lengths.astype(np.int64).tobytes()], held=[held.astype(np.uint8).tobytes()], sizes=[np.concatenate(held_back["sizes"]).astype(np.int64).tobytes()],
                codes=[squeezed(planes(rank[inverse].astype(np.uint32)))], words=[words[by_rank].tobytes()], short=[np.packbits(short[where][by_rank]).tobytes()],
                new_ids=[rank[lone].astype(np.uint32).tobytes()], new_ends=[np.cumsum([len(t) for t in texts], dtype=np.int64).tobytes()], new_bytes=[b"".join(texts)], n_train=[int(train.sum())],
            )
            bucket = (words >> _U(64 - bits)).astype(np.int64)
            edge = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            has = [b for b in range(1 << bits) if edge[b] < edge[b + 1]]
            split = lambda x: [planes(x[edge[b] : edge[b + 1]]) for b in has]
            yield _record(kind=["words"] * len(has), chunk=[chunk] * len(has), bucket=has, hashes=split(words), counts=split(counts.astype(np.uint32)))
            at, end, _, lead, times, key, sums, own = distinct_places(h, train, first, lengths)
            bucket = (key >> _U(64 - bits)).astype(np.int64)
            low = (h & _U(0xFFFF)).astype(np.uint16)
            rows = {k: [] for k in ("bucket", *OFFERS)}
            for b in np.unique(bucket):
                give, ask = np.flatnonzero((bucket == b) & own), np.flatnonzero((bucket == b) & ~own)
                said = [low[at[i] : end[i]] for i in lead[give]]
                ends = np.cumsum([len(x) for x in said], dtype=np.int64)
                for k, x in zip(rows, (int(b), key[give].tobytes(), sums[give].tobytes(), times[give].astype(np.uint32).tobytes(), ends.astype(np.uint32).tobytes(), np.concatenate(said).tobytes() if said else b"", key[ask].tobytes()), strict=True):
                    rows[k].append(x)
            if rows["bucket"]:
                yield _record(kind=["places"] * len(rows["bucket"]), chunk=[chunk] * len(rows["bucket"]), **rows)
            clear()

        clear()
        size = 0
        for batch, data, offsets in blocks(batches):
            w = Words(data, offsets)
            n = w.counts()
            ends = np.cumsum(n)
            h = np.insert(w.hash, ends, END)
            short = np.insert(w.end - w.start <= SHORT, ends, False)
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if (~held[w.doc]).any():
                mine = np.flatnonzero(~held[w.doc])
                with np.errstate(over="ignore"):
                    each = w.hash[mine] + w.doc[mine].astype(_U) * GRAM_KEY[1]
                one = mine[np.sort(np.unique(each, return_index=True)[1])]
                symbol, ctx, _ = spelled(*taken(w.bytes, w.start[one], w.end[one]))
                for name, c in zip(BYTE_TABLES, ctx, strict=True):
                    tables.add(name, c, symbol)
            if held[w.doc].any():
                mine = np.flatnonzero(held[w.doc])
                known = set(w.hash[np.flatnonzero(~held[w.doc])].tolist())
                one = mine[np.unique(w.hash[mine], return_index=True)[1]]
                one = one[[x not in known for x in w.hash[one].tolist()]]
                raw = w.bytes.tobytes()
                held_back["spell_hash"].append(w.hash[one])
                held_back["spell"].append([raw[a:b] for a, b in zip(w.start[one].tolist(), w.end[one].tolist(), strict=True)])
            ids = batch.column(0)
            held_back["docs"].append(np.array([-(2**63) if x is None else x for x in ids.to_pylist()], np.int64))
            held_back["lengths"].append(n + 1)
            held_back["held"].append(held)
            held_back["sizes"].append(np.diff(offsets))
            held_back["hash"].append(h)
            held_back["short"].append(short)
            size += len(h)
            if size >= CHUNK:
                yield from flush()
                size = 0
        if held_back["docs"]:
            yield from flush()
        rows = list(tables.rows())
        if rows:
            name, block, low, high = map(list, zip(*rows, strict=True))
            yield _record(kind=["tables"] * len(name), name=name, block=block, low=low, high=high)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("held").alias("held")).mapInArrow(run, CODED)


def word_counts(table: pa.Table) -> pa.Table:
    """Of one hash bucket: the counts in all training texts of every chunk's words, in order, and a row of totals (chunk null)."""
    parts = [(c.as_py(), unplaned(h.as_buffer(), _U), unplaned(n.as_buffer(), np.uint32), b.as_py()) for c, h, n, b in zip(*(table.column(k) for k in ("chunk", "hashes", "counts", "bucket")), strict=True)]
    words, inverse = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, inverse, np.concatenate([p[2] for p in parts]))
    edge = np.cumsum([0] + [len(p[1]) for p in parts])
    rows = [(p[0], p[3], planes(total[inverse[a:b]]), 0, 0) for p, a, b in zip(parts, edge[:-1], edge[1:], strict=True)]
    rows.append((None, None, b"", int((total > 0).sum()), int((total == 1).sum())))
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "bucket", "counts", "v", "v1"])


def continuations(table: pa.Table) -> pa.Table:
    """Of one hash bucket of places: what follows each chunk's groups elsewhere in the training texts.

    The answer to a group is the text most often seen after its words, itself counted once less, ties to the smaller hash:
    `which` has its number among the answer's texts, -1 for none, -2 for the group's own text.
    """
    raw = lambda k, t: [np.frombuffer(x.as_buffer(), t) for x in table.column(k)]
    keys, sums, times, ends, words, asks = (raw(k, t) for k, t in zip(OFFERS, (_U, _U, np.uint32, np.uint32, np.uint16, _U), strict=True))
    part = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    nth = np.arange(len(part)) - np.repeat(np.cumsum([0] + [len(k) for k in keys])[:-1], [len(k) for k in keys])
    key, sum_, time = np.concatenate(keys), np.concatenate(sums), np.concatenate(times).astype(np.int64)
    order = np.lexsort((sum_, key))
    k, t = key[order], sum_[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1])
    lead = np.flatnonzero(new)
    number = np.add.reduceat(time[order], lead) if len(lead) else np.zeros(0, np.int64)
    k, t, source = k[lead], t[lead], order[lead]
    best = np.lexsort((t, -number, k))  # by key, then most often seen
    k, t, number, source = k[best], t[best], number[best], source[best]
    head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    top, size = k[head], np.diff(np.append(head, len(k)))
    rows = []
    for i, (chunk, bucket) in enumerate(zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), strict=True)):
        mine = np.searchsorted(top, keys[i])
        one, two = head[mine], np.where(size[mine] > 1, head[mine] + 1, -1)
        own_first = t[one] == sums[i]
        left = number[one] - own_first
        other = np.where(two >= 0, number[np.maximum(two, 0)], 0)
        pick = np.where((left >= other) & (left > 0), one, np.where(own_first & (other > 0), two, -1))
        same = (pick >= 0) & (t[np.maximum(pick, 0)] == sums[i])
        where = np.searchsorted(top, asks[i])
        found = (where < len(top)) & (top[np.minimum(where, len(top) - 1)] == asks[i]) if len(top) else np.zeros(len(asks[i]), bool)
        pick = np.concatenate([np.where(same, -2, pick), np.where(found, head[np.minimum(where, max(len(head) - 1, 0))] if len(head) else -1, -1)]).astype(np.int64)
        sent, which = np.unique(pick[pick >= 0], return_inverse=True)
        pick[pick >= 0] = which
        texts = []
        for g in sent:
            p, j = part[source[g]], nth[source[g]]
            texts.append(words[p][ends[p][j - 1] if j else 0 : ends[p][j]])
        rows.append((chunk, bucket, pick.astype(np.int32).tobytes(), np.cumsum([len(x) for x in texts], dtype=np.int64).tobytes(), np.concatenate(texts).tobytes() if texts else b""))
    kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 3)
    return pa.table([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], names=["chunk", "bucket", "which", "text_ends", "texts"])


def block_sums(key: tuple, table: pa.Table) -> pa.Table:
    total = None
    for low, high in zip(table.column("low"), table.column("high"), strict=True):
        part = read_block(low.as_py(), high.as_py())
        total = part if total is None else total + part
    over = np.flatnonzero(total >> 8)
    high = np.stack([over, total[over] >> 8]).astype(np.uint64).tobytes()
    return pa.table({"name": pa.array([key[0].as_py()]), "block": pa.array([key[1].as_py()], pa.int32()), "low": pa.array([zlib.compress((total & 255).astype(np.uint8).tobytes(), 1)], pa.binary()), "high": pa.array([high], pa.binary())})


def nodes(leaves: np.ndarray, contexts_: int, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(ones, all) of every inner node of the code tree, heap order from 1, context after context."""
    depth = symbols.bit_length() - 1
    ones, every = np.zeros((contexts_, symbols), np.int64), np.zeros((contexts_, symbols), np.int64)
    level = leaves.reshape(contexts_, symbols).astype(np.int64)
    for d in range(depth - 1, -1, -1):
        pair = level.reshape(contexts_, 1 << d, 2)
        level = pair.sum(axis=2)
        ones[:, 1 << d : 2 << d] = pair[:, :, 1]
        every[:, 1 << d : 2 << d] = level
    return ones.ravel(), every.ravel()


def stretch(ones: np.ndarray, every: np.ndarray, prior: np.ndarray | float = 0.5, strength: float = 0.8) -> np.ndarray:
    """Log odds of a one from counts, drawn towards `prior` by as many pseudo-counts as `strength`."""
    return np.log((ones + strength * prior) / (every - ones + strength * (1 - prior))).astype(np.float32)


def priors(raw: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """P(one) of each node of the code without context: what a context says of bits it has not seen."""
    ones, every = raw
    return (ones + 0.4) / (every + 0.8)


@dataclass
class MixModel:
    """What scoring needs besides a chunk's word counts; its size is fixed."""

    tables: dict[str, np.ndarray]  # stretched probabilities in 1/SCALE, int16
    code_totals: np.ndarray
    tails: np.ndarray  # training tokens by 16 bits of hash
    train_tokens: int
    vocabulary: int
    singles: int


def build(leaves: dict[str, np.ndarray], n: int, v: int, v1: int) -> MixModel:
    """The model of the counts; `leaves` is emptied table by table."""
    small, totals, tails, prior = {}, leaves["none"].copy(), leaves.pop("tail"), None
    for k in (*WORD_TABLES, *BYTE_TABLES):
        raw = nodes(leaves.pop(k), *TABLES[k])
        if k == "none":
            prior = priors(raw)
        backed = (np.tile(prior, TABLES[k][0]), BACKING) if k in WORD_TABLES[1:] else (0.5, 0.8)
        small[k] = np.clip(np.rint(stretch(*raw, *backed) * SCALE), -32767, 32767).astype(np.int16)
    return MixModel(small, totals, tails, n, v, v1)


def earlier(key: np.ndarray) -> np.ndarray:
    """How many earlier entries have the same key, for each entry."""
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(key) else np.zeros(0, np.int64)
    out = np.empty(len(key), np.int64)
    out[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return out


def spell_cost(m: MixModel, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Natural log of each new word's probability, its bytes bit by bit."""
    if len(ends) == 0:
        return np.zeros(0)
    out = np.zeros(len(ends))
    for a in range(0, len(ends), 1 << 15):
        e = ends[a : a + (1 << 15)]
        begin = int(ends[a - 1]) if a else 0
        symbol, ctx, word = spelled(data[begin : int(e[-1])], e - begin)
        total = np.zeros(len(symbol), np.float32)
        for d in range(8):
            node = (1 << d) + (symbol >> (8 - d))
            sign = 1 - 2 * ((symbol >> (7 - d)) & 1).astype(np.float32)
            x = np.zeros(len(symbol), np.float32)
            for k, c in enumerate(ctx):
                x += m.tables[BYTE_TABLES[k]][c * 256 + node] * np.float32(BYTE_START[k] / SCALE)
            total -= np.logaddexp(np.float32(0), sign * x)
        out[a : a + len(e)] = np.bincount(word, total, minlength=len(e))
    return out


def code_cost(m: MixModel, codes: np.ndarray, ctx: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each code; documents stand one after another, `lengths` codes each."""
    n_docs, inputs = len(lengths), len(ctx)
    out = np.zeros(len(codes), np.float32)
    order = np.argsort(-lengths, kind="stable")
    length, start = lengths[order], (np.cumsum(lengths) - lengths)[order]
    # Inputs: what each further context adds to the prediction without context, and one that is constant.
    weights = np.zeros((inputs, CODE_BITS, n_docs), np.float32)
    weights[:-1] = np.array(WORD_START, np.float32)[:, None, None]
    last = np.zeros((2, CODE_BITS, n_docs), np.float32)
    last[0] = 1.0
    tables = [m.tables[k] for k in WORD_TABLES]
    unit, one = np.float32(1 / SCALE), np.float32(1)
    for step in range(0, int(length.max(initial=0)), STEP):
        active = int(np.searchsorted(-length, -step, side="left"))
        n = np.minimum(length[:active] - step, STEP)
        first = np.cumsum(n) - n
        lane = np.repeat(np.arange(active), n)
        at = np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(start[:active] + step, n)
        code = codes[at]
        base = [c[at] * _CODES for c in ctx]
        total = np.zeros(len(at), np.float32)
        for d in range(CODE_BITS):
            node = (1 << d) + (code >> (CODE_BITS - d))
            bit = ((code >> (CODE_BITS - 1 - d)) & 1).astype(np.float32)
            plain = tables[0][node] * unit
            w = weights[:, d, :active]
            x = plain + w[-1][lane]
            more = []
            for k in range(1, inputs):
                y = tables[k][base[k] + node] * unit - plain
                more.append(y)
                x += y * w[k - 1][lane]
            x = np.clip(x, -16, 16)
            slope, shift = last[0, d, :active], last[1, d, :active]
            z = np.clip(slope[lane] * x + shift[lane], -16, 16)
            e = np.exp(np.where(bit > 0, -z, z))
            total -= np.log1p(e)
            off = np.where(bit > 0, one, -one) * (e / (one + e))  # bit - P(one)
            miss = (bit - one / (one + np.exp(-x))) * np.float32(RATE)
            for k, y in enumerate(more):
                w[k] += np.add.reduceat(miss * y, first)
            w[-1] += np.add.reduceat(miss, first)
            off *= np.float32(LAST_RATE)
            slope += np.add.reduceat(off * x, first)
            shift += np.add.reduceat(off, first)
        out[at] = total
    return out


def predicted(table: pa.Table, h: np.ndarray, train: np.ndarray, known: np.ndarray, first: np.ndarray, lengths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the tokens with a prediction, whether each is a hit) from the answers to a chunk's places."""
    at, end, group, lead, _, key, _, _ = distinct_places(h, train, first, lengths)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    rows = sorted((table.column("bucket")[i].as_py(), i) for i, x in enumerate(table.column("which")) if x.is_valid)
    read = lambda k, t: [np.frombuffer(table.column(k)[i].as_buffer(), t) for _, i in rows]
    which, ends, texts = read("which", np.int32), read("text_ends", np.int64), read("texts", np.uint16)
    # Groups of a chunk in the order of the answers: by bucket, offers before asks, as they were sent.
    bucket = (key >> _U(64 - bits)).astype(np.int64)
    sent = np.argsort(bucket, kind="stable")
    moved = np.cumsum([0] + [len(x) for x in ends])
    shift = np.repeat(moved[:-1], [len(w) for w in which])
    pick = np.concatenate(which).astype(np.int64)
    answer = np.empty(len(lead), np.int64)
    answer[sent] = np.where(pick >= 0, pick + shift, pick)
    before = np.cumsum([0] + [len(x) for x in texts])
    stop = np.concatenate([e + b for e, b in zip(ends, before[:-1], strict=True)]) if len(moved) > 1 else np.zeros(0, np.int64)
    begin = np.concatenate([np.concatenate(([0], e[:-1])) + b if len(e) else e for e, b in zip(ends, before[:-1], strict=True)]) if len(moved) > 1 else stop
    text = np.concatenate(texts) if texts else np.zeros(0, np.uint16)
    mine = answer[group]
    length = end - at
    there = np.where(mine == -2, length, 0)
    real = mine >= 0
    there[real] = np.minimum(length[real], (stop - begin)[mine[real]])
    index = np.repeat(at, there) + np.arange(int(there.sum())) - np.repeat(np.cumsum(there) - there, there)
    own = np.repeat(mine == -2, there)
    source = np.zeros(len(at), np.int64)
    source[real] = begin[mine[real]]
    source = np.repeat(source - at, there) + index
    low = (h[index] & _U(0xFFFF)).astype(np.uint16)
    hit = own.copy()
    hit[~own] = text[source[~own]] == low[~own]
    return index, hit & known[index]


def hit_cost(index: np.ndarray, hit: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each hit or miss, by adaptive counters of the document (`doc` of each) and the last run."""
    n = np.arange(len(index))
    start = np.searchsorted(doc, doc)
    missed = np.maximum.accumulate(np.concatenate(([-1], np.where(hit, -1, n)[:-1]))) if len(n) else n
    run = n - np.maximum(missed + 1, start)
    state = np.searchsorted(RUNS, run, side="right")
    key = doc * 8 + state
    seen = earlier(key)
    order = np.argsort(key, kind="stable")
    before = np.cumsum(hit[order]) - hit[order]
    sorted_ = key[order]
    head = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(n) else n
    hits = np.empty(len(n), np.int64)
    hits[order] = before - np.repeat(before[head], np.diff(np.append(head, len(n))))
    p = (hits + HIT_STRENGTH * HIT_START[state]) / (seen + HIT_STRENGTH)
    return np.log(np.where(hit, p, 1 - p))


def score_chunk(m: MixModel, table: pa.Table, bits: int) -> pa.Table:
    """Scores of the documents of one chunk: its row of coded texts, its words' counts and the answers to its places."""
    whole = next(i for i, c in enumerate(table.column("codes")) if c.is_valid)
    read = lambda k, t: np.frombuffer(table.column(k)[whole].as_buffer(), t)
    ids, lengths, held, sizes = read("docs", np.int64), read("lengths", np.int64), read("held", np.uint8).astype(bool), read("sizes", np.int64)
    codes = unplaned(opened(read("codes", np.uint8), 4 * int(lengths.sum())), np.uint32).astype(np.int64)
    h = read("words", _U)
    short = np.unpackbits(read("short", np.uint8), count=len(h)).astype(bool)
    counts = sorted((table.column("bucket")[i].as_py(), i) for i, c in enumerate(table.column("counts")) if c.is_valid)
    count = np.empty(len(h), np.int64)
    count[np.argsort(h)] = np.concatenate([unplaned(table.column("counts")[i].as_buffer(), np.int64) for _, i in counts])
    first = np.cumsum(lengths) - lengths
    group, lane_first = np.repeat(np.arange(len(lengths)), lengths), np.repeat(first, lengths)
    known = count > 0
    token_known, hashes = known[codes], h[codes]
    base = np.log10((count + 0.5) / (m.train_tokens + 0.5 * (m.vocabulary + 1)))
    n_known = np.add.reduceat(token_known.astype(np.int64), first)
    base_score = np.add.reduceat(base[codes], first)
    cost = np.zeros(len(codes))
    # Predicted tokens: a hit leaves the words of the same 16 bits.
    index, hit = predicted(table, hashes, ~np.repeat(held, lengths), token_known, lane_first, lengths, bits)
    cost[index] = hit_cost(index, hit, group[index])
    done = np.zeros(len(codes), bool)
    done[index[hit]] = True
    tail = np.maximum(m.tails[(h & _U(0xFFFF)).astype(np.int64)], count)
    cost[done] += np.log(count[codes[done]]) - np.log(tail[codes[done]])
    open_ = ~done
    # Escapes: known or new, refined by the document's own new words so far.
    new = (~token_known).astype(np.int64)
    before = np.cumsum(new) - new
    before -= before[lane_first]
    place = np.arange(len(codes)) - lane_first
    p = (before + PRIOR * (m.singles + 0.5) / (m.train_tokens + 1)) / (place + PRIOR)
    cost += np.where(open_, np.log(np.where(token_known, 1 - p, p)), 0.0)
    # Known words: their code, and their share within it; or the document's own words.
    same_word = earlier(group * len(count) + codes)
    via = open_ & token_known
    ctx = contexts(hashes, short[codes], lane_first)
    code = code_of(hashes)
    share = np.zeros(len(count))
    share[known] = np.log(count[known]) - np.log(np.maximum(m.code_totals[code_of(h[known])], count[known]))
    n_via = np.add.reduceat(via.astype(np.int64), first)
    coded_ = code_cost(m, code[via], [c[via] for c in ctx], n_via) + share[codes[via]]
    words_before = (place - before)[via]
    cache = CACHE * words_before / (words_before + CACHE_WORDS)
    cost[via] += np.log((1 - cache) * np.exp(coded_) + cache * same_word[via] / np.maximum(words_before, 1))
    # New words: said before in the document, else their bytes.
    said = same_word > 0
    again = (~token_known & said).astype(np.int64)
    again = np.cumsum(again) - again
    again -= again[lane_first]
    repeat = np.where(before > 0, (again + 0.5) / (before + 2.0), 0.0)
    fresh, old = np.flatnonzero(~token_known & ~said), np.flatnonzero(~token_known & said)
    cost[old] += np.log(repeat[old]) + np.log(same_word[old] / before[old])
    new_ids, new_ends = read("new_ids", np.uint32).astype(np.int64), read("new_ends", np.int64)
    where = np.full(len(count), -1)
    where[new_ids] = np.arange(len(new_ids))
    told = where[codes[fresh]]
    cost[fresh] += np.log(1 - repeat[fresh]) + spell_cost(m, *taken(read("new_bytes", np.uint8), (new_ends - np.diff(new_ends, prepend=0))[told], new_ends[told]))
    score = np.add.reduceat(cost, first) / np.log(10)
    null = ids == -(2**63)
    return pa.table(
        [pa.array(ids, mask=null), pa.array(held), pa.array(lengths), pa.array(n_known), pa.array(np.full(len(ids), m.train_tokens)), pa.array(base_score), pa.array(score), pa.array(-score * np.log2(10) / (sizes + 1))],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
    )


def score(docs: DataFrame, held_out) -> DataFrame:
    """Rows of SCORED for all `docs` (doc_id, text); the model learns from the rows where the Column `held_out` is not true.

    A null text reads as empty (one token, the end). Rows that repeat count and are scored each. Without training rows every
    token is new. An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ctxmix")
    bits = max(4, (max(1, shuffle_partitions(spark)) - 1).bit_length())
    texts = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    made = scratch.keep(coded(texts, bits), "coded", "kind")
    counted = made.where("kind = 'words'").select("chunk", "bucket", "hashes", "counts").groupBy("bucket").applyInArrow(word_counts, "chunk bigint, bucket int, counts binary, v bigint, v1 bigint")
    counts = scratch.keep(counted, "counts")
    answers = made.where("kind = 'places'").select("chunk", "bucket", *OFFERS).groupBy("bucket").applyInArrow(continuations, "chunk bigint, bucket int, which binary, text_ends binary, texts binary")
    sizes = counts.agg(F.sum("v").alias("v"), F.sum("v1").alias("v1")).first()
    n = made.where("kind = 'chunk'").agg(F.sum("n_train").alias("n")).first()["n"] or 0
    # Two steps: a block's rows, one a task, are summed in SUMS groups and these are summed.
    sums = "name string, block int, low binary, high binary"
    parts = made.where("kind = 'tables'").select("name", "block", "low", "high").groupBy("name", "block", F.pmod(F.xxhash64("low"), F.lit(SUMS)).alias("part")).applyInArrow(block_sums, sums)
    summed = parts.groupBy("name", "block").applyInArrow(block_sums, sums)
    leaves = {k: np.zeros(a * b, np.int64) for k, (a, b) in TABLES.items()}
    for row in summed.toLocalIterator():  # a fixed number of blocks
        part = read_block(row["low"], row["high"])
        leaves[row["name"]][row["block"] * BLOCK : row["block"] * BLOCK + len(part)] = part
    for kind in ("words", "tables"):  # summed
        scratch.drop(f"coded/kind={kind}")
    model = build(leaves, int(n), int(sizes["v"] or 0), int(sizes["v1"] or 0))
    del leaves
    shared = spark.sparkContext.broadcast(model)

    def run(table: pa.Table) -> pa.Table:
        from aerograin.llm import ctxmix as own

        return own.score_chunk(shared.value, table, bits)

    def rows(df: DataFrame, *has: str) -> DataFrame:
        names = ("bucket", *CHUNK_ROW, "counts", "which", "text_ends", "texts")
        return df.select("chunk", *[F.col(c) if c in has else F.lit(None).cast("int" if c == "bucket" else "binary").alias(c) for c in names])

    together = rows(made.where("kind = 'chunk'"), *CHUNK_ROW).union(rows(counts.where(F.col("chunk").isNotNull()), "bucket", "counts")).union(rows(answers, "bucket", "which", "text_ends", "texts"))
    return together.groupBy("chunk").applyInArrow(run, SCORED)
