"""N-gram Jaccard self-join by PartEnum signatures, and the connected groups it yields.

A document is the set of its 5-word shingles (64-bit hashes); equal sets are one class. Two classes link when
100 |A ∩ B| >= 75 |A ∪ B|, which for sizes a <= b means a >= 0.75 b and |A Δ B| <= (a + b) / 7.

1. Document frequency. A class with a partner shares 75 % of its shingles with it, so classes of whose shingles fewer than
   75 % occur in another class are done: they have no link. Exact, and all but the likely copies leave here.
2. PartEnum. Sizes fall into bands of ratio 4/3, so partners are in the same band or in neighbouring ones; each of these is
   a rendezvous with a bound k on |A Δ B|. The shingle domain is partitioned by hash into n1 parts, each into 3 sub-parts.
   At least n1 - k // 2 parts differ by one element at most, so there two of the three sub-parts agree: each set signs
   every pair of sub-parts of every part (the enumerated subsets), and linked sets share a signature. A signature of no
   element would be shared by many; it is left out where more parts must agree than the set has parts with such a
   signature, else given. Sets of up to 48 shingles (and those up to 64, their possible partners) would have too many empty
   parts: they partition the domain into single elements and sign the 2 floor(size / 4) + 1 smallest.
3. Candidates. Linked sets share many parts, not one: a pair is a candidate where its common signatures are as many as linked
   sets of these sizes must have. Pairs of a class and a hub of its signatures are counted first and give each class a label;
   what is left is counted as a class and a label, so rows grow with a group of near copies and not with its pairs.
   Signatures of more than `FREQUENT` classes (passages that many texts have) are not counted; a set's parts with such a
   signature are taken off what its pairs must share, and sets left with nothing to share make stars over all their
   signatures. Exact, and a passage that all texts have does not join them in one group.
4. Verification. Candidates are joined in groups (connected components): linked classes are always in one group. Groups are
   cut into packs of about `PACK` classes of like size (fewer of long ones), and packs whose sizes can link are compared
   pack by pack, each class with each, in one vectorised count of common elements; a large group's packs are dealt in tiles.
   A pair of packs gives a spanning forest of its links, never its pairs; no class is left out, whatever a group's size.

Signatures travel as packed blocks, one per (chunk, bucket); within a chunk a shingle known by two classes is sent twice at
most, so a shingle in a third of the corpus is no hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, settings, ship, shuffle_partitions
from .arrays import U64, Words, blocks, give_back, mix, word_grams

K_WORDS = 5
TINY = 48
PACK = 256
PACK_SHINGLES = 1 << 17
TILE = 8
SPARE = 0.5
CHUNK = 1 << 20
SLICE = 1 << 17
FREQUENT = 32
OWN, UPPER, LOWER, SINGLE = 0, 1, 2, 3
PARTNER = [OWN, LOWER, UPPER, SINGLE]

_U = np.uint64
BLOCKS = "bucket int, keys binary, owner binary, classes binary, flags binary, counts binary"


def bands(upto: int) -> list[tuple[int, int]]:
    """Size bands above TINY: [49, 65], [66, 88], ... each hi is floor(4 lo / 3)."""
    out, lo = [], TINY + 1
    while lo <= upto:
        out.append((lo, 4 * lo // 3))
        lo = out[-1][1] + 1
    return out


def shingle_sets(batch_blocks, k: int = K_WORDS):
    """(batch rows, sorted distinct shingles, document of each, cut points) per block of text."""
    for batch, data, offsets in batch_blocks:
        doc, gram = word_grams(Words(data, offsets), k)
        order = np.lexsort((gram, doc))
        doc, gram = doc[order], gram[order]
        keep = np.ones(len(doc), bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
        doc, gram = doc[keep], gram[keep]
        yield batch, gram, doc, np.searchsorted(doc, np.arange(batch.num_rows + 1))


def set_hash(gram: np.ndarray, doc: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """One 64-bit hash per set, of all its elements and its size; 0 for the empty set."""
    total = np.zeros(len(cut) - 1, _U)
    np.add.at(total, doc, mix(gram ^ _U(0xA5A5_1234_9E37_79B9)))
    size = np.diff(cut).astype(_U)
    return np.where(size == 0, _U(0), mix(total + size * _U(0xD6E8FEB86659FD93)) | _U(1))


def parts_of(k):
    """n1, the number of parts of a rendezvous with bound k on |A Δ B|."""
    return np.ceil((k // 2 + 1) * (1 + SPARE)).astype(np.int64)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) of all signatures of the sets (sorted distinct shingles each)."""
    return signed(sets)[:2]


def signed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set number, signature, slot) of all signatures of the sets, and for each set and slot the parts with an empty signature.

    A slot is what a set is in a rendezvous: OWN where its band meets itself, UPPER where its band meets the one below, LOWER
    where it meets the one above, SINGLE where elements are signed one by one.
    """
    who: list[np.ndarray] = []
    sigs: list[np.ndarray] = []
    slots: list[np.ndarray] = []
    bare = np.zeros((len(sets), 4), np.int64)
    sizes = np.array([len(s) for s in sets], np.int64)
    for i in np.flatnonzero((sizes > 0) & (sizes <= 4 * TINY // 3)):
        prefix = sets[i][: 2 * (sizes[i] // 4) + 1]
        who.append(np.full(len(prefix), i))
        sigs.append(mix(prefix ^ _U(0x5157_0000_0000_0001)))
        slots.append(np.full(len(prefix), SINGLE, np.uint8))
    table = bands(int(sizes.max(initial=0)) * 4 // 3 + 1)
    for j, (lo, hi) in enumerate(table):
        own = np.flatnonzero((sizes >= lo) & (sizes <= hi))
        if len(own):
            _sign(sets, sizes, own, 2 * j, 2 * hi // 7, hi, who, sigs, slots, bare)
        if j:
            below, top = table[j - 1]
            both = np.flatnonzero((sizes >= below) & (sizes <= hi))
            if len(both):
                _sign(sets, sizes, both, 2 * j + 1, (top + hi) // 7, hi, who, sigs, slots, bare, top)
    if not who:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.uint8), bare
    return np.concatenate(who), np.concatenate(sigs), np.concatenate(slots), bare


def _sign(sets, sizes, chosen, space: int, k: int, hi: int, who: list, sigs: list, slots: list, bare_parts: np.ndarray, top: int | None = None) -> None:
    """Signatures of one rendezvous; `top` is the upper end of the lower band where two bands meet."""
    n1 = int(parts_of(k))
    salt = mix(np.array([space * 1_000_003 + 77], _U))[0]
    elements = np.concatenate([sets[i] for i in chosen])
    owner = np.repeat(np.arange(len(chosen)), sizes[chosen])
    x = mix(elements ^ salt)
    part = ((x >> _U(32)) * _U(n1)) >> _U(32)
    sub = ((x & _U(0xFFFFFFFF)) * _U(3)) >> _U(32)
    cell = (owner * n1 + part.astype(np.int64)) * 3 + sub.astype(np.int64)
    total = np.zeros(len(chosen) * n1 * 3, _U)
    np.add.at(total, cell, mix(x + _U(0x9E3779B97F4A7C15)))
    count = np.bincount(cell, minlength=len(total)).reshape(-1, n1, 3)
    total = total.reshape(-1, n1, 3)
    left, right = np.array([0, 0, 1]), np.array([1, 2, 2])
    size = count[:, :, left] + count[:, :, right]
    pair = total[:, :, left] + total[:, :, right]
    label = np.arange(n1 * 3, dtype=_U).reshape(1, n1, 3)
    sig = mix(pair + size.astype(_U) * _U(0xC2B2AE3D27D4EB4F) + mix(label + salt))
    mine = sizes[chosen]
    slot = np.full(len(chosen), OWN, np.uint8) if top is None else np.where(mine > top, UPPER, LOWER).astype(np.uint8)
    bare = (size == 0).any(axis=2).sum(axis=1)
    bare_parts[chosen, slot] = bare
    give = (size > 0) | (bare >= least_shared(mine)[np.arange(len(mine)), slot])[:, None, None]
    at = np.nonzero(give)
    who.append(chosen[at[0]])
    sigs.append(sig[at])
    slots.append(slot[at[0]])


def band_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band number of each size (-1 up to TINY), and the lower and upper end of the band."""
    table = np.array([(1, TINY), *bands(int(np.max(n, initial=0)))], np.int64)
    at = np.searchsorted(table[:, 1], n)
    return at - 1, table[at, 0], table[at, 1]


def shared_parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many parts agree at least (single elements: how many of both prefixes are common) of linked sets of sizes a and b.

    Prefixes of floor(n / 4) + l elements have l in common where three quarters of the set are; here l is floor(n / 4) + 1.
    """
    low, high = np.minimum(a, b), np.maximum(a, b)
    hi = band_of(high)[2]
    top = band_of(low)[2]
    return np.where(low <= TINY, low // 4 + 1, parts_of((top + hi) // 7) - (a + b) // 7 // 2)


def least_shared(n: np.ndarray) -> np.ndarray:
    """The least of `shared_parts` over all partners of a set of size n, for each slot."""
    band, lo, hi = band_of(n)
    most = 4 * n // 3
    own = shared_parts(n, np.minimum(hi, most))
    above = np.maximum(hi + 1, np.minimum(4 * (hi + 1) // 3, most))
    below = np.maximum(lo - 1, 1)
    return np.stack([own, shared_parts(n, below), shared_parts(n, above), (3 * n + 3) // 4 // 4 + 1], axis=1)


def packed(bucket_bits: int, keys: np.ndarray, owner: np.ndarray, classes: np.ndarray, flag: np.ndarray, counts: bytes, turn: int):
    """Split entries (64-bit key, owner = index into classes, flag) by the key's top bits into rows of BLOCKS."""
    bucket = (keys >> _U(64 - bucket_bits)).astype(np.int32) if bucket_bits else np.zeros(len(keys), np.int32)
    order = np.lexsort((owner, bucket))
    bucket, keys, owner, flag = bucket[order], keys[order], owner[order], flag[order]
    low = ((keys << _U(bucket_bits)) >> _U(32)).astype(np.uint32)
    which, first = np.unique(bucket, return_index=True)
    rows: list[list] = [[] for _ in range(6)]
    for b, at, to in zip(which, first, [*first[1:], len(bucket)], strict=True):
        present, local = np.unique(owner[at:to], return_inverse=True)
        for column, value in zip(rows, (int(b), low[at:to].tobytes(), local.astype(np.uint32 if len(present) > 65535 else np.uint16).tobytes(), classes[present].tobytes(), np.packbits(flag[at:to]).tobytes(), None), strict=True):
            column.append(value)
    if counts:
        for column, value in zip(rows, (turn % (1 << bucket_bits), b"", b"", b"", b"", counts), strict=True):
            column.append(value)
    kinds = (pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["bucket", "keys", "owner", "classes", "flags", "counts"])


def unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, class, flag) of the entries of a bucket, sorted by these."""
    keys, classes, flags = [np.zeros(0, np.uint32)], [np.zeros(0, _U)], [np.zeros(0, np.uint8)]
    for k, o, c, f in zip(*(table.column(n) for n in ("keys", "owner", "classes", "flags")), strict=True):
        key = np.frombuffer(k.as_py(), np.uint32)
        if len(key) == 0:
            continue
        own = np.frombuffer(c.as_py(), _U)
        at = np.frombuffer(o.as_py(), np.uint32 if len(own) > 65535 else np.uint16)
        keys.append(key)
        classes.append(own[at])
        flags.append(np.unpackbits(np.frombuffer(f.as_py(), np.uint8), count=len(key)))
    key, cls, flag = map(np.concatenate, (keys, classes, flags))
    order = np.lexsort((flag, cls, key))
    return key[order], cls[order], flag[order]


def groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and size of each run of equal keys."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def bucket_bits_for(docs: DataFrame) -> int:
    return max(4, (max(1, shuffle_partitions(docs.sparkSession)) - 1).bit_length() + 1)


MEMBERS = "doc_id bigint, digest binary, n_shingles bigint, class bigint"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, digest (MD5 of the text, null of a null text) and text: what tells rows apart that share or lack a doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))


def members(docs: DataFrame) -> DataFrame:
    """Rows of MEMBERS, one of every row (class 0: no shingle). A null text reads as empty."""
    ship(docs.sparkSession)

    def run(batches):
        for batch, gram, doc, cut in shingle_sets(blocks(batches)):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(cut).astype(np.int64)), pa.array(set_hash(gram, doc, cut).view(np.int64))], ["doc_id", "digest", "n_shingles", "class"])

    return keyed(docs).mapInArrow(run, MEMBERS)


def shared_shingles(docs: DataFrame) -> DataFrame:
    """class, n_shared: how many shingles of the class occur in another class (classes with none are absent)."""
    ship(docs.sparkSession)
    bits = bucket_bits_for(docs)

    def emit(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() * 31

        def flush():
            nonlocal turn
            turn += 1
            key = np.concatenate(held)
            owner = np.repeat(np.arange(len(classes), dtype=np.uint32), [len(h) for h in held])
            held.clear()
            order = np.argsort(key, kind="stable")
            key, owner = key[order], owner[order]
            first, size = groups(key)
            known = np.repeat(size > 1, size)
            counts = np.bincount(owner[known], minlength=len(classes))
            at = np.concatenate((np.flatnonzero(~known), first[size > 1], first[size > 1] + 1))
            table = np.array(classes, _U)
            has = np.flatnonzero(counts)
            local = np.stack([table[has], counts[has].astype(_U), np.ones(len(has), _U)]).tobytes() if len(has) else b""
            return packed(bits, key[at], owner[at], table, known[at], local, turn)

        held, classes, known_classes, size = [], [], set(), 0
        for _, gram, doc, cut in shingle_sets(blocks(batches)):
            for i, c in enumerate(set_hash(gram, doc, cut).tolist()):
                if c and c not in known_classes:
                    known_classes.add(c)
                    classes.append(c)
                    held.append(gram[cut[i] : cut[i + 1]])
                    size += len(held[-1])
            if size >= CHUNK:
                yield flush()
                held, classes, known_classes, size = [], [], set(), 0
        if held:
            yield flush()
        give_back()

    def count(table: pa.Table) -> pa.Table:
        key, cls, flag = unpacked(table)
        first, size = groups(key)
        several = np.zeros(len(first), bool)
        if len(first):
            several = (np.minimum.reduceat(cls, first) != np.maximum.reduceat(cls, first)) | np.logical_or.reduceat(flag.astype(bool), first)
        lone = np.repeat(several, size) & (flag == 0)
        if len(key):  # the same class from two chunks counts once, and where one of them does not know the shingle as shared
            twin = np.zeros(len(key), bool)
            twin[1:] = (key[1:] == key[:-1]) & (cls[1:] == cls[:-1]) & (flag[1:] == flag[:-1])
            lone &= ~twin
        who, n = np.unique(cls[lone], return_counts=True)
        known = [np.frombuffer(c.as_py(), _U).reshape(3, -1) for c in table.column("counts") if c.as_py()]
        return _by_class(bits, np.concatenate([np.stack([who, n.astype(_U), np.zeros(len(who), _U)]), *known], axis=1))

    def counted(table: pa.Table) -> pa.Table:
        out = count(table)
        give_back()
        return out

    def total(table: pa.Table) -> pa.Table:
        both = np.concatenate([np.frombuffer(c.as_py(), _U).reshape(3, -1) for c in table.column("counts")], axis=1)
        who, inverse = np.unique(both[0], return_inverse=True)
        n, least = np.zeros(len(who), np.int64), np.full(len(who), np.iinfo(np.int64).max)
        chunk = both[2] == 1
        np.add.at(n, inverse[~chunk], both[1][~chunk].astype(np.int64))
        np.minimum.at(least, inverse[chunk], both[1][chunk].astype(np.int64))
        return pa.table({"class": pa.array(who.view(np.int64)), "n_shared": pa.array(n + np.where(least == np.iinfo(np.int64).max, 0, least))})

    sent = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(emit, BLOCKS)
    seen = sent.groupBy("bucket").applyInArrow(counted, "part int, counts binary")
    # A class met in several chunks: the buckets count what is not known in some chunk, and what is known in all of them is no
    # more than the least count of a chunk. An upper bound, as a filter needs, and one that does not grow with the copies.
    return seen.groupBy("part").applyInArrow(total, "class bigint, n_shared bigint")


def _by_class(bits: int, counts: np.ndarray) -> pa.Table:
    """Counts (class, count, whether it is a chunk's) as one packed row for each range of class hashes."""
    counts = counts[:, np.argsort(counts[0], kind="stable")]
    part = (counts[0] >> _U(64 - bits)).astype(np.int64)
    edge = np.searchsorted(part, np.arange((1 << bits) + 1))
    has = [b for b in range(1 << bits) if edge[b] < edge[b + 1]]
    return pa.table({"part": pa.array(has, pa.int32()), "counts": pa.array([counts[:, edge[b] : edge[b + 1]].tobytes() for b in has], pa.binary())})


def candidate_sets(docs: DataFrame, of: DataFrame, repeats: bool) -> DataFrame:
    """class, n, shingles (packed) of the classes in `of` (class, first: doc_id and digest): read from the text of one row each.

    `repeats`: some rows have doc_id and text in common; a class is then taken once from each task and once of all tasks.
    """

    def run(batches):
        seen = set()
        for batch, gram, doc, cut in shingle_sets(blocks(batches)):
            fresh = [c not in seen and not seen.add(c) for c in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(cut).astype(np.int64)), pa.array([gram[cut[i] : cut[i + 1]].tobytes() for i in range(batch.num_rows)], pa.binary())], ["class", "n", "shingles"]).filter(pa.array(fresh, pa.bool_()))

    wanted = of.select(F.col("class").alias("_class"), F.col("first.doc_id").alias("_id"), F.col("first.digest").alias("_digest"))
    texts = keyed(docs).where(F.col("digest").isNotNull())
    joined = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select(F.col("_class").alias("class"), "text")
    sets = joined.mapInArrow(run, "class bigint, n bigint, shingles binary")
    return sets.dropDuplicates(["class"]) if repeats else sets


SIGNED = "bucket int, keys binary, owner binary, classes binary, about binary, labels binary"


def emitted(sets: DataFrame, bits: int) -> DataFrame:
    """Rows of SIGNED: the signatures of `sets` (class, shingles, slots: a bit for each slot to sign in, and label) by bucket.

    `about` has of each owner 4 * its size + the slot it signs in, `labels` its label and how many classes have that label.
    """

    def run(batches):
        held, classes, wanted, labels, size = [], [], [], [], 0

        def flush():
            who, sig, slot, _ = signed(held)
            of = (np.array(wanted)[who] >> slot) & 1 == 1
            who, sig, slot = who[of], sig[of], slot[of]
            own = who.astype(np.int64) * 4 + slot
            order = np.lexsort((own, sig))
            own, sig = own[order], sig[order]
            keep = np.ones(len(sig), bool)
            keep[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
            own, sig = own[keep], sig[keep]
            bucket = (sig >> _U(64 - bits)).astype(np.int32)
            low = ((sig << _U(bits)) >> _U(32)).astype(np.uint32)
            table, label = np.array(classes, np.int64), np.array(labels, np.int64)
            about = 4 * np.repeat([len(h) for h in held], 4) + np.tile(np.arange(4), len(held))
            edge = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            rows: list[list] = [[] for _ in range(6)]
            for b in np.flatnonzero(edge[1:] > edge[:-1]):
                present, local = np.unique(own[edge[b] : edge[b + 1]], return_inverse=True)
                for column, value in zip(rows, (int(b), low[edge[b] : edge[b + 1]].tobytes(), local.astype(np.uint32 if len(present) > 65535 else np.uint16).tobytes(), table[present // 4].tobytes(), about[present].astype(np.int64).tobytes(), label[present // 4].tobytes()), strict=True):
                    column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int32(), *[pa.binary()] * 5), strict=True)], ["bucket", "keys", "owner", "classes", "about", "labels"])

        for batch in batches:
            for c, x, w, *g in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                classes.append(c)
                held.append(np.frombuffer(x.as_py(), _U))
                wanted.append(w)
                labels.append(g)
                size += len(held[-1])
                if size >= CHUNK // 4:
                    yield flush()
                    held, classes, wanted, labels, size = [], [], [], [], 0
        if held:
            yield flush()
        give_back()

    return sets.select("class", "shingles", "slots", "label", "alike").mapInArrow(run, SIGNED)


def entries(table: pa.Table, most: int | None = None):
    """(key, class, size, slot, label, classes of that label) of the signatures of a bucket, sorted by key and class.

    They come in ranges of keys of about `most` entries, so that a bucket is never unpacked whole; a key is never cut.
    """
    rows = []
    for k, o, c, a, g in zip(*(table.column(n) for n in ("keys", "owner", "classes", "about", "labels")), strict=True):
        own = np.frombuffer(c.as_buffer(), np.int64)
        at = np.frombuffer(o.as_buffer(), np.uint32 if len(own) > 65535 else np.uint16)
        rows.append((np.frombuffer(k.as_buffer(), np.uint32), at, own, np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(g.as_buffer(), np.int64).reshape(-1, 2)))
    n = max(1, -(-sum(len(r[0]) for r in rows) // (most or SLICE)))
    upto = (np.arange(n + 1, dtype=_U) << _U(32)) // _U(n)
    edge = [np.searchsorted(r[0], upto) for r in rows]  # the keys of a row are sorted
    for j in range(n):
        keys, classes, about, labels = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, 2), np.int64)]
        for (k, o, c, a, g), e in zip(rows, edge, strict=True):
            at = o[e[j] : e[j + 1]]
            keys.append(k[e[j] : e[j + 1]])
            classes.append(c[at])
            about.append(a[at])
            labels.append(g[at])
        key, cls, sizes, label = map(np.concatenate, (keys, classes, about, labels))
        order = np.lexsort((cls, key))
        key, cls, sizes, label = key[order], cls[order], sizes[order], label[order]
        yield key, cls, sizes // 4, (sizes % 4).astype(np.int8), label[:, 0], label[:, 1]


def summed(parts, keys: int) -> np.ndarray:
    """Columns of all `parts` (rows of int64, the first `keys` of which tell columns apart), the other rows added up."""
    held, least = [], 0
    for part in parts:
        held.append(part)
        if sum(h.shape[1] for h in held) > 2 * least + SLICE:
            held = [_summed(np.concatenate(held, axis=1), keys)]
            least = held[0].shape[1]
    return _summed(np.concatenate(held, axis=1), keys)


def _summed(rows: np.ndarray, keys: int) -> np.ndarray:
    rows = rows[:, np.lexsort(rows[:keys])]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:keys, 1:] != rows[:keys, :-1]).any(axis=0)
    at = np.flatnonzero(new)
    return np.concatenate([rows[:keys, at], np.add.reduceat(rows[keys:], at, axis=1) if len(at) else rows[keys:]])


def to_meet(na: np.ndarray, nb: np.ndarray, slot_a: np.ndarray, slot_b: np.ndarray, same_band: np.ndarray) -> np.ndarray:
    """Whether two sets of these sizes that sign in these slots can link and are to meet there."""
    low, high = np.minimum(na, nb), np.maximum(na, nb)
    inside = (slot_a == slot_b) & np.where(low <= TINY, slot_a == SINGLE, (slot_a == OWN) & same_band)
    across = (slot_a != slot_b) & np.isin(slot_a, (UPPER, LOWER)) & np.isin(slot_b, (UPPER, LOWER)) & (low > TINY)
    return (4 * low >= 3 * high) & (inside | across)


def hub_counts(key: np.ndarray, cls: np.ndarray, n: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sorted entries: (class, hub, their sizes, count) of the signatures that a class has in common with a hub.

    The hub of a signature is its least class of a slot; each class meets it once a signature, however many have that, so
    there are no more rows than entries.
    """
    first, size = groups(key)
    band = band_of(n)[0]
    out = [np.zeros((4, 0), np.int64)]
    for one, other in ((OWN, OWN), (SINGLE, SINGLE), (UPPER, LOWER)):
        least = np.minimum.reduceat(np.where(slot == one, np.arange(len(key)), len(key)), first) if len(key) else first
        hub = np.repeat(least, size)
        x = np.flatnonzero((slot == other) & (hub < len(key)))
        y = hub[x]
        ok = (cls[x] != cls[y]) & to_meet(n[x], n[y], slot[x], slot[y], band[x] == band[y])
        out.append(np.stack([cls[x[ok]], cls[y[ok]], n[x[ok]], n[y[ok]]]))
    rows = np.concatenate(out, axis=1)
    rows = rows[:, np.lexsort((rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    at = np.flatnonzero(new)
    return *rows[:, at], np.diff(np.append(at, rows.shape[1]))


def common_signatures(key: np.ndarray, cls: np.ndarray, n: np.ndarray, slot: np.ndarray, label: np.ndarray, alike: np.ndarray, frequent: int) -> tuple[np.ndarray, ...]:
    """Of sorted entries, as (class, label, whether the signatures are frequent, counts by slot): a class and a label not its
    own, with how many of its signatures in each slot, of at most `frequent` entries, some class of that label has and is to
    meet it; and how many of its signatures in each slot have more entries (label: its own).

    Of two labels the one of fewer classes is asked for (the greater of two such), always from the same side; so a class in
    a corner of a large group is one row, not one with each member.
    """
    first, size = groups(key)
    band = band_of(n)[0]
    out = [np.zeros((4, 0), np.int64)]
    for m in range(2, frequent + 1):
        of = first[size == m]
        i, j = np.triu_indices(m, 1)
        step = max(1, SLICE // len(i))
        for at in range(0, len(of), step):
            x = (of[at : at + step, None] + i).ravel()
            y = (of[at : at + step, None] + j).ravel()
            apart = (label[x] != label[y]) & (cls[x] != cls[y])
            x, y = x[apart], y[apart]
            ok = to_meet(n[x], n[y], slot[x], slot[y], band[x] == band[y])
            x, y = x[ok], y[ok]
            turn = (alike[x] > alike[y]) | ((alike[x] == alike[y]) & (label[x] < label[y]))
            x, y = np.where(turn, y, x), np.where(turn, x, y)
            met = np.stack([x, label[y]])  # x is an entry: one class, slot and signature
            met = met[:, np.lexsort(met)]
            new = np.ones(len(x), bool)
            new[1:] = (met[:, 1:] != met[:, :-1]).any(axis=0)
            x, to = met[:, new]
            out.append(np.stack([slot[x], cls[x], to, np.zeros_like(x)]))
    many = np.repeat(size > frequent, size)
    out.append(np.stack([slot[many], cls[many], label[many], np.ones(many.sum(), np.int64)]))
    rows = np.concatenate(out, axis=1)
    rows = rows[:, np.lexsort(rows)]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[1:, 1:] != rows[1:, :-1]).any(axis=0)
    at = np.flatnonzero(new)
    counts = np.bincount((np.cumsum(new) - 1) * 4 + rows[0], minlength=4 * len(at)).reshape(-1, 4)
    return *rows[1:, at], counts


def gathered(sets: DataFrame, bits: int, scratch: Scratch) -> DataFrame:
    """class, label: candidates of one label are connected by pairs that share as many parts as linked sets must.

    Only pairs of a class and a hub of one of its signatures are counted, so a group of near copies gives rows in proportion
    to its classes, not to its pairs. What the hubs do not bring together keeps labels apart, and is left to the pairs.
    """

    def meet(table: pa.Table) -> pa.Table:
        rows = summed((np.stack(hub_counts(*part[:4])) for part in entries(table)), 4)
        give_back()
        return pa.table({c: pa.array(x) for c, x in zip(("a", "b", "na", "nb", "n"), rows, strict=True)})

    def enough(batches):
        for batch in batches:
            na, nb, n = (batch.column(c).to_numpy() for c in (2, 3, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(n >= shared_parts(na, nb)))

    signs = emitted(sets.withColumn("slots", F.lit(15)).withColumn("label", F.col("class")).withColumn("alike", F.lit(1)), bits)
    counts = signs.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint, na bigint, nb bigint, n bigint")
    edges = counts.groupBy("a", "b", "na", "nb").agg(F.sum("n").alias("n")).mapInArrow(enough, "a bigint, b bigint")
    return components(edges, scratch, "gathered").select(F.col("node").alias("class"), F.col("root").alias("label"))


def candidate_links(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: edges that connect all classes that share as many parts as linked ones must, or are met by frequent signatures only.

    Classes that `gathered` brought together are linked with their label. Other pairs are counted as a class and the label of
    its partner, which shares no more with that class than all of the label do: rows grow with a group, not with its pairs. A
    signature of more than FREQUENT classes is not counted. `lost` are the parts in which a set has such a signature or an
    empty one: linked sets share `shared_parts`, of which at least shared_parts - min(lost) show up as common signatures (for a
    label of several classes: least_shared, and the most that one of them lost). Where that leaves none for both sets
    (lost >= least_shared), both are in `heavy`, whose signatures make stars, frequent or not, in the slots where it is so.
    """
    bits = max(3, bucket_bits_for(sets) - 3)
    labels = gathered(sets, bits, scratch)
    alike = labels.groupBy("label").agg(F.count(F.lit(1)).alias("alike"))
    labels = scratch.keep(labels.join(alike, "label").select("class", "label", "alike"), "labels")

    def match(table: pa.Table) -> pa.Table:
        found = (common_signatures(*part, FREQUENT) for part in entries(table))
        cls, label, many, *n = summed((np.stack([*keys, *counts.T]) for *keys, counts in found), 3)
        give_back()
        return pa.table({"class": pa.array(cls), "to": pa.array(label), "many": pa.array(many.astype(bool)), **{f"n{k}": pa.array(x) for k, x in enumerate(n)}})

    def bare(batches):
        for batch in batches:
            out = signed([np.frombuffer(x.as_py(), _U) for x in batch.column(2)])[3]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(out[:, k]) for k in range(4)]], ["class", "n", "e0", "e1", "e2", "e3"])

    labelled = sets.withColumn("slots", F.lit(15)).join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")).withColumn("alike", F.coalesce("alike", F.lit(1)))
    met = scratch.keep(emitted(labelled, bits).groupBy("bucket").applyInArrow(match, "class bigint, to bigint, many boolean, n0 bigint, n1 bigint, n2 bigint, n3 bigint"), "met")
    frequent = met.where("many").groupBy("class").agg(*[F.sum(f"n{k}").alias(f"f{k}") for k in range(4)])

    def losses(batches):
        for batch in batches:
            n = batch.column(1).to_numpy()
            lost = np.stack([batch.column(c).to_numpy() for c in (2, 3, 4, 5)], axis=1)
            heavy = ((lost >= least_shared(n)) << np.arange(4)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heavy.astype(np.int32))], [*batch.schema.names, "heavy"])

    empty = sets.select("class", "n", "shingles").mapInArrow(bare, "class bigint, n bigint, e0 bigint, e1 bigint, e2 bigint, e3 bigint")
    told = empty.join(frequent, "class", "left").join(labels, "class", "left")
    told = told.select("class", "n", *[(F.col(f"e{k}") + F.coalesce(f"f{k}", F.lit(0))).cast("bigint").alias(f"l{k}") for k in range(4)], F.coalesce("label", "class").alias("label"), F.coalesce("alike", F.lit(1)).cast("bigint").alias("alike"))
    lost = scratch.keep(told.mapInArrow(losses, "class bigint, n bigint, l0 bigint, l1 bigint, l2 bigint, l3 bigint, label bigint, alike bigint, heavy int"), "lost")

    def enough(batches):
        for batch in batches:
            na, nb, alike = (batch.column(c).to_numpy() for c in range(2, 5))
            n, la, lb = (np.stack([batch.column(c).to_numpy() for c in range(x, x + 4)], axis=1) for x in (5, 9, 13))
            must = np.where((alike == 1)[:, None], shared_parts(na, nb)[:, None], least_shared(na))
            ok = ((n > 0) & (n >= must - np.minimum(la, lb[:, PARTNER]))).any(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    counts = met.where("not many").groupBy("class", "to").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
    others = lost.groupBy(F.col("label").alias("to")).agg(F.max("n").alias("nb"), F.max("alike").alias("alike"), *[F.max(f"l{k}").alias(f"m{k}") for k in range(4)])
    both = counts.join(lost.drop("alike"), "class").join(others, "to")
    light = both.select("label", "to", F.col("n").alias("na"), "nb", "alike", *[f"{x}{k}" for x in "nlm" for k in range(4)]).mapInArrow(enough, "a bigint, b bigint").distinct()

    def star(table: pa.Table) -> pa.Table:
        edges = np.zeros((2, 0), np.int64)
        for key, _, _, slot, label, _ in entries(table):
            first, size = groups(key)
            found = [edges]
            for one, other in ((OWN, OWN), (SINGLE, SINGLE), (UPPER, LOWER), (LOWER, UPPER)):  # the first of a kind with all whom it may meet
                least = np.minimum.reduceat(np.where(slot == one, np.arange(len(key)), len(key)), first) if len(key) else first
                hub = np.repeat(least, size)
                ok = (slot == other) & (hub < len(key))
                found.append(np.stack([label[hub[ok]], label[ok]]))
            edges = np.stack(contracted(*np.concatenate(found, axis=1)))
        give_back()
        return pa.table({"a": pa.array(edges[0]), "b": pa.array(edges[1])})

    heavy = sets.join(lost.where("heavy > 0").select("class", F.col("heavy").alias("slots"), "label", "alike"), "class")
    own = labels.where(F.col("class") != F.col("label")).select(F.col("label").alias("a"), F.col("class").alias("b"))
    return own.union(light).union(emitted(heavy, bits).groupBy("bucket").applyInArrow(star, "a bigint, b bigint").distinct())


PACKS = "grp bigint, band int, sub int, classes binary, sizes binary, shingles binary"


def packs(sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """Rows of PACKS: the sets of each candidate group (node, root), cut by size band (ratio 1.15) and hash into packs."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        cls = np.array(table.column("class").to_pylist(), np.int64)
        n = np.array(table.column("n").to_pylist(), np.int64)
        row = [pa.array([k.as_py()], t) for k, t in zip(key, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
        blob = b"".join(x.as_py() for x in table.column("shingles"))
        return pa.table([*row, pa.array([cls.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([blob], pa.binary())], names=["grp", "band", "sub", "classes", "sizes", "shingles"])

    of = grouped.select(F.col("node").alias("class"), F.col("root").alias("grp"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.15))).cast("int")
    inside = sets.join(of, "class").withColumn("band", band)
    sizes = inside.groupBy("grp", "band").agg(F.ceil(F.greatest(F.count(F.lit(1)) / PACK, F.sum("n") / PACK_SHINGLES)).alias("_cuts"))
    cut = inside.join(sizes, ["grp", "band"]).withColumn("sub", F.pmod(F.xxhash64("class"), F.col("_cuts")).cast("int"))
    # dealt anew by pack: the counts left the rows dealt by group and band, where one group may be most of the table
    return cut.select("class", "n", "shingles", "grp", "band", "sub").repartition("grp", "band", "sub").groupBy("grp", "band", "sub").applyInArrow(run, PACKS)


def forest(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Links between the sets of two packs (classes, sizes, elements), as a spanning forest."""
    (ca, na, ea), (cb, nb, eb) = a, b
    wa, wb = np.repeat(np.arange(len(ca)), na), np.repeat(np.arange(len(cb)), nb)
    shared = np.intersect1d(ea, eb)
    if len(shared) == 0:
        return []
    ia, ib = np.searchsorted(shared, ea), np.searchsorted(shared, eb)
    oka = shared[np.minimum(ia, len(shared) - 1)] == ea
    okb = shared[np.minimum(ib, len(shared) - 1)] == eb
    both = np.zeros((len(ca), len(cb)), np.int64)
    for at in range(0, len(shared), 1 << 13):  # incidence matrices, a slice of the elements at a time
        to = min(at + (1 << 13), len(shared))
        ma, mb = oka & (ia >= at) & (ia < to), okb & (ib >= at) & (ib < to)
        x = np.zeros((len(ca), to - at), np.float32)
        y = np.zeros((len(cb), to - at), np.float32)
        x[wa[ma], ia[ma] - at] = 1
        y[wb[mb], ib[mb] - at] = 1
        both += np.rint(x @ y.T).astype(np.int64)
    link = 100 * both >= 75 * (na[:, None] + nb[None, :] - both)
    i, j = np.nonzero(link)
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for u, v in zip(ca[i].tolist(), cb[j].tolist(), strict=True):
        p, q = find(u), find(v)
        if p != q:
            root[p] = q
            out.append((min(u, v), max(u, v)))
    return out


def links_within(made: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the links within and between the packs of each group."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                cell = [np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in enumerate((np.int64, np.int64, _U) * 2)]
                rows += forest(tuple(cell[:3]), tuple(cell[3:]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64())], ["a", "b"])

    # A group of many packs is dealt out by tiles of about TILE x TILE packs: a pair of packs meets in one tile, whichever comes first.
    wide = made.groupBy("grp").agg(F.count(F.lit(1)).alias("_packs")).where(F.col("_packs") > TILE)
    dealt = made.join(wide, "grp", "left").withColumn("_side", F.coalesce(F.ceil(F.col("_packs") / TILE), F.lit(1)).cast("int"))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("band", "sub"), F.col("_side")).cast("int")).withColumn("_other", F.explode(F.expr("sequence(0, _side - 1)")))
    side = lambda n, row, column: dealt.select("grp", F.col(row).alias("_row"), F.col(column).alias("_column"), *[F.col(c).alias(f"{c}{n}") for c in ("band", "sub", "classes", "sizes", "shingles")])
    near = (F.col("band2") <= F.col("band1") + 3) & ((F.col("band1") < F.col("band2")) | ((F.col("band1") == F.col("band2")) & (F.col("sub1") <= F.col("sub2"))))
    pairs = side(1, "_own", "_other").join(side(2, "_other", "_own"), ["grp", "_row", "_column"]).where(near)
    return pairs.select("classes1", "sizes1", "shingles1", "classes2", "sizes2", "shingles2").mapInArrow(run, "a bigint, b bigint")


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the edges (a, b) connect, each from the smallest node of its group: one fewer than nodes."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(node))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    has = np.flatnonzero(root != np.arange(len(node)))
    return node[root[has]], node[has]


def contracted_by_task(edges: DataFrame) -> DataFrame:
    """a, b: what a task holds of `edges`, contracted, so that it is no more than its nodes, however dense the groups are."""

    def run(batches):
        held, size = [np.zeros((2, 0), np.int64)], 0
        for batch in batches:
            held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
            size += batch.num_rows
            if size >= CHUNK:
                held = [np.stack(contracted(*np.concatenate(held, axis=1)))]
                size = 0
        a, b = contracted(*np.concatenate(held, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root (smallest node reachable) for the nodes of `edges` (a, b): minimum labels with pointer jumping.

    Each step writes its labels to the shared folder; steps grow with the logarithm of a group's diameter.
    """
    edges = contracted_by_task(edges)
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("root").alias("low"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = labels.join(near, "node").join(jump, "root", "left").select("node", F.least("root", "low", F.coalesce("far", "root")).alias("root"), F.col("root").alias("was"))
        kept = scratch.keep(new, f"{name}-{step}")
        moved = kept.where(F.col("root") != F.col("was")).limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        labels = kept.select("node", "root")
        if not moved:
            return labels


def standing() -> Column:
    """Of two rows of a group the one with the smaller doc_id stands first (none: last), then the one with the smaller digest."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("digest"))


class Groups:
    """What the join finds: `rows` (MEMBERS) of every document, `classes` with their first row, and each class's group `root`."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        scratch = self.scratch = Scratch(spark, "partenum")
        with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}):  # a row holds a text or a set
            self._find(docs, scratch)

    def _find(self, docs: DataFrame, scratch: Scratch) -> None:
        spark = docs.sparkSession
        self.rows = rows = scratch.keep(members(docs), "members")
        self.repeats = not rows.groupBy("doc_id", "digest").count().where("count > 1").isEmpty()
        classes = scratch.keep(rows.where("class <> 0").groupBy("class").agg(F.min(standing()).alias("first"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("n_copies")), "classes")
        likely = classes.join(shared_shingles(docs), "class").where(4 * F.col("n_shared") >= 3 * F.col("n_shingles")).select("class", "first", "n_shingles")
        sets = scratch.keep(candidate_sets(docs, likely, self.repeats), "sets")
        stars = scratch.keep(candidate_links(sets, scratch), "stars")
        scratch.drop("met")
        grouped = components(stars, scratch, "candidates")
        made = scratch.keep(packs(sets, grouped), "packs")
        with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "8"}):  # a row holds two packs
            links = scratch.keep(links_within(made).distinct(), "links")
        scratch.drop("packs")
        roots = components(links, scratch, "groups")
        self.classes = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies of every row of `docs` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that links reach, itself included; n_copies the rows with the same shingle set.
    Words are lower-cased (A-Z) runs of non-blank characters; fewer than five words are one shingle; a null or empty text
    has none and links with nothing. Rows that repeat link with each other; rows without a doc_id link as any other and
    have no component_id only where their whole group has none. An empty table gives an empty result.
    """
    found = Groups(docs)
    least = found.classes.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    named = found.classes.join(least, "root").select("class", "component_id", "n_copies")
    out = found.rows.join(named, "class", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` (any columns) without near copies: of each group the row that stands first by (doc_id, MD5 of the text) stays.

    It is decided row by row: rows that share a doc_id but not their text are documents of their own. Of rows that have
    doc_id and text in common one stays (the smallest hash of the other columns). Rows without a word are in no group and
    all stay. An empty table stays empty.
    """
    found = Groups(docs)
    best = found.classes.groupBy("root").agg(F.min("first").alias("first"))
    first = best.select(F.col("first.doc_id").alias("__dedup_id"), F.col("first.digest").alias("__dedup_digest"))
    names = docs.columns
    text = F.col("text").cast("string")
    tagged = docs.withColumn("__dedup_key", F.unhex(F.md5(text.cast("binary"))))
    bare = docs.where(F.coalesce(~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__dedup_id")) & (F.col("__dedup_key") == F.col("__dedup_digest"))
    kept = tagged.join(first, same, "left_semi")
    if found.repeats:
        other = [F.xxhash64(c) for c, t in docs.dtypes if "map<" not in t and "variant" not in t]
        kept = kept.groupBy("doc_id", "__dedup_key").agg(F.min_by(F.struct(*[F.col(c) for c in names]), F.struct(*other)).alias("__dedup_row"))
        kept = kept.select(*[F.col(f"__dedup_row.`{c}`").alias(c) for c in names])
    return kept.select(*names).unionByName(bare)
