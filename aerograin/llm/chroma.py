"""Fingerprints of audio columns from chroma frames, and their alignment.

A recording (mono 16-bit WAV) becomes frames of 12 pitch classes: energy of a short-time spectrum folded onto the octave.
Over every WIDTH frames 16 filters compare sums of two regions of the (time, pitch class) image, read from its integral
image; each log ratio is quantised to 2 bits (Gray code), 32 bits in all: one packed integer a frame.
Candidates share one packed integer, which is all that alignment needs: every pair that aligns is found. Recordings travel in
packed blocks; a block of queries meets every block of recordings, so no integer, however common, makes rows of pairs.
Two recordings are aligned by a histogram of the offsets at which equal integers stand; at the best offset the share of
differing bits over the overlap decides.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, ship

RATE = 2000
FRAME = 512
HOP = 64
WIDTH = 16
CLASSES = 12
LOWEST, HIGHEST = 65.0, 900.0
STEPS = (-0.25, 0.0, 0.25)
LEAST_OVERLAP = 24
MOST_ERROR = 0.2

#: Frames of a block of queries and of a block of recordings, and equal integers that are looked at together.
ASKED_FRAMES, BLOCK_FRAMES, AT_ONCE = 1 << 15, 1 << 18, 1 << 21

FINGERPRINTS = "id bigint, frames array<int>"
PACKED = "ids binary, lengths binary, frames binary"


def filters() -> list[tuple[tuple[int, int, int, int], tuple[int, int, int, int]]]:
    """16 pairs of regions (frame from, to, class from, to) in a WIDTH x 12 window.

    By rule: for each of four bands of three classes, the first half against the second in time, the band against the one
    six classes on, its outer classes against its middle one, and the middle of the window against its ends.
    """
    out = []
    half, quarter = WIDTH // 2, WIDTH // 4
    for band in range(4):
        a, b = 3 * band, 3 * band + 3
        c = 3 * ((band + 2) % 4)
        out.append(((0, half, a, b), (half, WIDTH, a, b)))
        out.append(((0, WIDTH, a, b), (0, WIDTH, c, c + 3)))
        out.append(((0, WIDTH, a, a + 1), (0, WIDTH, a + 1, a + 2)))
        out.append(((quarter, WIDTH - quarter, a, b), (0, quarter, a, b)))
    return out


FILTERS = filters()
_GRAY = np.array([0, 1, 3, 2], np.uint32)


def _fold() -> np.ndarray:
    """Spectrum bins x pitch classes, 1 where a bin's frequency is nearest to a pitch of the class."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    fold = np.zeros((len(hz), CLASSES), np.float32)
    ok = (hz >= LOWEST) & (hz <= HIGHEST)
    fold[np.flatnonzero(ok), np.rint(12 * np.log2(hz[ok] / 440.0)).astype(int) % 12] = 1
    return fold


_FOLD, _WINDOW = _fold(), np.hanning(FRAME).astype(np.float32)


def samples(data: bytes | None) -> np.ndarray:
    """PCM of a WAV file at RATE; nothing for null, empty or damaged bytes and for other formats."""
    if not data:
        return np.zeros(0, np.float32)
    try:
        with wave.open(io.BytesIO(data)) as f:
            if (f.getnchannels(), f.getsampwidth()) != (1, 2):
                return np.zeros(0, np.float32)
            rate, pcm = f.getframerate(), np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float32) / 32768
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32)
    if rate != RATE and len(pcm):
        pcm = np.interp(np.arange(0, len(pcm), rate / RATE), np.arange(len(pcm)), pcm).astype(np.float32)
    return pcm


def chroma(pcm: np.ndarray) -> np.ndarray:
    """Frames x 12, each frame divided by its norm."""
    if len(pcm) < FRAME:
        return np.zeros((0, CLASSES), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(pcm, FRAME)[::HOP]
    energy = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32) ** 2 @ _FOLD
    return energy / np.maximum(np.linalg.norm(energy, axis=1, keepdims=True), 1e-6)


def packed(image: np.ndarray) -> np.ndarray:
    """One 32-bit integer for each window of WIDTH frames, all windows at once from the integral image."""
    n = len(image) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = np.zeros((len(image) + 1, CLASSES + 1), np.float64)
    total[1:, 1:] = image.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    at = np.arange(n)

    def area(r: tuple[int, int, int, int]) -> np.ndarray:
        t0, t1, c0, c1 = r
        return (total[at + t1, c1] - total[at + t0, c1] - total[at + t1, c0] + total[at + t0, c0]) / ((t1 - t0) * (c1 - c0))

    out = np.zeros(n, np.uint32)
    for a, b in FILTERS:
        value = np.log((area(a) + 0.01) / (area(b) + 0.01))
        out = out << np.uint32(2) | _GRAY[np.digitize(value, STEPS)]
    return out


def listed(frames: np.ndarray) -> np.ndarray:
    """Distinct integers of a recording: two recordings are candidates if they share one."""
    return np.unique(frames)


def fingerprints(media: DataFrame, id_column: str, audio_column: str, decode=samples) -> DataFrame:
    """id and frames (packed integers, as signed ints) of every row; audio that is null, damaged or too short gives none.

    `decode` turns a value of the column into samples at RATE; the default reads WAV bytes.
    """
    ship(media.sparkSession)

    def run(batches):
        from aerograin.llm import chroma as own

        def column(parts: list, kind: pa.DataType) -> pa.Array:
            ends = np.cumsum([0] + [len(p) for p in parts])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), kind))

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [own.packed(own.chroma(decode(x.as_py()))) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), column([m.view(np.int32) for m in made], pa.int32())], ["id", "frames"])

    return media.select(F.col(id_column).cast("bigint").alias("id"), F.col(audio_column).alias("audio")).mapInArrow(run, FINGERPRINTS)


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    """(offset of b against a, share of differing bits) at the offset most equal integers agree on; ties to the smallest."""
    order = np.argsort(b, kind="stable")
    sb = b[order]
    lo, hi = np.searchsorted(sb, a, "left"), np.searchsorted(sb, a, "right")
    n = hi - lo
    if not n.sum():
        return 0, 1.0
    ia = np.repeat(np.arange(len(a)), n)
    first = np.repeat(np.cumsum(n) - n, n)
    ib = order[np.arange(int(n.sum())) - first + np.repeat(lo, n)]
    shift = ib - ia
    best = int(np.bincount(shift + len(a)).argmax()) - len(a)
    from_, to = max(0, -best), min(len(a), len(b) - best)
    if to - from_ < LEAST_OVERLAP:
        return best, 1.0
    differing = np.bitwise_count(a[from_:to].view(np.uint32) ^ b[from_ + best : to + best].view(np.uint32)).sum()
    return best, float(differing) / (32 * (to - from_))


def align_blocks(ids_a: np.ndarray, lengths_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, lengths_b: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id of a, id of b, offset, error) of all pairs of different recordings of two blocks that align, as aligned() has them."""
    start_a, start_b = np.cumsum(lengths_a) - lengths_a, np.cumsum(lengths_b) - lengths_b
    owner_a, owner_b = np.repeat(np.arange(len(ids_a)), lengths_a), np.repeat(np.arange(len(ids_b)), lengths_b)
    order = np.argsort(a, kind="stable")
    sa = a[order]
    lo = np.searchsorted(sa, b, "left")
    n = np.searchsorted(sa, b, "right") - lo
    equal = np.add.reduceat(n, start_b) if len(start_b) else n
    found = []

    def together(from_: int, to: int) -> None:
        """Recordings from_ to `to` of the second block, all their equal integers at once."""
        span = slice(start_b[from_], start_b[to - 1] + lengths_b[to - 1])
        m = n[span]
        if not m.sum():
            return
        ib = np.repeat(np.arange(span.start, span.stop), m)
        ia = order[np.arange(len(ib)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[span], m)]
        pa_, pb = owner_a[ia], owner_b[ib]
        shift = (ib - start_b[pb]) - (ia - start_a[pa_])
        wide = int(np.abs(shift).max()) + 1
        key, count = np.unique((pa_ * np.int64(to - from_) + (pb - from_)) * np.int64(2 * wide) + shift + wide, return_counts=True)
        pair = key // (2 * wide)
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        most = np.maximum.reduceat(count, first)
        top = np.flatnonzero(count == np.repeat(most, np.diff(np.r_[first, len(pair)])))
        top = top[np.r_[True, pair[top][1:] != pair[top][:-1]]]  # ties to the smallest offset
        x, y, best = pair[top] // (to - from_), pair[top] % (to - from_) + from_, key[top] % (2 * wide) - wide
        begin, end = np.maximum(0, -best), np.minimum(lengths_a[x], lengths_b[y] - best)
        ok = (end - begin >= LEAST_OVERLAP) & (ids_a[x] != ids_b[y])
        x, y, best, begin, overlap = x[ok], y[ok], best[ok], begin[ok], (end - begin)[ok]
        ends = np.cumsum(overlap)
        for i, j in _cuts(overlap, AT_ONCE):
            w, total = overlap[i:j], ends[i:j] - (ends[i - 1] if i else 0)
            at = np.arange(int(total[-1])) - np.repeat(total - w, w)
            bits = np.bitwise_count(a[at + np.repeat(start_a[x[i:j]] + begin[i:j], w)].view(np.uint32) ^ b[at + np.repeat(start_b[y[i:j]] + begin[i:j] + best[i:j], w)].view(np.uint32))
            error = np.add.reduceat(bits.astype(np.int64), total - w) / (32 * w)
            keep = error <= MOST_ERROR
            found.append((ids_a[x[i:j]][keep], ids_b[y[i:j]][keep], best[i:j][keep], error[keep]))

    for i, j in _cuts(equal, AT_ONCE):
        if j - i > 1 or equal[i] <= AT_ONCE:
            together(i, j)
            continue
        one = b[start_b[i] : start_b[i] + lengths_b[i]]
        for k in range(len(ids_a)):  # a long recording of few integers: pair by pair
            other = a[start_a[k] : start_a[k] + lengths_a[k]]
            if ids_a[k] != ids_b[i] and len(np.intersect1d(listed(other), listed(one))):
                best, error = aligned(other, one)
                if error <= MOST_ERROR:
                    found.append((ids_a[k : k + 1], ids_b[i : i + 1], np.array([best]), np.array([error])))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Neighbouring items in runs of a size of at most `most`, or of one item."""
    out, begin, total = [], 0, 0
    for i, x in enumerate(sizes.tolist()):
        if i > begin and total + x > most:
            out.append((begin, i))
            begin, total = i, 0
        total += x
    return [*out, (begin, len(sizes))] if len(sizes) else out


def packed_blocks(classes: DataFrame, most: int) -> DataFrame:
    """Rows of PACKED with `block`: recordings (class_id, frames) side by side, about `most` frames a row."""

    def run(batches):
        ids, frames, size = [], [], 0

        def row():
            data = [np.array(ids, np.int64).tobytes(), np.array([len(f) for f in frames], np.int64).tobytes(), np.concatenate(frames).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in data], ["ids", "lengths", "frames"])

        for batch in batches:
            for i, f in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = f.values.to_numpy(zero_copy_only=False).astype(np.int32)
                if ids and size + len(f) > most:
                    yield row()
                    ids, frames, size = [], [], 0
                ids.append(i)
                frames.append(f)
                size += len(f)
        if ids:
            yield row()

    return classes.select("class_id", "frames").mapInArrow(run, PACKED).withColumn("block", F.monotonically_increasing_id())


def search(prints: DataFrame, is_query) -> DataFrame:
    """id, class_id, match_class_id, offset_frames, bit_error: a row for every recording with its class (the smallest id with the
    same fingerprint; match null), and a row for every pair (class of a query, other class) that aligns.

    Every packed block of query classes is dealt to a task with every block of classes; copies are one class, so a recording
    in a third of the rows is one there. Recordings without frames are classes of their own and match nothing. Rows that
    repeat an id give a row each; an empty table gives an empty result; columns other than id and frames are not read.
    """
    scratch = Scratch(prints.sparkSession, "chroma")
    rows = scratch.keep(prints.withColumn("key", F.when(F.size("frames") > 0, F.sha2(F.to_json("frames").cast("binary"), 256))), "prints")
    classes = rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("class_id"), F.max(is_query(F.col("id"))).alias("asked"), F.first("frames").alias("frames"))
    classes = scratch.keep(classes, "classes")
    asked = scratch.keep(packed_blocks(classes.where("asked"), ASKED_FRAMES), "asked")
    every = scratch.keep(packed_blocks(classes, BLOCK_FRAMES), "blocks")
    left = asked.select(*[F.col(c).alias(f"{c}_a") for c in ("block", "ids", "lengths", "frames")])
    deal = left.select("block_a").crossJoin(every.select("block"))
    both = deal.join(left, "block_a").join(every, "block").select("ids_a", "lengths_a", "frames_a", "ids", "lengths", "frames")

    def run(batches):
        from aerograin.llm import chroma as own

        for batch in batches:
            for i in range(batch.num_rows):
                x = [np.frombuffer(batch.column(k)[i].as_buffer(), np.int32 if k % 3 == 2 else np.int64) for k in range(6)]
                got = own.align_blocks(*x)
                yield pa.RecordBatch.from_arrays([pa.array(g, t) for g, t in zip(got, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["a", "b", "offset", "error"])

    found = both.mapInArrow(run, "a bigint, b bigint, offset int, error double")
    none = F.lit(None)
    member = rows.join(classes.select("key", "class_id"), "key", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), none.cast("bigint").alias("match_class_id"), none.cast("int").alias("offset_frames"), none.cast("double").alias("bit_error"))
    return member.union(found.select("a", F.col("a").alias("c"), "b", "offset", "error"))


def render(vector: list | None) -> bytes | None:
    """A recording for a vector, since the tables hold none: a WAV file of notes of an eighth of a second, one for two entries.

    Note i sounds the pitch that vector entry 2i picks and, softer, the one entry 2i+1 picks (0 after a last odd entry).
    Every entry counts. An empty or null vector, and one with a null in it, gives null.
    """
    if not vector or any(x is None for x in vector):
        return None
    v = np.append(np.array(vector, np.float64), np.zeros(len(vector) % 2))
    notes = len(v) // 2
    spread = max(float(np.abs(v).max()), 1e-9)
    step = np.rint(12 * (v / spread + 1)).astype(int)  # 0 to 24 half tones over 130.8 Hz
    n = RATE // 8
    t = np.arange(notes * n) / RATE
    hz = 130.8 * 2.0 ** (step / 12.0)
    tone = 0.6 * np.sin(2 * np.pi * np.repeat(hz[0::2], n) * t) + 0.3 * np.sin(2 * np.pi * np.repeat(hz[1::2], n) * t)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes((tone * 30000).astype("<i2").tobytes())
    return out.getvalue()


def rendered(vector: list | None) -> np.ndarray:
    """Samples of the recording of a vector: written as WAV and read back."""
    return samples(render(vector))
