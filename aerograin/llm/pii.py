"""Personal data by pattern and by a semi-Markov conditional random field.

The base kinds (email, ip, card, phone) are found by pattern and check. The field then reads zones: runs of words that hold
a digit or an @, and addresses with a written-out "at" or "dot", cut into atoms (digits, letters, single other characters).
Everything outside zones can hold no entity, so the field falls apart into them exactly. A zone's labelling is a row of
segments; a segment of kind k over atoms i..j has score w_k . f(i, j), with features of the whole span (how many digits,
does Luhn hold, octets, lengths of digit groups, separators, form, neighbours, the word before); an atom outside entities
scores 0. Entities have at most MOST atoms. Forward-backward over segments gives the likelihood for training; Viterbi over
segments gives boundaries and kinds together.

Training: labelled zones of two kinds. Zones of a bounded sample of documents (SAMPLE_DOCS, SAMPLE_ZONES, zones of at most
MOST_ZONE characters), labelled by the base kinds; and written examples (EXAMPLES, from a seed) of what the patterns miss:
local and dotted phone numbers, cards with other separators, spaced or bracketed addresses of both sorts, beside dates,
versions, amounts, serial numbers and such that are none. The base spans stay as they are; what the field finds is added.
"""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

KINDS = ("email", "ip", "card", "phone")
MOST = 24
SAMPLE_DOCS = 4000
SAMPLE_ZONES = 3000
MOST_ZONE = 400
EXAMPLES = 4000
EPOCHS = 5

SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>"

# The patterns of the base kinds.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DOTTED = re.compile(r"[0-9]\.[0-9]")
_LONG = re.compile(r"[0-9](?:[\x20-]?[0-9]){12}")
_TRIGGER = re.compile(r"[0-9@]")
_ZONE = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*(?:\x20{1,2}(?:[-./@]\x20)?[^\s0-9@]*+[0-9@]\S*)*")
_AT, _DOT = r"(?:\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?)", r"(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20)"
_HOST = r"[A-Za-z0-9-]{1,64}"
_WRITTEN = re.compile(rf"[A-Za-z0-9._%+-]{{1,64}}(?:(?:{_AT}|\x20@\x20){_HOST}(?:(?:{_DOT}|\.){_HOST}){{1,4}}|\x20(?:at|AT)\x20{_HOST}(?:{_DOT}{_HOST}){{1,4}})")
_WRITTEN_HINT = re.compile(r"[\[({<]\x20?(?:at|@)|\x20@\x20|\x20dot\x20", re.I)
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
_DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def octet(part: str) -> bool:
    short = part.lstrip("0") or "0"
    return len(short) <= 3 and int(short) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = []
    if "@" in text:
        # An address needs a character before the @: only stretches around an @ are looked at, each once.
        out += [(0, m.start(), m.end()) for m in _emails(text)]
    if _DOTTED.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(octet, m[0].split(".")))]
    if _LONG.search(text):
        for m in CARD.finditer(text):
            digits = _DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")


def _emails(text: str):
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isascii() and (text[begin - 1].isalnum() or text[begin - 1] in "._%+-")):
            begin -= 1
        m = EMAIL.match(text, begin) if begin < at else None
        if m:
            yield m
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


#: What the word before a span may say of it.
CUES = ({"mail", "email", "e-mail", "contact", "write"}, {"tel", "phone", "call", "fax", "mobile", "cell", "ring"}, {"card", "visa", "amex", "mastercard", "pay"}, {"ip", "host", "server", "address", "node"}, {"no", "nr", "order", "version", "isbn", "id", "serial", "invoice", "part", "article", "v", "page", "on", "since", "total"})
_LAST_WORD = re.compile(r"([A-Za-z-]+)[^A-Za-z0-9]{0,3}\Z")
_OUTSIDE = re.compile(r"[0-9A-Za-z]+")
CONTEXT = 24
WIDTH = 95
_MAIL_CHARS = frozenset("da._%+- @()[]{}<>")
_GLUE = (" ", "-", ".", "/", "(", "[", ",")


def cue(before: str) -> int:
    m = _LAST_WORD.search(before)
    return next((1 + i for i, c in enumerate(CUES) if m[1].lower() in c), 0) if m else 0


class Zone:
    """Atoms of one zone of the text `full` and the features of its segments."""

    def __init__(self, start: int, end: int, full: str):
        self.start, self.text = start, full[start:end]
        spans = [(m.start(), m.end()) for m in _ATOM.finditer(self.text)]
        self.at = [a for a, _ in spans] + [len(self.text)]
        self.before, self.after = full[max(0, start - CONTEXT) : start], full[end : end + 1] or " "
        self.kind = ["d" if self.text[a].isdigit() and self.text[a].isascii() else "a" if self.text[a].isascii() and self.text[a].isalpha() else self.text[a] for a, _ in spans]

    def __len__(self) -> int:
        return len(self.kind)

    def segments(self):
        """(i, j, kind number, features) of every candidate; what a kind can never be is no candidate."""
        n = len(self.kind)
        for i in range(n):
            first = self.kind[i]
            if first not in "da._%+(":
                continue
            digits, letters, ats, commas = 0, False, 0, False
            for j in range(i + 1, min(n, i + MOST) + 1):
                k = self.kind[j - 1]
                if k == "d":
                    digits += self.at[j] - self.at[j - 1]
                elif k == "a":
                    letters = True
                    ats += self.text[self.at[j - 1] : self.at[j]].lower() == "at" and j - 1 > i
                elif k == "@":
                    ats += 1
                elif k not in _MAIL_CHARS and k != "/":
                    break
                commas |= k == "/"
                if k not in "da" or (first in "._%" and not ats):
                    continue
                if ats:
                    if ats == 1 and first in "da._%+-" and k == "a" and not commas:
                        yield i, j, 0, self._features(i, j)
                    continue
                if letters or k != "d" or digits > 19:
                    continue
                groups = sum(x == "d" for x in self.kind[i:j])
                if first == "d" and groups == 4 and digits <= 12 and all(x in "d .[](){}" for x in self.kind[i:j]):
                    yield i, j, 1, self._features(i, j)
                if first == "d" and digits >= 12 and all(x in "d -./" for x in self.kind[i:j]):
                    yield i, j, 2, self._features(i, j)
                if first in "d+(" and 7 <= digits <= 15 and all(x in "d +()-./" for x in self.kind[i:j]):
                    yield i, j, 3, self._features(i, j)

    def _features(self, i: int, j: int) -> list[int]:
        span = self.text[self.at[i] : self.at[j]]
        lead = self.before + self.text[: self.at[i]]
        left, right = lead[-1:] or " ", self.text[self.at[j]] if j < len(self.kind) else self.after
        groups = re.findall(r"[0-9]+", span)
        sizes = [len(g) for g in groups]
        digits = "".join(groups)
        nd, low = len(digits), span.lower()
        glue = set(_OUTSIDE.sub("", span))
        gaps = [g for g in _OUTSIDE.split(span) if g]
        last = re.search(r"[A-Za-z]*\Z", span)[0]
        f = [0, 1 + min(nd, 20)]
        f.append(22 + (13 <= nd <= 19 and luhn(digits)))
        f.append(24 + (span[0] == "+") + 2 * ("(" in span and ")" in span))
        f.append(28 + min(span.count("."), 4))
        f.append(33 + ("@" in span) + 2 * bool(re.search(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$", span)))
        f.append(37 + (len(groups) == 4 and all(octet(p) for p in groups)))
        f.append(39 + (left.isalnum() or left in "._%+-@") + 2 * (right.isalnum() or right in "@_%"))
        f.append(43 + bool(re.search(r"[ .()-]{3}|--|\.\.", span)))
        f.append(45 + min(len(groups), 6))
        f.append(52 + (len(groups) >= 2 and sizes[-2:] == [3, 4]))
        f.append(54 + (len(groups) >= 2 and all(g == 4 for g in sizes)))
        f.append(56 + bool(re.search(r"(?<![a-z])at(?![a-z])", low)))
        f.append(58 + bool(re.search(r"[\[({<] ?(?:at|@)", low)))
        f.append(60 + bool(re.search(r"(?<![a-z])dot(?![a-z])", low)))
        f.append(62 + (0 if 2 <= len(last) <= 3 else 1 if 4 <= len(last) <= 6 else 2))
        f += [65 + x for x, c in enumerate(_GLUE) if c in glue]
        f.append(72 + min(len(glue), 3))
        shape = 0 if sizes[-3:] == [3, 3, 4] else 1 if sizes == [4, 4, 4, 4] else 2 if len(sizes) == 4 and max(sizes) <= 3 else 3 if sizes and max(sizes) <= 2 else 4 if sizes in ([4, 2, 2], [2, 2, 4]) else 5 if len(sizes) == 1 else 6
        f.append(76 + shape)
        f.append(83 + cue(lead[-CONTEXT:]))
        f.append(89 + digits.startswith("0"))
        f.append(91 + (len(gaps) > 1 and len(set(gaps)) == 1))
        f.append(93 + (last.lower() in ("at", "dot")))
        return f


def zones(text: str):
    """The zones of a text in order; what overlaps is one."""
    found = [(m.start(), m.end()) for m in _ZONE.finditer(text)] if _TRIGGER.search(text) else []
    if _WRITTEN_HINT.search(text):
        found = sorted(found + [(m.start(), m.end()) for m in _WRITTEN.finditer(text)])
    at = 0
    while at < len(found):
        start, end = found[at]
        at += 1
        while at < len(found) and found[at][0] < end:
            end = max(end, found[at][1])
            at += 1
        yield Zone(start, end, text)


def decode(z: Zone, w: np.ndarray) -> list[tuple[int, int, int]]:
    """The best labelling: (kind number, start, end) in the text. Ties go to fewer entities, then to the earlier kind."""
    n = len(z)
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    by_end: dict[int, list] = {}
    for i, j, k, f in z.segments():
        s = float(w[k, f].sum())
        if s > 0:
            by_end.setdefault(j, []).append((i, k, s))
    if not by_end:
        return []
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, s in by_end.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, k)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, k = back[j]
            out.append((k, z.start + z.at[i], z.start + z.at[j]))
            j = i
    return out[::-1]


def expected(n: int, segments: list, scores: list[float]) -> tuple[float, list[float]]:
    """(log of the sum over all labellings, probability of each segment), by forward-backward over segments."""
    fwd, bwd = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
    ends, starts = {}, {}
    for (i, j, _, _), s in zip(segments, scores, strict=True):
        ends.setdefault(j, []).append((i, s))
        starts.setdefault(i, []).append((j, s))
    fwd[0] = bwd[n] = 0.0
    for j in range(1, n + 1):
        v = [fwd[j - 1], *(fwd[i] + x for i, x in ends.get(j, ()))]
        top = max(v)
        fwd[j] = top + math.log(sum(math.exp(x - top) for x in v))
    for i in range(n - 1, -1, -1):
        v = [bwd[i + 1], *(bwd[j] + x for j, x in starts.get(i, ()))]
        top = max(v)
        bwd[i] = top + math.log(sum(math.exp(x - top) for x in v))
    return fwd[n], [math.exp(min(0.0, fwd[i] + s + bwd[j] - fwd[n])) for (i, j, _, _), s in zip(segments, scores, strict=True)]


def fit(samples: list[tuple[Zone, list[tuple[int, int, int]]]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (kinds x WIDTH) by AdaGrad on the conditional log-likelihood, gradients by forward-backward over segments."""
    w, g2 = np.zeros((len(KINDS), WIDTH)), np.full((len(KINDS), WIDTH), 1e-3)
    w[:, 0] = -2.0
    ready = []
    for z, gold in samples:
        at = {p: i for i, p in enumerate(z.at)}
        want = {(at.get(s - z.start), at.get(e - z.start), k) for k, s, e in gold}
        segments = list(z.segments())
        if segments and len(z.text) <= MOST_ZONE:
            ready.append((len(z), segments, [(i, j, k) in want for i, j, k, _ in segments]))
    for _ in range(epochs):
        for n, segments, gold in ready:
            grad: dict[int, np.ndarray] = {}
            _, chance = expected(n, segments, [float(w[k, f].sum()) for _, _, k, f in segments])
            for (_, _, k, f), right, p in zip(segments, gold, chance, strict=True):
                d = float(right) - p
                if abs(d) > 1e-4:
                    grad.setdefault(k, np.zeros(WIDTH))[f] += d
            for k, g in grad.items():
                g -= 1e-4 * w[k]
                g2[k] += g * g
                w[k] += 0.3 * g / np.sqrt(g2[k])
    return w


def example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A written text with one span that the patterns miss, labelled, or with something that is no personal data."""
    some = lambda n: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: some(rng.randrange(2, 9))
    kind, text = rng.randrange(8), ""
    if kind == 0:
        name = rng.choice([word(), f"{word()}.{word()}", f"{word()}{num(2)}", f"{word()}_{word()}"])
        at = rng.choice([" at ", " [at] ", "[at]", " (at) ", "(at)", " @ ", " AT "])
        dot = " dot " if at in (" at ", " AT ") else rng.choice([" dot ", ".", " [dot] ", "[dot]", "(dot)"] if at != " @ " else ["."])
        host = rng.choice([word(), f"{word()}-{word()}"])
        text = f"{name}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'de', 'es', 'fr', 'info'])}"
    elif kind == 1:
        parts = [str(rng.randrange(256)) for _ in range(4)]
        text = rng.choice([" . ", "[.]", "(.)", " .", ". "]).join(parts)
    elif kind == 2:
        while True:
            d = rng.choice("3456") + num(rng.choice([15, 15, 15, 14]) - 0)
            if luhn(d):
                break
        sep = rng.choice([".", "/", "  ", " - "])
        text = sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    elif kind == 3:
        area, mid, end = rng.choice("23456789") + num(2), rng.choice("23456789") + num(2), num(4)
        text = rng.choice([f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"({area}){mid}-{end}", f"1-{area}-{mid}-{end}", f"00{num(2)} {area} {mid} {end}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(2)}/{num(7)}", f"{area} {mid} {end}"])
    none = kind > 3
    if none:
        y, m, d = str(rng.randrange(1900, 2100)), f"{rng.randrange(1, 13):02d}", f"{rng.randrange(1, 29):02d}"
        n = rng.randrange(1, 12)
        text = rng.choice([f"{y}-{m}-{d}", f"{d}.{m}.{y}", f"{d}/{m}/{y}", f"{num(1)}.{num(2)}.{num(1)}", f"{rng.randrange(1000)},{num(3)}.{num(2)}", num(n), f"{num(2)}:{num(2)}:{num(2)}", f"{y}-{int(y) % 1900 + 1}", f"{num(3)}-{num(3)}", f"{rng.randrange(99)}-{rng.randrange(99)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(4)}-{num(4)}-{num(4)}", f"{some(3)}-{num(6)}", f"{y} {y} {y}", f"{num(2)} {num(2)} {num(2)} {num(2)}", f"{num(16)}", f"{num(4)} {num(4)} {num(4)} {num(3)}", f"{word()} at {word()}", f"{num(1)}.{num(1)}.{num(1)}.{num(5)}", f"{num(3)}.{num(3)}.{num(3)},{num(2)}", f"({y})", f"{y}{m}{d}-{num(6)}", f"{num(1)} . {num(2)}", f"@{word()}", f"{word()} @ {num(2)}"])
    right = {0: CUES[0], 1: CUES[3], 2: CUES[2], 3: CUES[1]}.get(kind, CUES[4])
    before = rng.choice([word(), word(), word(), rng.choice(sorted(right)), rng.choice(sorted(right)) + ":", word() + ","])
    after = rng.choice(["", ".", ",", " " + word(), " " + word() + "."])
    start = len(before) + 1
    return f"{before} {text}{after} ", [] if none else [(kind, start, start + len(text))]


def labelled(text: str, gold: list[tuple[int, int, int]]) -> list[tuple[Zone, list[tuple[int, int, int]]]]:
    """The zones of a text with the spans that each holds whole; base finds count as labels."""
    gold = sorted(set(gold) | {x for x in base_spans(text) if not any(a < x[2] and x[1] < b for _, a, b in gold)})
    return [(z, [x for x in gold if x[1] >= z.start and x[2] <= z.start + len(z.text)]) for z in zones(text)]


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_zones: int = SAMPLE_ZONES, examples: int = EXAMPLES, seed: int = 5) -> np.ndarray:
    """Weights from at most `sample_zones` zones of at most `sample_docs` documents (smallest hashes of doc_id and text,
    repeated rows once) and from written examples."""
    ship(docs.sparkSession)
    docs = docs.select(F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("draw"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    chosen = F.broadcast(docs.select("draw").distinct().orderBy("draw").limit(sample_docs))
    texts = docs.join(chosen, "draw").dropDuplicates(["draw"]).select("text")

    def cut(batches):
        from aerograin.llm import pii as own

        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                for z, gold in own.labelled(t, []):
                    if len(z.text) <= own.MOST_ZONE:
                        rows.append((z.text, z.before, z.after, [[k, a - z.start, b - z.start] for k, a, b in gold]))
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["zone", "before", "after", "gold"])

    got = texts.mapInArrow(cut, "zone string, before string, after string, gold array<array<int>>")
    has = F.size("gold") > 0
    rows = got.distinct().orderBy((~has).cast("int"), F.xxhash64("zone"), "zone", "before", "after").limit(sample_zones // 2).union(got.where(~has).distinct().orderBy(F.xxhash64("zone", F.lit(1)), "zone", "before", "after").limit(sample_zones // 2)).collect()
    samples = []
    for r in rows:
        at = len(r["before"])
        samples.append((Zone(at, at + len(r["zone"]), r["before"] + r["zone"] + r["after"]), [(k, a + at, b + at) for k, a, b in r["gold"]]))
    rng = random.Random(seed)
    for _ in range(examples):
        samples += labelled(*example(rng))
    rng.shuffle(samples)
    return fit(samples)


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """Rows of SCHEMA: base spans by kind, then start, and the spans the field adds (none overlaps a base span).

    Whole texts are read; null reads as empty. Rows that repeat give a row each. Only doc_id and text are read, so other
    columns may have any name. An empty table gives an empty result.
    """
    ship(docs.sparkSession)

    def run(batches):
        from aerograin.llm import pii as own

        span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            counts, base, added = [[] for _ in own.KINDS], [], []
            for t in batch.column(1).to_pylist():
                spans, more = [], []
                if own._TRIGGER.search(t) or own._WRITTEN_HINT.search(t):
                    spans = own.base_spans(t)
                    for z in own.zones(t):
                        more += [x for x in own.decode(z, weights) if not any(a < x[2] and x[1] < b for _, a, b in spans)]
                for k, c in enumerate(counts):
                    c.append(sum(s[0] == k for s in spans))
                base.append([{"kind": own.KINDS[k], "start": a, "end": b} for k, a, b in spans])
                added.append([{"kind": own.KINDS[k], "start": a, "end": b} for k, a, b in sorted(more)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.list_(span)), pa.array(added, pa.list_(span))], ["doc_id", *(f"n_{k}" for k in own.KINDS), "base", "added"])

    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, SCHEMA)


def written(spans):
    """kind:start:end, comma-joined, by kind as in KINDS, then start."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("n"))))
    return F.concat_ws(",", F.transform(keyed, lambda s: F.concat_ws(":", s["n"], s["s"].cast("string"), s["e"].cast("string"))))
