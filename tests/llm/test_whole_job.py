"""Operators on inputs where a shortened job would show: large counts, noise, other offsets."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_op9_large_counts_are_kept():
    from aerograin.llm import ctxmix

    leaves = np.zeros(ctxmix._CODES, np.int64)
    leaves[[0, 5, 4095]] = [6_000_000_000, 2_000_000, 600_000]
    ones, every = ctxmix.nodes(leaves, 1, ctxmix._CODES)
    assert every[1] == 6_002_600_000 and ones[1] == 600_000
    # The path of each code leads back to its own count.
    for code, count in ((0, 6_000_000_000), (5, 2_000_000), (4095, 600_000)):
        node = (1 << (ctxmix.CODE_BITS - 1)) + (code >> 1)
        assert (ones[node] if code & 1 else every[node] - ones[node]) == count


def test_op1_large_rates_are_poisson(spark):
    from aerograin.llm import mixing

    # One source of 400 texts of 1 character beside one text of 2.4 million: at these targets each short one has a rate of 1800.
    docs = spark.range(401).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.expr("repeat('x', 2400000)")).otherwise("x").alias("text"), F.when(F.col("id") == 0, "big").otherwise("small").alias("source"))
    targets = {"small": 3.0, "big": 7.0}
    rate = next(r["rate"] for r in mixing.source_rates(docs, targets=targets).collect() if r["source"] == "small")
    assert rate == pytest.approx(1800.3)
    rows = mixing.mix(docs, targets=targets).where("source = 'small'").groupBy("doc_id", "n_copies").count().collect()
    n = np.array([r["n_copies"] for r in rows], float)
    assert len(n) == 400 and all(r["count"] == r["n_copies"] for r in rows)
    assert abs(n.mean() - rate) < 5 * math.sqrt(rate / 400)
    assert 0.75 < n.var() / rate < 1.3


def test_op2_finds_what_aligns(spark):
    from aerograin.llm import chroma

    rng = np.random.default_rng(3)
    prints = [rng.integers(-(2**31), 2**31, size=int(n)).astype(np.int32) for n in rng.integers(30, 90, size=60)]
    prints += [np.full(70, 5, np.int32), np.r_[np.full(40, 5, np.int32), prints[0][:30]]]
    for i in range(60):  # noisy, shifted copies, at a bit error of 1 to 9 %
        noise = rng.random((len(prints[i]), 32)) < (1 + i % 9) / 100
        prints.append((prints[i] ^ np.packbits(noise, axis=1).view(np.int32).ravel())[i % 5 :])
    want = {}
    for i in range(0, len(prints), 2):
        for j in range(len(prints)):
            if i != j and (got := chroma.aligned(prints[i], prints[j]))[1] <= chroma.MOST_ERROR:
                want[i, j] = got
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(prints)], "id bigint, frames array<int>").repartition(3)
    got = {(r["class_id"], r["match_class_id"]): (r["offset_frames"], r["bit_error"]) for r in chroma.search(df, lambda i: i % 2 == 0).where("match_class_id is not null").collect()}
    assert len(want) > 50 and len(want.keys() & got.keys()) >= 0.9 * len(want)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_op2_blocks_align_as_pairs_do(monkeypatch):
    from aerograin.llm import chroma

    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 6, size=int(n)).astype(np.int32) for n in rng.integers(25, 60, size=20)]
    n, flat = np.array([len(p) for p in parts]), np.concatenate(parts)
    want = sorted((i, j, *chroma.aligned(parts[i], parts[j])) for i in range(20) for j in range(20) if i != j and chroma.aligned(parts[i], parts[j])[1] <= chroma.MOST_ERROR)
    for at_once in (1 << 21, 3000, 10):
        monkeypatch.setattr(chroma, "AT_ONCE", at_once)
        got = sorted(zip(*(x.tolist() for x in chroma.align_blocks(np.arange(20), n, flat, np.arange(20), n, flat)), strict=True))
        assert want and got == want


def test_op3_text_without_blanks_matches_at_any_offset(spark):
    from aerograin.llm import winnowing

    rng = np.random.default_rng(5)
    of = lambda n: "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 3000, size=n))
    passage = of(12)
    pairs = [(of(k) + passage + of(20), of(30) + passage + of(9)) for k in range(6)]
    text = of(300)
    pairs.append((text, text[:10] + of(1) + text[10:]))
    df = spark.createDataFrame(pairs, "a string, b string")
    kept = df.select(*[winnowing.hashes(winnowing.fingerprint(F.col(c))).alias(c) for c in "ab"])
    got = kept.select(F.size(F.array_intersect("a", "b")).alias("n"), winnowing.likeness(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(r["n"] > 0 for r in got[:6])
    assert got[6]["s"] > 0.8


def test_op3_units(spark):
    from aerograin.llm import winnowing

    texts = ["ab cdefgh\nabcdefgh  x", "\U0001f600" * 8, "", " \t"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.regexp_extract_all("t", F.lit(winnowing.UNIT), F.lit(1)).alias("u"))
    assert [r["u"] for r in df.collect()] == [["ab", "cdefgh", "abcdef", "bcdefg", "cdefgh", "x"], ["\U0001f600" * 6] * 3, [], []]


def test_op1_equal_rows_are_drawn_each_for_itself(spark):
    from aerograin.llm import mixing

    schema = "doc_id bigint, text string, source string, extra map<string,int>"
    rows = [(None, "same", "a", {"x": 1})] * 6000 + [(None, None, "a", None)] * 3000 + [(7, "one", "b", None)] * 500 + [(7, f"two {i}", "b", None) for i in range(500)]
    docs = spark.createDataFrame(rows, schema).repartition(6)
    got = mixing.mix(docs, targets={"a": 1.0, "b": 1.0})
    rate = {r["source"]: r["rate"] for r in mixing.source_rates(docs, targets={"a": 1.0, "b": 1.0}).collect()}
    n = {(r["doc_id"], r["text"]): r["n"] for r in got.groupBy("doc_id", F.substring("text", 1, 3).alias("text")).agg(F.count("*").alias("n")).collect()}
    for key, times, source in (((None, "sam"), 6000, "a"), ((None, None), 3000, "a"), ((7, "one"), 500, "b"), ((7, "two"), 500, "b")):
        mean = times * rate[source]
        assert abs(n.get(key, 0) - mean) < 6 * math.sqrt(mean)
    assert got.select("position").distinct().count() == got.count()


@pytest.mark.parametrize("rate", [0.0, 50.0, 900.0, 100_000.0])
def test_op1_rates(spark, rate):
    from aerograin.llm import mixing

    # "s" has 100 texts of 1 character; its share of the characters is set by the target weight.
    epochs = 1.0
    docs = spark.range(101).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.expr("repeat('x', 20000000)")).otherwise("x").alias("text"), F.when(F.col("id") == 0, "big").otherwise("s").alias("source"))
    share = rate * 100 / 20_000_100
    drawn = mixing.mix(docs, targets={"s": share, "big": 1 - share}, epochs=epochs).where("source = 's'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    n = np.zeros(100)
    n[: len(drawn)] = [r["n"] for r in drawn]
    assert abs(n.mean() - rate) <= 5 * math.sqrt(rate / 100)
    if rate:
        assert 0.6 < n.var() / rate < 1.6


def test_op5_rows_without_an_id_link_and_go_row_by_row(spark):
    import corpus_pipeline
    from aerograin.llm import partenum

    near = [" ".join(f"w{j}" if j != 100 + k else f"z{k}" for j in range(200)) for k in range(4)]
    clean = [" ".join(f"c{k}x{j}" for j in range(60)) for k in range(3)]
    rows = [(None, near[0]), (None, near[1]), (5, near[2]), (5, clean[0]), (9, near[3]), (9, near[3]), (None, clean[1]), (None, clean[1]), (3, clean[2]), (3, None), (None, ""), (None, ""), (3, " \t")]
    docs = spark.createDataFrame([(i, t, "en", "s", None, {"k": 1}) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, class map<string,int>").repartition(3)
    got = sorted(((r["doc_id"], r["component_id"], r["n_shingles"]) for r in partenum.near_groups(docs).collect()), key=str)
    want = [(None, 5, 196)] * 2 + [(5, 5, 196), (5, 5, 56), (9, 5, 196), (9, 5, 196)] + [(None, None, 56)] * 2 + [(3, 3, 56), (3, 3, 0), (3, 3, 0), (None, None, 0), (None, None, 0)]
    assert got == sorted(want, key=str)
    left = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=str)
    assert left == sorted([(5, near[2]), (5, clean[0]), (None, clean[1]), (3, clean[2]), (3, None), (None, ""), (None, ""), (3, " \t")], key=str)


def test_op2_every_entry_sounds():
    from aerograin.llm import chroma

    rng = np.random.default_rng(0)
    v = rng.random(64).tolist()
    whole = chroma.packed(chroma.chroma(chroma.rendered(v)))
    for i in (0, 40, 62):
        other = [*v[:i], 1 - v[i] + 0.001, *v[i + 1 :]]
        assert not np.array_equal(whole, chroma.packed(chroma.chroma(chroma.rendered(other))))


def test_op2_recall_on_recordings():
    """Copies that are shifted, noisy, quieter, cut or written anew at another rate: candidates share an integer, and align."""
    from aerograin.llm import chroma

    rng = np.random.default_rng(8)
    found = total = 0
    for _ in range(30):
        pcm = chroma.rendered(rng.normal(size=64).tolist())
        a = chroma.packed(chroma.chroma(pcm)).view(np.int32)
        shift = int(rng.integers(1, 40)) * chroma.HOP
        again = np.interp(np.arange(0, len(pcm), 0.5), np.arange(len(pcm)), pcm)[::2].astype(np.float32)
        for other in (pcm[shift:], pcm + rng.normal(scale=0.003, size=len(pcm)).astype(np.float32), pcm * 0.3, pcm[: len(pcm) // 2], again, np.rint(pcm * 2000).astype(np.float32) / 2000):
            b = chroma.packed(chroma.chroma(other)).view(np.int32)
            total += 1
            found += chroma.aligned(a, b)[1] <= chroma.MOST_ERROR
    assert found >= 0.9 * total


def test_op3_an_id_in_most_rows_is_split(spark):
    from aerograin.llm import winnowing

    rows = [(7, f"text number {i} of one id") for i in range(600)] + [(None, "same text")] * 600 + [(i, f"other {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    dealt, _ = winnowing.with_next(docs, 20)
    assert dealt.groupBy("_part").count().agg(F.max("count")).first()[0] < 260
    got = winnowing.compare(docs, 20).collect()
    assert len(got) == 1300
    assert sum(r["doc_id"] is None and r["near_next"] == 1.0 for r in got) >= 599


def test_pipeline_near_duplicates_of_texts_with_one_passage(spark, monkeypatch):
    """Near copies of 60 texts that all have one passage: no group of all of them is compared, and one of each two stays."""
    import random

    import corpus_pipeline
    from aerograin.llm import partenum

    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, rows = words(44), []
    for i in range(60):
        own = words(160)
        rows += [(2 * i, " ".join(own + passage)), (2 * i + 1, " ".join([*own[:80], "other", *own[81:], *passage]))]
    seen, packs = [], partenum.packs

    def spy(sets, grouped):
        seen.append(grouped.groupBy("root").count().agg(F.max("count")).first()[0])
        return packs(sets, grouped)

    monkeypatch.setattr(partenum, "packs", spy)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [2 * i for i in range(60)]
    assert seen[0] <= 24


def test_pipeline_near_duplicates_of_a_large_group_make_few_edges(spark, monkeypatch):
    """150 near copies of one text: the edges between candidates grow with the copies, not with their pairs."""
    import random

    import corpus_pipeline
    from aerograin.llm import partenum

    rng = random.Random(8)
    text = [f"w{rng.randrange(10**9)}" for _ in range(300)]
    rows = [(i, " ".join(f"x{rng.randrange(10**9)}" if j in edits else w for j, w in enumerate(text))) for i in range(150) for edits in [set(rng.sample(range(300), 1 + i % 5))]]
    seen, components = [], partenum.components

    def spy(edges, scratch, name):
        seen.append(edges.count())
        return components(edges, scratch, name)

    monkeypatch.setattr(partenum, "components", spy)
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert [r["doc_id"] for r in kept.collect()] == [0]
    assert max(seen) <= 450
