"""Nearest times, encoding, mixing and splitting."""

import random
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import brute  # noqa: E402

from tidemark.llm import mixing, nearest, queries, splitting, tokens  # noqa: E402

if not Path(tokens.BYTE_BPE).exists():
    pytest.skip("no vocabulary files", allow_module_level=True)


def rows(spark, data, name, key):
    return brute.once([r.asDict() for r in spark.read.parquet(f"{data}/{name}.parquet").collect()], key)


def p1(earn, inc):
    by = defaultdict(list)
    for r in inc:
        if r["date"] is not None and brute.quarter(r["period"]) and brute.sym(r["symbol"]):
            by[brute.sym(r["symbol"])].append((brute.day(r["date"]), r["inc_id"]))
    out = set()
    for r in earn:
        if (d := brute.day(r["date"])) and (near := [(abs((q - d).days), q, i) for q, i in by[brute.sym(r["symbol"])] if abs((q - d).days) <= 45]):
            out.add((r["earn_id"], min(near)[2]))
    return out


def test_p1(spark, data):
    got = {tuple(r) for r in queries.p1_found(spark, data).collect()}
    assert got == p1(rows(spark, data, "aapl_earnings", "earn_id"), rows(spark, data, "aapl_income_quarter", "inc_id"))


@pytest.mark.parametrize("most", [10**6, 40, 7, 1])
def test_nearest_with_split_groups(spark, most):
    """One entity holds most rows; splitting its groups changes nothing. Ties, repeated rows and nulls included."""
    rnd = random.Random(5)
    name = lambda: rnd.choice(["hot", "hot", "hot", "a", "b"])
    left = [(i, name(), rnd.randint(0, 400)) for i in range(200)] + [(900, None, 5), (901, "a", None), (5, "hot", 10), (5, "hot", 10)]
    right = [(i, name(), rnd.randint(-50, 450)) for i in range(150)] + [(800, None, 5), (801, "hot", None)] + [(810, "b", 200), (809, "b", 200)]
    a = spark.createDataFrame(left, "id long, k string, t int").withColumn("extra", F.lit(1))
    b = spark.createDataFrame(right, "id long, k string, t int").withColumn("extra", F.lit(2))
    b = b.withColumnRenamed("id", "rid")
    got = nearest.nearest_in_time(a, b, entity="k", left_id="id", left_time="t", right_id="rid", right_time="t", tolerance=10, width=60, shards=3, most=most).collect()
    want = set()
    for i, k, t in left:
        near = [(abs(u - t), u, j) for j, kk, u in right if k and kk == k and t is not None and u is not None and abs(u - t) <= 10]
        if near:
            want.add((i, min(near)[2], min(near)[0]))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_nearest_empty(spark):
    e = spark.createDataFrame([], "id long, k string, t long")
    assert nearest.nearest_in_time(e, e.withColumnRenamed("id", "rid"), entity="k", left_id="id", left_time="t", right_id="rid", right_time="t", tolerance=3).count() == 0


ODD = [None, "", " ", "\n\n\n", "a", "naïve café — 東京 😀👩‍👩‍👧", "<|endoftext|> is text", "x" * 5000, "tab\tnbsp here\r\nend  ", "a b " * 40_000, "word. " * 30_000 + "y" * 70_000 + " tail", "don't we'll I'M", "١٢٣ ½ Ⅷ", "\x1c\x1d\x85a"]


def test_encoding_in_parts_is_the_plain_encoding():
    t = tokens.tokenizer(tokens.BYTE_BPE)
    for text, ids in zip(ODD, tokens.encode(ODD)):
        assert list(ids) == (t.encode(text, add_special_tokens=False).ids if text else [])
        assert tokens.decode(ids) == (text or "")
        assert 50256 not in ids


def test_ids_and_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    ids = tokens.token_ids(docs, id="doc_id", text="text")
    assert ids.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    back = {r.doc_id: r.text for r in tokens.decoded(ids, id="doc_id", ids="ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}
    n = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, text="text", keep=["doc_id"]).collect()}
    assert n == {r.doc_id: len(r["ids"]) for r in ids.collect()}
    assert tokens.token_ids(docs.limit(0), id="doc_id", text="text").count() == 0


def test_same_as_the_rank_file():
    """The other library with the same vocabulary gives the same ids."""
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    p = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    e = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t for t in ODD if t and len(t) < 10_000]
    assert [list(x) for x in tokens.encode(texts)] == [e.encode_ordinary(t) for t in texts]


def test_ranks_are_the_same_vocabulary():
    assert tokens.vocabulary(tokens.BYTE_RANKS) == tokens.vocabulary(tokens.BYTE_BPE)[:-1]
    assert [list(x) for x in tokens.encode(ODD, tokens.BYTE_RANKS)] == [list(x) for x in tokens.encode(ODD)]
    every = ["a" + chr(c) + "1." + chr(c) + " " + chr(c) for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    assert [list(x) for x in tokens.encode(every, tokens.BYTE_RANKS)] == [list(x) for x in tokens.encode(every)]


def test_split_characters():
    ids = next(tokens.encode(["ab😀"]))
    raw = "ab😀".encode()
    starts, clean = tokens.char_offsets(ids, raw)
    assert starts[-1] == 3 and clean[0] and clean[-1]
    assert b"".join(tokens.decode_bytes([i]) for i in ids) == raw
    assert not all(clean) and "�" in tokens.decode(ids[:-1])


def check_pieces(text, ids, cuts, limit, overlap):
    assert cuts[0][0] == 0 and cuts[-1][1] == len(ids)
    for (a, z, c, d, _), nxt in zip(cuts, [*cuts[1:], None]):
        assert 0 < z - a <= limit
        assert tokens.decode(ids[a:z]) == text[c:d]
        assert len(next(tokens.encode([text[c:d]]))) <= limit
        if nxt:
            assert a < nxt[0] <= z and z - nxt[0] <= overlap and nxt[1] > z


@pytest.mark.parametrize("limit,overlap", [(512, 64), (40, 8), (16, 0)])
def test_pieces(limit, overlap):
    rnd = random.Random(1)
    odd = [t for t in ODD if t] + ["".join(rnd.choice(["Word ", "go. ", "\n\n", "x" * rnd.randint(1, 300), "東京。", "😀" * 9, " ", "A|B\t"]) for _ in range(400)) for _ in range(6)]
    all_ids = list(tokens.encode(odd))
    seen = {i: (cuts, n) for i, cuts, n in splitting.pieces(odd, limit, overlap)}
    assert set(seen) == {i for i, x in enumerate(all_ids) if len(x) > limit}
    for i, (cuts, n) in seen.items():
        assert n == len(all_ids[i])
        check_pieces(odd[i], all_ids[i], cuts, limit, overlap)


def test_word_boundaries_by_pattern():
    """The places found by arrays are those that a pattern finds."""
    import regex

    for text in [t for t in ODD if t and len(t) < 10_000] + ["a\u3000b\u200bc\u2028d\x1ce", "x", " ", "é \ud800 y"]:
        n = len(text) + 1
        rank = splitting.boundary_ranks(text, np.arange(n), np.ones(n, bool))
        want = {m.start() for m in regex.finditer(r"(?<=\S)(?=\s)|(?<=\s)(?=\S)", text)}
        assert want <= set(np.flatnonzero(rank > 0).tolist()) and set(np.flatnonzero(rank == splitting.WORD).tolist()) <= want


def test_cuts_are_the_greedy_walk():
    """Doubling reaches what a loop from the start reaches; cuts fall on sentences where there are any."""
    text = "One sentence of some words here. " * 200
    (_, cuts, n), = splitting.pieces([text], 100, 20)
    ids = next(tokens.encode([text]))
    starts, clean = tokens.char_offsets(ids, text.encode())
    end, succ, _ = splitting.successors(splitting.boundary_ranks(text, starts, clean), 100, 20)
    at, walk = 0, []
    while not walk or walk[-1] != at:
        walk.append(at)
        at = int(succ[at])
    assert [c[0] for c in cuts] == walk
    assert all(text[:d].rstrip().endswith(".") for _, _, _, d, _ in cuts) and all(c[4] for c in cuts)
    assert n == len(ids)


def test_doubling_against_walk():
    rnd = np.random.default_rng(0)
    for _ in range(20):
        n = int(rnd.integers(2, 200))
        succ = np.minimum(np.arange(n) + rnd.integers(1, 9, n), n - 1)
        want, at = {0}, 0
        while succ[at] != at:
            at = int(succ[at])
            want.add(at)
        assert set(splitting.reached(succ, np.array([0]))) == want


def test_p9_found(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id for r, x in zip(docs, tokens.encode([r.text for r in docs])) if len(x) > 512}
    got = [r.doc_id for r in queries.p9_found(spark, data).collect()]
    assert set(got) == want and len(got) == len(want)
    p = queries.p9_pieces(spark, data).collect()
    assert {r.doc_id for r in p} == want and all(len(x) <= 512 for x in tokens.encode([r.piece for r in p]))


def test_split_empty(spark):
    e = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id long, text string")
    assert splitting.split_texts(e, id="doc_id", text="text").count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(e, id="doc_id", text="text", limit=10, overlap=9)


def test_piece_that_cannot_be_cut():
    """A character of more tokens than the limit can't be part of any piece under it: that's an error, not a longer piece."""
    odd = "".join(chr(c) for c in (0x1F3F4, 0xE0067, 0xE0062, 0x10FFFF)) * 3
    assert max(len(x) for x in tokens.encode(list(odd))) > 2
    with pytest.raises(ValueError, match="however it is cut"):
        list(splitting.pieces([odd], 2, 0))


def test_short_texts_need_no_counting():
    """Exactly at the limit in bytes, one over it, and over it in bytes only."""
    texts = ["a " * 4, "é" * 4, "é" * 5, "! ? ! ? ! ?", None, ""]
    want = {i for i, x in enumerate(tokens.encode(texts)) if len(x) > 8}
    assert {i for i, _, _ in splitting.pieces(texts, 8, 0)} == want


def test_quotas():
    q = mixing.quotas({"a": 100, "b": 1000, "c": 10}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 2, "b": 3, "c": 4}, 1110)
    assert q["a"] == 200 and q["c"] == 40 and abs(sum(q.values()) - 1110) < 1e-6
    assert mixing.quotas({"a": 10}, {"a": 1.0}, {"a": 2}, 100) == {"a": 20.0}


def test_mixing(spark):
    docs = [(i, "big", 50) for i in range(300)] + [(1000 + i, "small", 30) for i in range(20)] + [(2000 + i, None, 10) for i in range(5)] + [(3000, "none", 40), (3001, "big", None), (3002, "big", 0)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("big", 0.7, 2), ("small", 0.3, 3), ("absent", 0.0, 5)], "source string, weight double, max_repeats int")
    m = mixing.mix(d, t, id="doc_id", source="source", size="n_tokens", slopes={"small": 1.0, "big": -0.3}, buckets=16)
    got = m.collect()
    pos = [r.position for r in got]
    assert pos == sorted(pos)
    uses = {}
    for r in got:
        uses.setdefault((r.source, r.doc_id), []).append(r.repeat_no)
    assert all(sorted(u) == list(range(1, len(u) + 1)) for u in uses.values())
    assert max(len(u) for (s, _), u in uses.items() if s == "small") == 3 and all(len(u) <= 2 for (s, _), u in uses.items() if s == "big")
    total = sum(n or 0 for _, s, n in docs if s)
    size = sum(r.n_tokens for r in got)
    assert abs(size - total) <= 50
    # The small source's cap binds: three times 600.
    s = {r.source: r for r in mixing.shares(m, t, source="source", id="doc_id", size="n_tokens").collect()}
    assert s["small"].total_size == 1800 and s["small"].most_uses == 3 and s["absent"].n_uses == 0
    assert abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    # A source that grows from nothing is rarer in the first half than in the second.
    half = [r.position < total / 2 for r in got if r.source == "small"]
    assert sum(half) < len(half) - sum(half)


def test_curriculum_sums():
    """At every time the sources make up the whole, by the end each has given its quota, and the ratios of two sources
    follow their schedules."""
    quota, slopes = {"a": 700.0, "b": 200.0, "c": 100.0, "none": 0.0}, {"a": 0.5, "b": -1.0}
    upto = mixing.curriculum(quota, slopes, 64)
    assert set(upto) == {"a", "b", "c"}
    rate = {s: np.diff(u) * quota[s] / 1000 for s, u in upto.items()}
    assert np.allclose(sum(rate.values()), 1 / 64)
    mid = (np.arange(64) + 0.5) / 64
    ratio = rate["a"] / rate["c"] / (1 + 0.5 * (2 * mid - 1))
    assert np.allclose(ratio, ratio[0])
    with pytest.raises(ValueError):
        mixing.curriculum({"a": 1.0}, {"a": 1.5})


def test_shares_follow_the_schedule(spark):
    """In every tenth of the positions each source has the share that its curve gives, and positions are running sizes."""
    docs = [(i, "abc"[i % 3], 1 + i % 7) for i in range(6000)]
    d = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("a", 0.5, 4), ("b", 0.3, 4), ("c", 0.2, 4)], "source string, weight double, max_repeats int")
    slopes = {"a": 0.8, "b": -0.9}
    got = mixing.mix(d, t, id="doc_id", source="source", size="n_tokens", slopes=slopes, buckets=32).collect()
    total = sum(n for _, _, n in docs)
    quota = {"a": 0.5 * total, "b": 0.3 * total, "c": 0.2 * total}
    upto = mixing.curriculum(quota, slopes)
    for k in range(10):
        part = [r for r in got if k <= 10 * r.position / total < k + 1]
        size = sum(r.n_tokens for r in part)
        assert abs(size - total / 10) < 0.01 * total
        for s in "abc":
            at = lambda x: np.interp(x, np.arange(65) / 64, upto[s])
            want = quota[s] * (at((k + 1) / 10) - at(k / 10)) / (total / 10)
            assert abs(sum(r.n_tokens for r in part if r.source == s) / size - want) < 0.02
    running = 0
    for r in got:
        assert abs(r.position - running) < 0.01 * total
        running += r.n_tokens


def test_many_sources_without_a_target(spark, monkeypatch):
    """Sources without a target count for the total, however many; only the targets' number has a limit."""
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    d = spark.createDataFrame([(i, f"s{i}", 10) for i in range(100)], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("s1", 0.5, 100), ("s2", 0.5, 100)], "source string, weight double, max_repeats int")
    got = mixing.mix(d, t, id="doc_id", source="source", size="n_tokens").collect()
    assert sum(r.n_tokens for r in got) == 1000 and {r.source for r in got} == {"s1", "s2"}
    with pytest.raises(ValueError):
        mixing.mix(d, t.union(t.limit(1)), id="doc_id", source="source", size="n_tokens")


def test_mixing_empty(spark):
    d = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    t = spark.createDataFrame([("a", 1.0, 2)], "source string, weight double, max_repeats int")
    m = mixing.mix(d, t, id="doc_id", source="source", size="n_tokens")
    assert m.count() == 0
    assert [r.actual_share for r in mixing.shares(m, t, source="source", id="doc_id", size="n_tokens").collect()] == [0.0]


def test_p8_shares_near_targets(spark, data):
    s = queries.p8_shares(spark, data).collect()
    t = {r.source: r for r in spark.read.parquet(f"{data}/mix_targets.parquet").collect()}
    assert {r.source for r in s} == set(t) and all(r.most_uses <= t[r.source].max_repeats for r in s)
