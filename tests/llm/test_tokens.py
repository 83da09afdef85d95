import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import bpe, packing

RANKS = bpe.load_ranks()
AHEAD = bpe.lookahead(RANKS)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text_equals_the_public_library(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    t = bpe.Transducer(RANKS, AHEAD)
    ids = t.encode(text)
    assert ids == reference.encode_ordinary(text) and t.decode(ids) == text


def test_small_blocks_do_not_change_long_pretokens(reference):
    rnd = random.Random(7)
    t = bpe.Transducer(RANKS, AHEAD, block=1)
    for alphabet in ("ab", "aeinst", "-=", "实验测量", "the", "x"):
        s = "".join(rnd.choice(alphabet) for _ in range(6000))
        assert t.encode(s) == reference.encode_ordinary(s)


def test_lookahead_is_enough_and_used():
    """With another byte appended, no token that ends before the lookahead changes."""
    rnd = random.Random(3)
    for _ in range(200):
        s = bytes(rnd.choice(b"abest -=") for _ in range(AHEAD + 60))
        a, b = bpe.merge_block(s[:-9], RANKS), bpe.merge_block(s, RANKS)
        ends = lambda ts: set(np.cumsum([len(x) for x in ts]).tolist())
        stable = len(s) - 9 - AHEAD
        assert {e for e in ends(a) if e <= stable} == {e for e in ends(b) if e <= stable}


def test_documents(spark):
    long = "<|endoftext|> " + "word " * 50_000
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " ", 5), (4, long, 5), (4, "twin", 5)], "doc_id bigint, text string, ids int")
    got = bpe.encode_documents(df)
    rows = got.collect()
    sizes = sorted((r["doc_id"], len(r["ids"])) for r in rows)
    assert sizes[:3] == [(1, 0), (2, 0), (3, 1)] and len(rows) == 5 and 50256 not in max(rows, key=lambda r: len(r["ids"]))["ids"]
    assert sorted(r["text"] for r in bpe.decode_documents(got).collect()) == sorted(["", "", " ", long, "twin"])
    assert bpe.encode_documents(df.limit(0)).count() == 0


def brute_best_fit(sizes, cap):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= s]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - s)
        else:
            gaps.append(cap - s)
    return sorted(gaps)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(20, 40))
def test_sweep_equals_item_by_item_best_fit(sizes, cap):
    counts = {s: sizes.count(s) for s in sizes}
    matches, n = packing.sweep(counts, cap)
    held = dict.fromkeys(range(n), 0)
    by_size = {}
    for size, rank, start, each in matches:
        by_size.setdefault(size, []).append((rank, start, each))
    for size, runs in by_size.items():
        runs.sort()
        for i, (rank, start, each) in enumerate(runs):
            stop = runs[i + 1][0] if i + 1 < len(runs) else counts[size]
            for k in range(rank, stop):
                held[start + (k - rank) // each] += size
    assert sorted(cap - h for h in held.values()) == brute_best_fit(sizes, cap)


def test_packed_documents(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0, 1, 3, 7, 8, 20, 33])) for i in range(400)] + [(400, None), (401, -1)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    got = packing.pack_documents(df, [("ten", 10), ("forty", 40)]).collect()
    for name, cap in (("ten", 10), ("forty", 40)):
        mine = [r for r in got if r["pack_name"] == name]
        boxes, docs = {}, {}
        for r in mine:
            boxes[r["container_no"]] = boxes.get(r["container_no"], 0) + r["n_tokens"]
            docs.setdefault(r["doc_id"], []).append((r["piece_no"], r["n_tokens"]))
        assert max(boxes.values()) <= cap and set(boxes) == set(range(len(boxes)))
        for k, n in rows:
            n = max(n or 0, 0)
            pieces = sorted(docs[k])
            assert sum(p[1] for p in pieces) == n and [p[0] for p in pieces] == list(range(len(pieces)))
            assert len(pieces) == max(-(-n // cap), 1)
        total = sum(max(n or 0, 0) for _, n in rows)
        assert len(boxes) <= 1.25 * -(-total // cap)
    assert packing.pack_documents(df.limit(0), [("ten", 10)]).count() == 0
    assert packing.pack_documents(df.where("doc_id = 400"), [("ten", 10)]).first()["container_no"] == 0
    with pytest.raises(ValueError):
        packing.pack_documents(df, [("none", 0)])
