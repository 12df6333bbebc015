import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from resonar.llm import bit_model, lm_scoring

from .helpers import SCHEMA, documents, frame, prose


def _held(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2


def _tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def _seen_by_brute_force(counts):
    """counts of both next bits for each prefix of bits that words, with a space after them, begin with."""
    seen = Counter()
    for w, n in counts.items():
        bits = "".join(f"{b:08b}" for b in w + b" ")
        for k in range(len(bits)):
            seen[bits[: k + 1]] += n
    return seen


def _words(counts):
    return {w + b" ": n for w, n in counts.items()}


def _model(counts):
    words = sorted(counts)
    model = bit_model.BitModel()
    joint = np.zeros(2 * bit_model.SLOTS)
    known = [w for w in words if counts[w]]
    model.count(known, np.array([counts[w] for w in known]), joint)
    model.set_tables(joint)
    heads = Counter()
    for w in known:
        heads[(w + b" \0\0\0")[: bit_model.HEAD]] += counts[w]
    return words, model, bit_model.Heads(list(heads), list(heads.values()))


def test_prefix_counts_equal_brute_force():
    rng = random.Random(2)
    counts = {("".join(rng.choice("abé!") for _ in range(rng.randint(1, 9)))).encode(): rng.randint(0, 9) for _ in range(300)} | {b"a\x01": 4, b"a": 2, b"\n": 7, b"x" * 500: 1}
    want = _seen_by_brute_force({w: n for w, n in counts.items() if n})
    words, model, heads = _model(counts)
    # parts need only words that share their first bytes
    for part in ([w for w in words if w[:1] == b"a"], [w for w in words if w[:1] != b"a"]):
        got, _, n, seen = bit_model.in_order(part, np.array([counts[w] for w in part]), heads)
        assert [counts[w] for w in got] == n.tolist()
        at = 0
        for w in got:
            bits = "".join(f"{b:08b}" for b in w + b" ")
            for k in range(len(bits)):
                assert seen[k % 8, at + k // 8].tolist() == [want[bits[:k] + "0"], want[bits[:k] + "1"]], (w, k)
            at += len(w) + 1


def test_bit_model_is_a_distribution_over_the_next_byte():
    counts = {b"the": 9, b"then": 3, b"of": 5, b"\n": 2}
    words, model, heads = _model(counts)
    every = [*words, *(bytes([b]) for b in range(256) if b not in (9, 10, 11, 12, 13, 32)), b"zqx"]
    got, _, n, seen = bit_model.in_order(every, np.array([counts.get(w, 0) for w in every]), heads)
    model.learn(got, n, seen)
    cost = dict(zip(got, model.bits(got, seen).tolist(), strict=True))
    assert sum(2.0 ** -cost[w] for w in cost if len(w) == 1 and w != b"\n") < 1 and cost[b"the"] < cost[b"zqx"]


def _mixed_by_brute_force(tokens, word, seen, together):
    """One document, token by token."""
    weight, pending, total, came = list(lm_scoring.FIRST), [0.0] * len(lm_scoring.FIRST), 0.0, []
    for k, t in enumerate(tokens):
        before = tokens[k - 1] if k else b"\n"
        n, both = seen[before], together[before, t]
        run = 0
        for c in reversed(came[-(lm_scoring.RUNS - 1) :]):
            if not c:
                break
            run += 1
        gate = int(min(math.log2(n + 1) / 2, lm_scoring.SEEN_LEVELS - 1)) * lm_scoring.RUNS + run
        alone, after = 10.0 ** word[t], both / n if n else 0.0
        share = 1 / (1 + math.exp(-weight[gate])) if n else 0.0
        p = share * after + (1 - share) * alone
        total += math.log10(p)
        pending[gate] += share * (1 - share) * (after - alone) / p
        came.append(both > 0)
        if (k + 1) % lm_scoring.TURN == 0:
            weight = [w + lm_scoring.RATE * g for w, g in zip(weight, pending, strict=True)]
            pending = [0.0] * len(weight)
    return total


def test_scores_equal_brute_force(spark):
    rows = [r for r in documents(n=60) if r[0] != 904]
    got = {r.doc_id: r for r in lm_scoring.score_documents(frame(spark, rows), part_words=10**6, chunk_bytes=4000, bucket_tokens=500).collect()}
    assert len(got) == len(rows)
    train, other, pairs = Counter(), Counter(), Counter()
    for k, t in rows:
        own = _tokens(t)
        (other if _held(k) else train).update(own)
        if not _held(k):
            pairs.update(zip([b"\n", *own[:-1]], own, strict=True))
    counts = {w: train[w] for w in train | other}
    known = {w: n for w, n in counts.items() if n}
    # weights are learnt from the known words alone, in one part
    words, model, heads = _model(counts)
    learnt, _, n, seen = bit_model.in_order(sorted(known), np.array([known[w] for w in sorted(known)]), heads)
    size = [len(w) + 1 for w in learnt]
    start = np.cumsum([0, *size])
    order = np.random.default_rng(len(learnt)).permutation(len(learnt))
    for k in range(0, len(order), 4096):
        some = order[k : k + 4096]
        model.learn([learnt[j] for j in some], n[some], np.concatenate([seen[:, start[j] : start[j + 1]] for j in some], axis=1))
    every, _, _, seen = bit_model.in_order(words, np.array([counts[w] for w in words]), heads)
    word = dict(zip(every, (-lm_scoring.LOG10_2 * model.bits(every, seen)).tolist(), strict=True))
    total, v = sum(train.values()), len(train)
    for k, t in rows:
        own, r = _tokens(t), got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (_held(k), len(own), sum(w in known for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (total + v + 1)) for w in own))
        mine = list(zip([b"\n", *own[:-1]], own, strict=True))
        left, both = (Counter(), Counter()) if _held(k) else (Counter([b"\n", *own[:-1]]), Counter(mine))
        assert r.score == pytest.approx(_mixed_by_brute_force(own, word, {w: train[w] - left[w] for w in counts}, {p: pairs[p] - both[p] for p in mine}), rel=1e-4), k


def test_order_and_copies_matter_and_layout_does_not(spark):
    rng = random.Random(9)
    words = prose(rng, 400).split()
    follow = {w: rng.sample(words, 3) for w in words}

    def text(n):
        w, out = rng.choice(words), []
        for _ in range(n):
            out.append(w)
            w = rng.choice(follow[w])
        return out

    rows = [(k, " ".join(text(80))) for k in range(300)]
    shuffled = {}
    for k in range(300, 400):  # half of them mixed up
        own = text(80)
        if k % 2:
            rng.shuffle(own)
        rows.append((k, " ".join(own)))
    got = {r.doc_id: r for r in lm_scoring.score_documents(frame(spark, rows)).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 300]
    mean = lambda x: sum(x) / len(x)
    assert mean([got[k].score for k in range(300, 400, 2)]) > mean([got[k].score for k in range(301, 400, 2)]) + 10
    assert mean([r.score for r in held]) > mean([r.base_score for r in held])
    again = {r.doc_id: r.score for r in lm_scoring.score_documents(frame(spark, rows).repartition(7)).collect()}
    assert again == {k: r.score for k, r in got.items()}
    # a text that stands elsewhere too is told apart from others
    rows = [(k, " ".join(rng.choice(words) for _ in range(80))) for k in range(200)]
    twice = rows + [(500 + k, rows[k][1]) for k in range(20)]
    got = {r.doc_id: r for r in lm_scoring.score_documents(frame(spark, twice)).collect()}
    assert min(got[k].score for k in range(20) if not _held(500 + k)) > max(got[k].score for k in range(20, 200))


def test_no_rows_and_no_training_rows(spark):
    assert lm_scoring.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    k = next(k for k in range(100) if _held(k))
    (r,) = lm_scoring.score_documents(frame(spark, [(k, "only this")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and r.score < 0
