"""Vector codes against plain Python, repeats against a search of all periods, token files against the tokenizer."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pyspark.sql import functions as F
from resonar.llm import rans
from resonar.llm.repeats import collapse_repeats, find_runs, periodic_runs, run_digests, with_repeats
from resonar.llm.token_files import BLOCK, TokenFile, read_tokens, token_digests, token_ids, tokens_at, write_tokens
from resonar.llm.vector_codes import compress_vectors, decode_vectors, encode_vectors

from .helpers import ODD, documents, frame, prose

BYTES = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int"


# ---- op11
def _codes_by_hand(rows, parts, entries, rounds):
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = [[tuple(v[p * d : p * d + d]) for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            sums = {}
            for c in cut:
                sums.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [tuple(sum(x) // len(x) for x in zip(*sums[k], strict=True)) if k in sums else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    got = [(i, y, "".join(f"{near(c[p], books[p])[1]:02x}" for p in range(parts)), sum(near(c[p], books[p])[0] for p in range(parts))) for (i, _, y), c in zip(kept, cut, strict=True)]
    by = {}
    for _, y, _, e in got:
        by[y] = by.get(y, 0) + e
    return sorted(((i, c, e, by[y], digest) for i, y, c, e in got), key=str)


def _vectors(n, seed=3, d=32):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=d).round(2).tolist(), [None, 0, 1][k % 3]) for k in range(n)]
    rows += [(n + k, rows[0][1], 2) for k in range(40)]  # copies
    rows += [(n + 50, None, 1), (n + 51, [None] + [0.0] * (d - 1), 1), (n + 52, [float("nan")] * d, 0), (n + 53, [float("inf")] * d, None)]
    return [*rows, (3, rows[3][1], 1), (3, rows[4][1], 1), (None, rows[5][1], None), (n + 60, [-0.001] * d, 0), (n + 61, [0.0] * d, 0)]


@pytest.mark.parametrize("common", [4096, 12, 1])
def test_codes_equal_plain_python(spark, common):
    rows = _vectors(150)
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("part", "key", "weight", "code", "error", "rid")})
    got = sorted((tuple(r) for r in compress_vectors(df, common=common, labels=0 if common == 1 else 100).collect()), key=str)
    assert got == _codes_by_hand(rows, 16, 64, 2)


def test_codes_with_other_parameters(spark):
    rows = _vectors(60, d=21)
    got = sorted((tuple(r) for r in compress_vectors(spark.createDataFrame(rows, VECTORS), parts=3, entries=5, rounds=4).collect()), key=str)
    assert got == _codes_by_hand(rows, 3, 5, 4)


def test_fewer_vectors_than_entries_and_none(spark):
    rows = _vectors(5)[:4]
    assert sorted((tuple(r) for r in compress_vectors(spark.createDataFrame(rows, VECTORS)).collect()), key=str) == _codes_by_hand(rows, 16, 64, 2)
    for none in ([], [(1, None, 3)]):
        out = compress_vectors(spark.createDataFrame(none, VECTORS))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.collect() == []


def test_vectors_that_cannot_be_cut_are_refused(spark):
    for rows in ([(1, [0.0] * 15, 1)], [(1, [0.0] * 16, 1), (2, [0.0] * 32, 1)], [(1, [1e9] * 16, 1)]):
        with pytest.raises(ValueError):
            compress_vectors(spark.createDataFrame(rows, VECTORS))


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rows = _vectors(120)[:120]
    made = encode_vectors(spark.createDataFrame(rows, VECTORS))
    assert made.parts.agg(F.sum("weight")).first()[0] == 120 * 16
    given = {i: np.floor(256 * np.float32(v).astype(float)) for i, v, _ in rows}
    for r in decode_vectors(made.vectors, made.books).collect():
        assert ((np.floor(256 * np.array(r["vector"])) - given[r["id"]]) ** 2).sum() == r["error"]


# ---- op12
def _all_runs(w, least=12):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q) and not any(all(w[k] == w[k + d] for k in range(s, s + 2 * q - d)) for d in range(1, q)):
                out.append((s, i - s + q, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def _repeating(rng, n, kinds):
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 4)):
        if n > 3:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            for i in range(a, min(n, a + rng.randint(p, 6 * p))):
                w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("least", [12, 2, 5, 30])
def test_runs_equal_a_search_of_all_periods(least):
    rng = random.Random(least)
    found = 0
    for _ in range(1500):
        w = _repeating(rng, rng.randint(0, rng.choice([20, 60, 250])), rng.choice([1, 2, 2, 3, 5, 40]))
        want = _all_runs(w, least)
        assert find_runs(np.array(w, np.int64), least) == want, w
        found += len(want)
    assert found > 300


def test_runs_of_long_texts():
    rng = random.Random(1)
    assert find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    assert find_runs(np.arange(60_000) % 7001) == [(0, 60_000, 7001)]
    half = [rng.randrange(1000) for _ in range(30_000)]
    assert find_runs(np.array([*half, *half])) == [(0, 60_000, 30_000)]
    assert find_runs(np.array([*half, 5000, *half])) == []


def _digest_by_hand(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(b"" if doc is None else str(doc).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = _all_runs(words)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None,) * 3
    left = [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]
    sha = lambda x: hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()
    return doc, len(runs), *top, top[1] and 1000 * top[1] // top[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(b" ".join(left))


def test_digests_equal_plain_python(spark):
    rows = [(k, t) for k, t in documents(n=60)] + [(1000 + k, "ab " * k + "\x85 \xa0 c") for k in range(30)] + ODD
    assert sum(with_repeats(k, list("abcdefgh")) != list("abcdefgh") for k, _ in rows) > 3
    got = sorted((tuple(r) for r in run_digests(frame(spark, rows), repeats=True).collect()), key=str)
    assert got == sorted((_digest_by_hand(*r) for r in rows), key=str)
    assert run_digests(frame(spark, [])).collect() == [] and periodic_runs(frame(spark, [])).collect() == []


def test_collapsed_texts_hold_no_runs_twice(spark):
    rows = [(1, "a b c " * 6 + "end"), (2, "no  run\there"), (3, None), (4, "")]
    out = {r["doc_id"]: r["text"] for r in collapse_repeats(frame(spark, rows)).collect()}
    assert out == {1: "a b c end", 2: "no  run\there", 3: None, 4: ""}
    assert [tuple(r) for r in periodic_runs(frame(spark, rows)).collect()] == [(1, 0, 18, 3)]


# ---- op13
def test_ids_equal_the_tokenizer():
    own = Tokenizer.from_file(BYTES)
    rng = random.Random(8)
    pool = [*"abcABCéßıſ中日ко한 \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 ​　﻿0123'.,;!?<|>-_", "  ", " \n", "'s", "'LL", "<|endoftext|>", "the", " the", "́"]
    for _ in range(4000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(token_ids(BYTES, text.encode()), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids, repr(text)


def test_blocks_decode_from_each_checkpoint():
    rng = np.random.default_rng(2)
    for kinds in (1, 2, 50_000):
        ids = np.minimum(rng.zipf(1.3, (3, 100, 8)) - 1, kinds - 1).astype(np.uint32)
        table = rans.Table.of_counts(np.bincount(ids.ravel(), minlength=kinds + 3))
        table = rans.Table.from_bytes(table.to_bytes())
        for own, (states, places, words) in zip(ids, rans.encode(table, ids, 16), strict=True):
            assert rans.decode(table, states, places, words, 16).reshape(-1, 8)[:100].tolist() == own.tolist()
            assert rans.decode(table, states[3:4], places[3:4], words, 16)[0].tolist() == own[48:64].tolist()
    entropy = -np.log2(table.freq[ids.astype(int)] / rans.TOTAL).sum() / 8
    assert sum(4 * len(w) for _, _, w in rans.encode(table, ids, 1000)) < 1.02 * entropy + 3 * 8 * 8
    with pytest.raises(ValueError):
        rans.encode(table, np.full((1, 1, 8), kinds + 2, np.uint32), 16)


def _ids_by_library(rows):
    own = Tokenizer.from_file(BYTES)
    out, start = [], 0
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_give_back_what_was_written(spark, tmp_path):
    rng = random.Random(9)
    rows = [*documents(n=60), (2000, prose(rng, 40_000)), (2001, "tail"), (1999, "x " * 70_000)]
    for k, how in enumerate(({}, {"file_tokens": 20_000})):
        got = token_digests(frame(spark, rows).repartition(5), BYTES, f"file://{tmp_path}/{k}", **how)
        # the rows of one id stand in the order of their place, which the equal texts of this id hide
        assert [tuple(r) for r in got.orderBy("start").collect()] == _ids_by_library(rows)
    manifest = json.loads((tmp_path / "1" / "manifest.json").read_text())
    assert len(manifest["files"]) > 3
    for split in (1, 2, 1000):
        assert sorted(map(tuple, read_tokens(spark, f"{tmp_path}/0", split=split).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()), key=lambda r: r[1]) == _ids_by_library(rows)
    whole = np.concatenate([np.frombuffer(r[0], "<u4") for r in read_tokens(spark, f"{tmp_path}/1").orderBy("start").select("ids").collect()])
    assert len(whole) > 3 * BLOCK
    for start, n in ((0, 5), (BLOCK - 3, 9), (8191, 3), (len(whole) - 2, 10), (17, 2 * BLOCK), (len(whole), 4)):
        for k in (0, 1):
            assert tokens_at(f"{tmp_path}/{k}", start, n).tolist() == whole[start : start + n].tolist()


def test_damaged_files_and_empty_tables(spark, tmp_path):
    write_tokens(frame(spark, []), BYTES, f"{tmp_path}/none")
    assert read_tokens(spark, f"{tmp_path}/none").collect() == []
    folder = f"{tmp_path}/some"
    write_tokens(frame(spark, documents(n=20)), BYTES, folder)
    with pytest.raises(ValueError):
        write_tokens(frame(spark, documents(n=20)), BYTES, folder)
    entry = json.loads((tmp_path / "some" / "manifest.json").read_text())["files"][0]
    crc = zlib.crc32((tmp_path / "some" / "table.bin").read_bytes())
    file = TokenFile(folder, entry["name"], crc)
    assert file.block(0).tokens == entry["tokens"]
    path = tmp_path / "some" / entry["name"]
    data = bytearray(path.read_bytes())
    data[int(file.index["at"][0]) + 500] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(ValueError):
        TokenFile(folder, entry["name"], crc).block(0)
    with pytest.raises(Exception, match="checksum"):
        read_tokens(spark, folder).collect()
