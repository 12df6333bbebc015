from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from resonar.llm import quality_model, secrets
from resonar.llm.line_dedup import MIN_SITES

from .helpers import SCHEMA, documents
from .test_near import _by_brute_force


def _tables(spark, tmp_path, full, labels):
    docs = spark.createDataFrame(full, SCHEMA).withColumns({c: F.lit(7) for c in ("rid", "first", "n_removed", "_file", "spans", "length", "score")})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def _key(r):
    return str(r.doc_id), r.text, r.source


def _lines_by_brute_force(rows):
    """rows in order of their ids, nulls first: without lines of many sites but at their first place."""
    sites = {}
    for r in rows:
        for x in (r.text or "").split("\n"):
            sites.setdefault(x.strip(" "), set()).add(r.source or "")
    seen, out = set(), Counter()
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        if r.text is None:
            out[_key(r)] += 1
            continue
        kept, gone = [], 0
        for x in r.text.split("\n"):
            k = x.strip(" ")
            if k and len(sites[k]) >= MIN_SITES:
                if k in seen:
                    gone += 1
                    continue
                seen.add(k)
            kept.append(x)
        text = "\n".join(kept)
        if not gone or text.strip(" "):
            out[str(r.doc_id), text, r.source] += 1
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    rows = documents(n=30)
    full = [(k, t, "en", f"s{(k or 0) % 9}", len(t or "")) for k, t in rows]
    full += [(980 + k, f"own text {k} of this one\n shared by many sites here", "en", f"s{k}", 50) for k in range(8)]
    full += [(700 + k, "!!! $$$ ### %%% buy now " * 6 + str(k), "en", "spam", 9) for k in range(12)]
    full += [(None, rows[0][1], "en", "s1", 1), (990, f"{rows[1][1]} token = '0123456789abcdef0123' more", "en", "s2", 1)]
    labels = [(k, 1, 0) for k in range(40)] + [(700 + k, 0, 0) for k in range(12)]
    docs = _tables(spark, tmp_path, full, labels)
    stages = dict(corpus_pipeline.STAGES)

    def run(name):
        nonlocal docs
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{name}")
        assert all(r.rid == r.spans == r.score == 7 for r in docs.collect())
        return before, docs.collect()

    model = quality_model.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    before, after = run("quality")
    assert Counter(map(_key, after)) == Counter(_key(r) for r in before if model.score((r.text or "").encode()) >= 0.5)
    assert not any(r.source == "spam" for r in after) and sum(r.source != "spam" for r in before) == len(after)

    before, after = run("lines")
    assert Counter(map(_key, after)) == _lines_by_brute_force(before)
    assert all(r.n_chars == len(r.text) for r in after if r.text and "own text" in r.text and "shared" not in r.text)

    before, after = run("near_duplicates")
    groups, _ = _by_brute_force([(r.doc_id, r.text) for r in before])
    worded = [bool((r.text or "").split()) for r in before]
    want = {}
    for g, r, w in zip(groups, before, worded, strict=True):
        if w:
            want[g] = min(want.get(g, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    kept = Counter((r.doc_id is None, r.doc_id or 0) for r in after if (r.text or "").split())
    assert kept == Counter(want.values()) and len(after) == len(want) + worded.count(False)

    model, threshold = secrets.trained(docs)
    before, after = run("secrets")
    clean = lambda t: None if t is None else secrets.redact_text(t, secrets.scan_texts([t], model, threshold)[0][1])
    assert Counter(map(_key, after)) == Counter((str(r.doc_id), clean(r.text), r.source) for r in before)
    assert any("<SECRET>" in (r.text or "") for r in after) and not any("0123456789abcdef" in (r.text or "") for r in after)

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = stages["packing"](spark, docs, str(tmp_path)).collect()
    sizes = Counter(len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in after)
    whole = Counter()
    for r in out:
        whole[r.doc_id, r.start - r.piece * 4096, r.length if r.piece == 0 else 0] += 1
    assert sum(r.length for r in out) == sum(n * c for n, c in sizes.items())
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [a for a, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 4096

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in out)


def test_empty_tables(spark, tmp_path):
    _tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
