"""The quality model learns from all labelled documents, however many there are."""

import zlib

import numpy as np

from resonar.llm import quality_model

from .helpers import frame


def _rows(n):
    return [(k, f"own{k} some text {'buy now !!' if k % 4 == 0 else 'of plain words'} here") for k in range(n)]


def test_every_labelled_document_is_learnt_from(spark):
    rows = _rows(600)
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k, _ in rows], "doc_id long, quality int")
    model = quality_model.train(frame(spark, rows + rows[:50]), labels, group=100)
    own = {k: zlib.crc32(f"own{k}".encode()) & ((1 << quality_model.WORD_BITS) - 1) for k, _ in rows}
    taught = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    assert len(taught) > 350 and all(model.weight[own[k]] for k in taught)
    others = {own[k] for k in own} - {own[k] for k in taught}
    assert others and not model.weight[sorted(others)].any()
    held = [(k, t) for k, t in rows if k not in set(taught)]
    assert all((model.score(t.encode()) >= 0.5) == (k % 4 != 0) for k, t in held)
    # one group's model is that of all rows fitted at once; the mean of many does not depend on the layout
    again = quality_model.train(frame(spark, rows).repartition(7), labels, group=100)
    assert np.array_equal(model.weight, again.weight) and np.array_equal(model.latent, again.latent) and model.bias == again.bias
    whole = quality_model.train(frame(spark, rows), labels)
    both = [(*quality_model.features(t.encode()), int(k % 4 != 0)) for k, t in rows if k in set(taught)]
    both.sort(key=lambda r: (r[0].astype("<i4").tobytes(), *r[1:]))
    assert np.allclose(whole.weight, quality_model.fit(both).weight, atol=1e-8) and not np.allclose(whole.weight, model.weight, atol=1e-3)
