"""The corpus operators where a bound once held part of the job back."""

import math
import random

import pytest

from scriptorium.llm import language_model
from scriptorium.llm.components import components


def test_language_model_filter_by_ranges(spark):
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeiorst") for _ in range(6)) for _ in range(900)]
    rows = [(i if i % 50 else None, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 300)))) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {}
    for bits in (language_model.BROADCAST_BITS, 1 << 10):
        model, rare = language_model.train(docs, heavy=40, broadcast_bits=bits)
        assert int(model.sizes.sum()) > 8 * 64  # bits: the filter follows its events past the bound
        assert (len(model.bits) == 0) == (bits == 1 << 10)
        got[bits] = sorted((tuple(r) for r in language_model.score(docs, model, rare).collect()), key=repr)
    whole, parts = got.values()
    assert len(whole) == len(parts) == len(rows)
    for a, b in zip(whole, parts, strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_components_settle_or_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    with pytest.raises(RuntimeError, match="settled"):
        components(chain, rounds=1)
    assert sorted(map(tuple, components(chain).collect())) == [(i, 0) for i in range(13)]
    assert components(chain.limit(0), rounds=1).count() == 0
