"""What a worker of packing holds is bounded by parameters, and results do not depend on them."""

import random

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from scriptorium.llm import packing
from scriptorium.llm.pieces import AT_ONCE, MEMO, LibraryEncoder

JSON = public_tokenizers.path("byte_bpe_50k.json")


def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéß日 \n'1") for _ in range(rnd.randint(1, 9)))
    return [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(120)] + ["", None, "x" * 5000, "a  b\n\n c " * 300, None, ""]


def test_texts_encoded_together_are_bounded():
    rows, at_once, capacity = texts(), 700, 40
    size = [len((t or "").encode()) for t in rows]
    encoder, seen = LibraryEncoder(JSON, capacity, at_once), []
    inner = encoder.memo._encode
    encoder.memo._encode = lambda column: seen.append([len(x.encode()) for x in column.to_pylist()]) or inner(column)
    got = encoder.encode(pa.array(rows))
    assert [s for part in seen for s in part] == size
    assert max(sum(part) - max(part) for part in seen) < at_once  # one text over it at most
    lib = Tokenizer.from_file(JSON)
    assert [list(memoryview(g).cast("I")) for g in got] == [lib.encode(t or "", add_special_tokens=False).ids for t in rows]
    assert got == LibraryEncoder(JSON).encode(pa.array(rows))
    assert encoder.encode(pa.array([None, "", None], pa.string())) == [b"", b"", b""]


def test_pipeline_packs_within_small_bounds(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(3, "doc_id")
    given = {}
    whole = packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **k: given.update(k) or whole(*a, **k))
    small = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert given["memo"] <= MEMO // 3 and given["at_once"] <= AT_ONCE // 8
    tight = whole(docs, JSON, memo=30, at_once=500).collect()
    assert sorted(small) == sorted(tight) == sorted(whole(docs, JSON).collect())
