"""Piece encoding, vector codes and target encoding against the library and brute force; films of several tracks; many languages."""

import hashlib
import random
import struct
import tracemalloc
import zlib
from datetime import datetime, timedelta

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import language_id, media, sentence_pieces, target_encoding, vector_codes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PIECES = sentencepiece.SentencePieceProcessor(model_file=MODEL)

# ---- pieces


def _table():
    with open(MODEL, "rb") as f:
        return sentence_pieces.ChunkTable(f.read())


TABLE = _table()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "▁", "\n", "\t", " ", "ab", "Straße", "é", "日本", "①", "</s>", "<0x0A>", "\0", "the"]), max_size=12).map("".join), max_size=6))
def test_pieces_as_the_library(texts):
    assert [x.tolist() for x in TABLE.encode([*texts, None])] == [*PIECES.encode(texts), []]


def test_a_full_table_changes_nothing():
    table = _table()
    table.CAPACITY = table.MOST_IDS = 20
    texts = [f"wort{i} und  noch {i % 7} " for i in range(200)]
    for n in (1, 7, 200):
        got = [x for a in range(0, 200, n) for x in table.encode(texts[a : a + n])]
        assert [x.tolist() for x in got] == PIECES.encode(texts)


def test_a_model_that_may_not_be_cut_gets_whole_texts():
    table = _table()
    table.cut = False
    texts = ["", "a  b", " x ", "eins zwei drei", None]
    assert [x.tolist() for x in table.encode(texts)] == [PIECES.encode(t or "") for t in texts]


def test_piece_frames(spark):
    long = "xé " * 40_000 + "y" * 50_000
    rows = [(0, None, "s"), (1, "", "s"), (2, " a  b\n", None), (None, "ohne Nummer", "s"), (3, long, "s"), (2, " a  b\n", None)]
    docs = spark.createDataFrame([(i, t, x, "clash", 7) for i, t, x in rows], "doc_id long, text string, source string, ids string, n_tokens int")
    want = []
    for i, t, _ in rows:
        ids = PIECES.encode(t or "") + [2]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(PIECES.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, sentence_pieces.digests(docs, MODEL).collect()), key=repr) == sorted(want, key=repr)
    encoded = sentence_pieces.encode(docs, MODEL, end=False)
    assert {(r.doc_id, tuple(r.ids)) for r in encoded.collect()} == {(i, tuple(PIECES.encode(t or ""))) for i, t, _ in rows}
    assert {(r.doc_id, r.text) for r in sentence_pieces.decode(encoded, MODEL).collect()} == {(i, PIECES.decode(PIECES.encode(t or ""))) for i, t, _ in rows}
    assert sentence_pieces.digests(docs.limit(0), MODEL).count() == 0


# ---- vectors


def _brute(x, entries):
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 20), st.integers(1, 12), st.integers(0, 40), st.sampled_from([0, 1, 3, 1000, 1 << 26]), st.integers(0, 1 << 30))
def test_nearest_as_brute_force(width, entries, rows, top, seed):
    rnd = np.random.default_rng(seed)
    c, x = rnd.integers(-top, top + 1, (entries, width)), rnd.integers(-top, top + 1, (rows, width))
    c[-1] = c[0]  # a tie
    x[: min(rows, entries)] = c[: min(rows, entries)]
    got, want = vector_codes.Nearest(c).find(x), _brute(x, c)
    assert got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()


def _coded(rows):
    kept = [(i, np.floor(1024 * np.array(v, float)).astype(np.int64), label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), 4, -1)
    books = x[:256].transpose(1, 0, 2).copy()
    for _ in range(4):
        for p in range(4):
            own, _ = _brute(x[:, p], books[p])
            for e in set(own.tolist()):
                books[p, e] = x[own == e, p].sum(0) // (own == e).sum()
    found = [_brute(x[:, p], books[p]) for p in range(4)]
    error = sum(d for _, d in found)
    labels = [label for _, _, label in kept]
    return [(i, "".join(f"{j[n]:02x}" for j, _ in found), int(error[n]), sum(int(e) for e, m in zip(error, labels, strict=True) if m == label)) for n, (i, _, label) in enumerate(kept)], books


def test_vector_codes(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.normal(0, 1, 12).round(2).tolist(), [None, 1, 2, 2][i % 4]) for i in range(700)]
    rows += [(5, rows[5][1], 1), (3, [0.5] * 12, None), (None, [0.25] * 12, 1), (900, None, 1), (901, [float("nan")] + [0.0] * 11, 1), (902, [float("-inf")] + [0.0] * 11, 1), (903, [None] + [0.0] * 11, None)]
    rows += [(1000 + i, [0.125] * 12, 1) for i in range(40)]
    frame = spark.createDataFrame([(i, v, label, "clash", 3) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(5)
    want, books = _coded([(i, None if v is None else np.array([np.nan if c is None else c for c in v], np.float32), label) for i, v, label in rows])
    table = vector_codes.integers(frame)
    got = vector_codes.train(table)
    assert np.array_equal(got.entries, books) and got.digest() == hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = vector_codes.encode(table, got)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.with_label_error(coded).collect()), key=repr) == sorted(want, key=repr)
    back = {r.vec_id: r.vector for r in vector_codes.decode(coded, got).collect()}
    x = {i: np.floor(1024 * np.float32(v).astype(float)) for i, v, _ in rows if i is not None and i < 700 and i not in (3, 5)}
    errors = {i: e for i, _, e, _ in want}
    assert all(((1024 * np.array(back[i]) - x[i]) ** 2).sum() == errors[i] for i in x)


def test_vector_tables_of_few_and_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    empty = vector_codes.integers(spark.createDataFrame([(1, None, 1)], schema))
    assert vector_codes.with_label_error(vector_codes.encode(empty, vector_codes.train(empty))).count() == 0
    few = vector_codes.integers(spark.createDataFrame([(2, [1.0] * 4, 1), (1, [-1.0] * 4, None)], schema))
    assert sorted((r.vec_id, r.code, r.error) for r in vector_codes.encode(few, vector_codes.train(few)).collect()) == [(1, "00000000", 0), (2, "01010101", 0)]
    for rows, match in (([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], "equal parts"), ([(1, [1.0] * 6, 1)], "equal parts")):
        with pytest.raises(ValueError, match=match):
            vector_codes.train(vector_codes.integers(spark.createDataFrame(rows, schema)))
    with pytest.raises(Exception, match="too large"):
        vector_codes.integers(spark.createDataFrame([(1, [1e30] * 4, 1)], schema))


# ---- target encoding


def _told(lines, sales, items, vendors, clients):
    held = {s[0]: s for s in sales if s[0] is not None and s[2] is not None}
    dim = lambda rows: {k: v for k, v in rows if k is not None}
    kind, nation, segment = dim(items), dim(vendors), dim(clients)
    events = []
    for sale, item, vendor, flag in lines:
        if sale in held:
            client = -1 if held[sale][1] is None else held[sale][1]
            item = -1 if item is None else item
            fold = zlib.crc32(str(sale).encode()) % 5
            events.append((sale, item, vendor, held[sale][2], fold, flag == "returned", {"item": item, "vendor": vendor, "client": client, "kind": kind.get(item), "nation": nation.get(vendor), "segment": segment.get(client), "all": 0}))
    out = {}
    for sale, item, vendor, t, fold, _, keys in events:
        before = [e for e in events if e[3] < t and e[4] != fold]
        count = {k: (sum(e[6][k] == v for e in before), sum(e[5] for e in before if e[6][k] == v)) for k, v in keys.items()}
        rate = lambda k, p: p if count[k][0] < 1 else (1_000_000 * count[k][1] + 50 * p) // (count[k][0] + 50)  # noqa: B023, E731
        p = rate("all", 500_000)
        own = [e for e in events if e[:3] == (sale, item, vendor)]
        out[sale, item, vendor] = (len(own), sum(e[5] for e in own), count["item"][0], rate("item", rate("kind", p)), count["vendor"][0], rate("vendor", rate("nation", p)), count["client"][0], rate("client", rate("segment", p)))
    return out


def test_target_encoding(spark):
    rnd = random.Random(8)
    begin = datetime(2024, 1, 1)
    sales = [(i, rnd.choice([None, 1, 1, 1, 2, 3, 99]), rnd.choice([None, *[begin + timedelta(seconds=rnd.randint(0, 60), microseconds=rnd.choice([0, 0, 1]))] * 9, begin])) for i in range(150)] + [(None, 1, begin)]
    pick = lambda n: rnd.choice([None, 1, 1, 1, *range(n)])
    lines = [(rnd.choice([None, 7, 7, *range(0, 170)]), pick(12), pick(5), rnd.choice(["returned", "kept", None])) for _ in range(900)]
    items = [(i, rnd.choice([None, "a", "b"])) for i in range(10)] + [(None, "a")]
    vendors = [(i, rnd.choice([None, 4, 5])) for i in range(4)]
    clients = [(i, rnd.choice([None, "x", "y"])) for i in range(4)] + [(-1, "y")]
    frames = [
        spark.createDataFrame([(*r, "clash", 1) for r in lines], "sale_id long, item_id long, vendor_id long, flag string, fold string, n int").repartition(3),
        spark.createDataFrame(sales, "sale_id long, client_id long, sold_at timestamp_ntz"),
        spark.createDataFrame(items, "item_id long, kind string"),
        spark.createDataFrame(vendors, "vendor_id long, nation_id int"),
        spark.createDataFrame(clients, "client_id long, segment string"),
    ]
    want = _told(lines, sales, items, vendors, clients)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for chunks in (1, 4, 61):  # keys and equal times that straddle many chunks
            spark.conf.set("spark.sql.shuffle.partitions", chunks)
            rows = target_encoding.encoded_lines(*frames).collect()
            assert len(rows) == len(want)
            assert {tuple(r)[:3]: tuple(r)[3:] for r in rows} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for n in range(5):
        assert target_encoding.encoded_lines(*[f.limit(0) if i == n else f for i, f in enumerate(frames)]).count() == (0 if n < 2 else len(want))


def test_histories_of_any_events(spark):
    rnd = random.Random(1)
    rows = [(i, i, rnd.randint(0, 20), rnd.randint(0, 2), rnd.randint(1, 3), rnd.randint(0, 1), rnd.choice(["k", None, "l"])) for i in range(400)]
    events = spark.createDataFrame(rows, "id long, tag long, t long, fold int, n long, s long, key string")
    long = target_encoding.long_form(events, ["key"], 0, id_col="id", tag_col="tag", time_col="t", fold_col="fold", n_col="n", s_col="s")
    got = {r.rid: (r.before_n, r.before_s) for r in target_encoding.scanned(long, folds=3).collect()}
    for i, _, t, fold, _, _, key in rows:
        past = [r for r in rows if r[2] < t and r[3] != fold and r[6] == key]
        assert got[i] == (sum(r[4] for r in past), sum(r[5] for r in past))


# ---- films and languages


def _trak(offsets, sizes, *, keys=None, wide=False, codec=b"mp4a", scale=1000, delta=10):
    table = lambda kind, skip, a, form: media._full(kind, skip, struct.pack(">I", len(a)), np.array(a, form).tobytes())
    stbl = media._box(
        b"stbl",
        media._full(b"stsd", struct.pack(">I", 1), media._box(codec, bytes(28))),
        media._full(b"stts", struct.pack(">III", 1, len(sizes), delta)),
        media._full(b"stsc", struct.pack(">IIII", 1, 1, 1, 1)),
        table(b"stsz", struct.pack(">I", 0), sizes, ">u4"),
        *([table(b"stss", b"", keys, ">u4")] if keys else []),
        table(b"co64" if wide else b"stco", b"", offsets, ">u8" if wide else ">u4"),
    )
    return media._box(b"trak", media._box(b"mdia", media._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, scale, 0, 0, 0)), media._box(b"minf", stbl)))


def test_every_track_by_its_own_tables(spark):
    sound, film = [bytes([i]) * (i + 1) for i in range(40)], [bytes([100 + i]) * 7 for i in range(9)]
    parts = [x for i in range(40) for x in ([sound[i]] + ([film[i // 4]] if i % 4 == 0 and i < 36 else []))]  # interleaved
    data, at = b"".join(parts), 8
    places = {"sound": [], "film": []}
    for i in range(40):
        places["sound"].append(at)
        at += len(sound[i])
        if i % 4 == 0 and i < 36:
            places["film"].append(at)
            at += 7
    mdat = media._box(b"mdat", data)
    tracks = [_trak(places["sound"], [len(x) for x in sound]), _trak(places["film"], [7] * 9, keys=[1, 4, 8], wide=True, codec=b"avc1", scale=600, delta=25)]
    for order in ((0, 1), (1, 0)):
        whole = mdat + media._box(b"moov", media._box(b"udta", b"x" * 9), *[tracks[i] for i in order])
        found = media.inspect(whole)
        assert [(t["codec"], t["timescale"], t["duration"], len(t["keys"])) for t in found] == [(("mp4a", 1000, 400, 40), ("avc1", 600, 225, 3))[i] for i in order]
        assert media.payload(whole, found) == b"".join(b"".join((sound, film)[i]) for i in order)
        frames = [",".join(f"{places['sound'][i]}+{i + 1}" for i in range(40)), ",".join(f"{places['film'][i]}+7" for i in (0, 3, 7))]
        assert [t.rpartition("=")[2] for t in media.feature(found).split("|")] == [frames[i] for i in order]
    odd = mdat + media._box(b"moov", media._box(b"trak", media._box(b"mdia", b"")), tracks[0])
    row = media.media_features(spark.createDataFrame([(1, bytearray(odd))], "id int, media binary")).first()
    assert row.error and row.feature is None


def test_many_languages_in_bounded_memory():
    rnd = np.random.default_rng(5)
    say = lambda k, n: bytes(97 + (rnd.integers(0, 6, n) * (k % 4 + 1) + k) % 26).decode()
    texts = {f"l{k:03}": [say(k, 1500).encode() for _ in range(3)] for k in range(300)}
    model = language_id.Model(texts)
    few = language_id.Model({k: texts[k] for k in list(texts)[:4]})
    assert (few.piece, few.memo_bits) == (language_id.PIECE, 18)
    long = say(7, 900_000).encode()
    model.code_lengths([b"x"])
    tracemalloc.start()
    got = model.code_lengths([long, texts["l007"][0]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20
    plain = np.array([t.bits(language_id._windows(np.frombuffer(b"\0" * model.order + long, np.uint8), model.order + 1)[model.order :]).sum() for t in model.trees[:3]])
    assert np.allclose(got[0, :3], plain) and got[1].argmin() % 4 == 7 % 4


def test_the_sample_is_shared_by_languages(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_ALL", 4000)
    docs = spark.createDataFrame([(i, f"{'abcdefgh'[i % 4] * 10} {i:05}" * 8, f"l{i % 4}") for i in range(400)], "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert model.languages == ["l0", "l1", "l2", "l3"]
    assert all(tree.levels[0]["counts"].sum() <= 1000 for tree in model.trees)
    assert {r.lang_pred for r in language_id.identify(docs.filter(F.col("lang") == "l2"), model).collect()} == {"l2"}
