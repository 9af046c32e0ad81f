"""The corpus operators against brute force, round trips and held-out labels, on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from scriptorium.llm import byte_bpe, jaccard_join, language_id, language_model, media, packing, quality_rules, token_files, toxicity, warc
from scriptorium.llm.common import fold
from scriptorium.llm.pieces import library_encoder

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, extra int, score string, n_tokens string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdeiorst") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    out = [None, "", " \n\t ", "one two", "  a  b\n\n c", "x" * 3000, "ünï çødé 日本語 ’s 12 !!", "<|endoftext|> it's", say(9000)]
    base = say(120)
    for i in range(12):  # near copies
        w = base.split()
        for _ in range(i % 4):
            w[rnd.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    out += [base] * 5 + [say(rnd.randint(1, 200)) for _ in range(40)] + ["one two"]
    return [(i, t, "en" if i % 2 else None, "s", 1, "clash", "clash") for i, t in enumerate(out)] + [(None, "no id here", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language_code_lengths():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("abc ") for _ in range(60)).encode() for _ in range(4)]
    tree, order = language_id.ContextTree(texts, 2), 2
    seen = [Counter() for _ in range(order + 1)]
    for t in texts:
        t = b"\0" * order + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                seen[k][t[i - k : i], t[i]] += 1

    def cost(context, symbol):
        bits, out = 0.0, set()
        for k in range(order, -1, -1):
            c = context[order - k :]
            here = {s: n for (x, s), n in seen[k].items() if x == c}
            if not here:
                continue
            left = {s: n for s, n in here.items() if s not in out}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return bits + math.log2(total / left[symbol])
            bits += math.log2(total / len(left)) if left else 0
            out |= set(here)
        return bits + math.log2(256 - len({s for _, s in seen[0]}))

    probe = b"\0\0abcaXbb ca"
    grams = np.array([int.from_bytes(probe[i - 2 : i + 1], "big") for i in range(2, len(probe))], np.uint64)
    assert np.allclose(tree.bits(grams), [cost(probe[i - 2 : i], probe[i]) for i in range(2, len(probe))])


def test_language_of_long_texts():
    texts = ["der hund und die katze " * 30, "the dog and the cat " * 30]
    model = language_id.Model({"de": [texts[0].encode()], "en": [texts[1].encode()]})
    long = (texts[1] * 4000)[: 2 * language_id.PIECE + 17].encode()
    parts = [long[a : a + 1000] for a in range(0, len(long), 1000)]
    whole = model.code_lengths([b"x", long, b"the dog", long[:5]])
    plain = [sum(t.bits(language_id._windows(np.frombuffer(b"\0" * 3 + long, np.uint8), 4)[3:][i : i + 4096]).sum() for i in range(0, len(long), 4096)) for t in model.trees]
    assert np.allclose(whole[1], plain) and len(parts) > 2000
    assert np.allclose(whole[[0, 2, 3]], model.code_lengths([b"x", b"the dog", long[:5]]))


def test_language_predictions_by_brute_force(spark, docs, rows):
    """Each prediction against code lengths summed byte by byte, and their posterior."""
    known = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate([("der hund und die katze sind im haus", "de"), ("the dog and the cat are in the house", "en"), ("le chien et le chat sont dans la maison", "fr")] * 5)], "doc_id long, text string, lang string")
    model = language_id.train(known)
    text = {r[0]: r[1] for r in rows}
    for r in language_id.identify(docs, model).collect():
        t = text[r.doc_id]
        if not t or not any(map(str.isalpha, t)):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        if len(t) > 2000:
            continue
        raw = b"\0" * 3 + t.encode()
        bits = [sum(float(tree.bits(np.array([int.from_bytes(raw[i : i + 4], "big")], np.uint64))[0]) for i in range(len(raw) - 3)) for tree in model.trees]
        best = min(bits)
        assert bits[model.languages.index(r.lang_pred)] <= best + 1e-6
        assert math.isclose(r.score, 1 / sum(2.0 ** max(best - b, -1000) for b in bits), rel_tol=1e-6)


def test_language(spark, docs, empty):
    texts = [("der hund und die katze sind im haus " * 3, "de"), ("the dog and the cat are in the house " * 3, "en")] * 20
    known = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.train(known)
    assert language_id.Model({}).predict(["abc"])[0] == ["und"]
    assert model.predict(["die katze", "the house", "12 !", None])[0] == ["de", "en", "und", "und"]
    assert language_id.identify(docs, model).count() == docs.count()
    assert language_id.identify(empty, language_id.train(empty)).count() == 0
    assert language_id.accepted(docs, model).columns == docs.columns


def test_byte_bpe(docs, rows, empty):
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.digests(docs, RANKS).collect())
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    want = Counter()
    for r in rows:
        ids = lib.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    assert got == want
    assert byte_bpe.digests(empty, RANKS).count() == 0


def test_token_files(docs, rows, empty):
    lib, start, want = Tokenizer.from_file(JSON), 0, []
    for r in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(array("I", ids).tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_files.read_files(token_files.write_files(docs, JSON)).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_files.read_files(token_files.write_files(empty, JSON)).count() == 0


@pytest.mark.parametrize("ids", [[], [5], [2**32 - 1, 0, 7] * 100, list(range(1000))])
def test_patched_blocks(ids):
    ids = np.array(ids, np.uint32)
    assert (token_files.Packed(token_files.pack(ids)).all() == ids).all()


def test_language_model(spark, docs, rows, empty):
    model, rare = language_model.train(docs.filter(fold("doc_id", 7) != 2), heavy=40)
    assert rare.count() > 0
    got = language_model.score(docs, model, rare).collect()
    train = Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for r in rows:
        if not held(r[0]):
            train.update([*words(r[1]), None])
    n, v = sum(train.values()), len(train)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        tokens = [*words(text[r.doc_id]), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
    # the score against the formula with exact counts; so many bits that no probe is false, counts over 50 rounded
    model, rare = language_model.train(docs.filter(fold("doc_id", 7) != 2), bits_per_event=100)
    assert model.false < 1e-6
    pairs = Counter()
    for r in rows:
        if not held(r[0]):
            tokens = [None, *words(r[1]), None]
            pairs.update(zip(tokens, tokens[1:], strict=False))
    cell = lambda c: language_model._MEAN[np.searchsorted(language_model._LEAST, c, "right")]
    for r in language_model.score(docs, model, rare).collect():
        tokens = [None, *words(text[r.doc_id]), None]
        p = [(min(cell(pairs[v, w]), train[v], train[w]) + language_model.MU * (train[w] + 1) / (n + v_count + 1)) / (train[v] + language_model.MU) for v_count in [len(train)] for v, w in zip(tokens, tokens[1:], strict=False)]
        assert math.isclose(r.score, sum(map(math.log10, p)), rel_tol=1e-6)
    model, rare = language_model.train(empty)
    assert language_model.score(empty, model, rare).count() == 0


def test_language_model_sums_to_one(spark):
    """After rare and common words, the probabilities of all words sum to 1."""
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [" ".join(vocabulary[min(3999, int(rnd.paretovariate(0.6)))] for _ in range(200)) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _ = language_model.train(docs)
    seen = Counter(w for t in texts for w in t.split())
    hasher = language_model.WordHasher()
    every = np.append(hasher(" ".join(seen)), language_model.END)
    common = [w for w, _ in seen.most_common(6)]
    rare = [w for w, c in seen.items() if c in (1, 2, 7, 30)][:30]
    for v in common + rare:
        before = np.repeat(hasher(v), len(every))
        assert abs(model.probability(before, every).sum() - 1) < 0.01, (v, seen[v])


def test_counts_are_read_back():
    """Cells hold each count, and probing finds the cell of any count."""
    n = np.array([1, 2, 9, 10, 11, 12, 13, 100, 5000, 10**6, 10**10])
    q = np.searchsorted(language_model._LEAST, n, "right")
    assert (language_model._MEAN[q][n <= 13] == n[n <= 13]).all()
    assert (abs(language_model._MEAN[q] - n) <= 0.013 * n).all()
    keys = np.arange(1, len(n) + 1, dtype=np.uint64) * np.uint64(1 << 30)
    flags = np.zeros(1 << 18, bool)
    for k, most in zip(keys, q, strict=True):
        for j in range(1, most + 1):
            for at in language_model._places(np.array([k]), j, len(flags), language_model.FIRST if j == 1 else language_model.LATER):
                flags[at.astype(np.int64)] = True
    bits = np.packbits(flags, bitorder="little")
    ask = np.append(keys, np.uint64(5))
    assert language_model._steps(ask, bits).tolist() == [*q.tolist(), 0]


def test_ftrl_by_brute_force():
    """Steps of FTRL-proximal as published, coordinate by coordinate."""
    rnd = random.Random(6)
    a, b, l1, l2, size = 0.5, 1.0, 0.3, 1.0, 12
    model = toxicity.Ftrl(size, a, b, l1, l2)
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for _ in range(200):
        x, y, much = sorted(rnd.sample(range(size), rnd.randint(0, 5))), rnd.randint(0, 1), rnd.choice([1.0, 2.5])
        model.learn(np.array(x, np.int64), y, much)
        at = [*x, size]
        w = [weight(i) for i in at]
        g = (1 / (1 + math.exp(-sum(w))) - y) * much
        for i, own in zip(at, w, strict=True):
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a
            z[i] += g - sigma * own
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    assert np.allclose(model.weights(slice(None)), [weight(i) for i in range(size + 1)])


def test_toxicity_scores_by_brute_force():
    """Scores from the weights of plainly hashed features."""
    texts = ["you idiot, go away!", "A nice  day", "", None, "idiot idiot idiot day", "the quick brown fox"]
    model = toxicity.fit([(t, int("idiot" in (t or ""))) for t in texts * 6], bits=16)
    weights = dict(zip(model.features.tolist(), model.weights, strict=True))
    mask = (1 << 64) - 1
    for t, score in zip(texts, model.score(texts), strict=True):
        words = [toxicity.xxhash.xxh3_64_intdigest(w.strip(toxicity._STRIP) or w) for w in (t or "").lower().encode().split()]
        first, second = int(toxicity._A), int(toxicity._B)
        features = {w * first & mask for w in words}
        for gap in (1, 2):
            features |= {((v * first & mask) ^ ((w + gap) * second & mask)) * first & mask for v, w in zip(words, words[gap:], strict=False)}
        total = model.bias + sum(weights.get(f >> 48, 0.0) for f in {f >> 48 << 48 for f in features})
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_toxicity(spark, docs, empty):
    rnd = random.Random(2)
    texts = [(i, " ".join(rnd.choice(["red", "blue", "tree", "sky", "road", "song"]) for _ in range(30)) + (" idiot moron" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    known = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    model = toxicity.train(known, spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int"))
    right = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in toxicity.score(known, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(right) / len(right) > 0.95
    assert len(model.features) < 2000
    assert toxicity.score(docs, model).count() == docs.count()
    none = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score([None, "x"]).tolist() == [0.5, 0.5]


def test_warc_files_and_audit(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "<p>é\r\n\r\nWARC/1.1</p>" * (i % 5)) for i in range(300)] + [(None, None, None)] + [(5, "http://x/5", "")] * 3
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, record string, file int")
    path = warc.write_warc(pages, file_bytes=20_000)
    index = warc.read_warc(spark, path, with_records=True).orderBy("file", "ordinal").collect()
    assert len({r.file for r in index}) > 2 and Counter(r.key for r in index) == Counter(r[0] for r in rows)
    assert [r.key for r in index] == sorted((r[0] for r in rows), key=lambda k: -1 if k is None else k)
    by_file = {}
    for r in index:
        assert r.error is None and r.offset == by_file.get(r.file, 0) and r.sha256 == hashlib.sha256(r.record).hexdigest()
        by_file[r.file] = r.offset + r.length
    whole = {r.key: r.record.decode() for r in index}
    for i, url, html in rows:
        head, http, body = whole[i].split("\r\n\r\n", 2)
        assert f"WARC-Target-URI: {url or ''}\r\n" in head and body == (html or "") + "\r\n\r\n"
        assert int(head.rsplit(": ", 1)[1]) == len((http + "\r\n\r\n" + (html or "")).encode())

    first = warc.read_warc(spark, path)
    key = F.col("key")
    told = lambda second: Counter((r.key, r.what) for r in warc.diagnosed(warc.audit(first, second), first, second).join(first.select("file", "ordinal", "key"), ["file", "ordinal"], "left").collect())
    assert told(warc.read_warc(spark, warc.copied(spark, path))) == Counter()
    damaged = warc.read_warc(spark, warc.copied(spark, path, damage=key.isin(7, 123, 299)))
    assert told(damaged) == Counter([(7, "damaged"), (123, "damaged"), (299, "damaged")])
    assert all(r.start_a == r.start_b and r.end_a == r.end_b and r.hash_a != r.hash_b for r in warc.audit(first, damaged).collect())
    lost = told(warc.read_warc(spark, warc.copied(spark, path, lose=key == 150)))
    assert lost[150, "lost"] == 1 and {what for _, what in lost} <= {"lost", "moved"}
    # a file that is cut on disk: what can be unpacked is read, the rest is lost
    import glob

    cut = warc.copied(spark, path)
    name = sorted(glob.glob(f"{cut}/file=*/*.gz"))[0]
    raw = open(name, "rb").read()
    open(name, "wb").write(raw[: len(raw) // 2])
    for crc in glob.glob(f"{cut}/file=*/.*.crc"):
        __import__("os").remove(crc)
    after = told(warc.read_warc(spark, cut))
    assert after and {what for _, what in after} <= {"lost", "damaged"}
    none = warc.write_warc(pages.limit(0))
    assert warc.read_warc(spark, none).count() == 0
    assert warc.audit(warc.read_warc(spark, none), warc.read_warc(spark, none)).count() == 0


def test_warc_records_with_faults():
    good = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    wrong = good.replace(b"Length: 3", b"Length: 2")
    headless = b"XARC" + good[4:]
    got = list(warc.records(good + wrong + good + headless + good + good[:-6]))
    assert [g[3] for g in got] == [None, "wrong length", None, "no head", None, "cut short"]
    assert sum(g[1] for g in got) == len(good) * 6 - 6 and [g[2] for g in got] == ["urn:page:1"] * 6
    assert [g[3] for g in warc.records(good.replace(b"Content", b"Xontent"))] == ["no length"]
    assert list(warc.records(b"")) == []


def brute_components(rows):
    sets = {}
    for r in rows:
        w = words(r[1])
        sets[r[0]] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            same = len(sets[a] & sets[b])
            if a < b and same and 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard(docs, rows, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.clustered(docs).collect()}
    assert got == brute_components(rows)
    assert jaccard_join.clustered(empty).count() == 0


def test_jaccard_hot_group(spark):
    """A large group of near copies, so that frequent tokens, pairs of them and blocks are used."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(5000)}" for _ in range(90)]
    texts = []
    for _ in range(160):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 5])):
            w[rnd.randrange(90)] = f"e{rnd.randrange(40)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.clustered(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_overlaps():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 300, 80).astype(np.uint64)) for _ in range(9)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    apart = ~np.eye(len(sets), dtype=bool)
    assert (jaccard_join.overlaps(sets, 32)[apart] == want[apart]).all()


def test_packing_plan():
    rnd = random.Random(4)
    for _ in range(150):
        capacity = rnd.randint(1, 40)
        sizes = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 90))]
        left = []
        for s in sorted(sizes, reverse=True):
            fit = min(((c, i) for i, c in enumerate(left) if c >= s), default=None)
            if fit:
                left[fit[1]] -= s
            else:
                left.append(capacity - s)
        runs = packing.plan(dict(Counter(sizes)), capacity)
        assert max((r[3] + -(-(r[2] - r[1]) // r[4]) for r in runs), default=0) == len(left)


def test_packing(docs, rows, empty):
    got = packing.pack(docs, JSON).collect()
    lib, text = Tokenizer.from_file(JSON), {r[0]: r[1] for r in rows}
    bins, per = {}, Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
        ids = [*lib.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert zlib.crc32(array("I", ids[r.start : r.start + r.length]).tobytes()) == r.ids_crc32
        per[r.doc_id] += r.length
        assert r.length == 1024 or r.piece == 0
    assert max(bins.values()) <= 1024
    assert per == {r[0]: len(lib.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows}
    assert packing.pack(empty, JSON).count() == 0


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1)], "doc_id long, quality int")
    text = {r[0]: r[1] or "" for r in rows}
    for r in quality_rules.rules(docs, labels).collect():
        t = text[r.doc_id]
        w = re.findall("[^\x20\x09-\x0d]+", t)
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = Counter(windows)
        covered = {k + d for k, x in enumerate(windows) if many[x] > 1 for d in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r.kept == (not r.base_failed)
    assert quality_rules.rules(empty, labels).count() == 0
    assert quality_rules.filtered(docs, labels).columns == docs.columns


def test_quality_cutoffs(spark):
    good = [(i, "plain words " + " ".join(f"w{i}x{k}" for k in range(60)), "en", 1) for i in range(3000)]
    bad = [(3000 + i, " ".join(f"w{i}x{k}###" for k in range(60)), "en", 0) for i in range(200)]
    table = spark.createDataFrame([r[:3] for r in good + bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in good + bad], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.rules(table, labels).filter("kept").collect()}
    assert kept == {r[0] for r in good}


def test_certificates_by_brute_force(spark):
    """Cutoffs of mixed strata, with ties, nulls and too few labels, against a plain search; and the verdicts they give."""
    rnd = random.Random(21)
    rows, labels = [], []
    for lang, many in (("en", 1500), ("de", 500), (None, 400), ("fr", 60)):
        for _ in range(many):
            good = rnd.random() < 0.8
            i = len(rows)
            marks = rnd.choice([0, 0, 0, 1]) if good else rnd.choice([0, 9, 20])
            rows.append((i, " ".join([f"w{i}x{k}" for k in range(70)]) + "!" * marks + " ###" * (0 if good else rnd.choice([0, 12])), lang))
            labels.append((i, int(good)))
    docs = spark.createDataFrame([*rows, (None, None, "en")], "doc_id long, text string, lang string")
    told = spark.createDataFrame([*labels, (0, None), (None, 1)], "doc_id long, quality int")
    stats = quality_rules.written(quality_rules.measured(docs).drop("text"), "stats")
    got = {None if r.unnamed else r.stratum: r for r in quality_rules.certificates(stats, told).collect()}
    level = lambda t: {"symbols": min(100, 100 * sum(t.count(c) for c in "#*$%&|<>") // len(t.split())), "marks": min(100, 100 * sum(map(t.count, "!?")) // len(t.split())), "dup_lines": 0, "repeats": 0}
    want, kept = {}, set()
    for lang in ("en", "de", None, "fr"):
        own = [(i, level(t)) for i, t, k in rows if k == lang]
        rank = {(r, v): 1000 * sum(x[r] < v for _, x in own) // len(own) for r in quality_rules.RULES for v in {x[r] for _, x in own}}
        severity = {i: max(rank[r, x[r]] for r in quality_rules.RULES) for i, x in own}
        good = [s for i, s in severity.items() if labels[i][1]]
        bad = [s for i, s in severity.items() if not labels[i][1]]
        options = []
        for cut in sorted(set(severity.values())):
            k, hit = sum(s > cut for s in good), sum(s > cut for s in bad)
            tail = sum(math.comb(len(good), j) * 0.02**j * 0.98 ** (len(good) - j) for j in range(k + 1))
            if tail <= 0.05 / 4 and hit and k < 0.02 * len(good):
                options.append((hit / max(1, len(bad)) - k / len(good), cut, len(good), k, hit))
        if options:
            want[lang] = max(options)[1:]
        kept |= {i for i, s in severity.items() if not options or s <= want[lang][0]}
    assert {k: (r.severity, r.n, r.k, r.hit) for k, r in got.items()} == want
    assert set(want) >= {"en", "de", None} and "fr" not in want
    assert all(r.tail <= r.bound for r in got.values())
    assert {r.doc_id for r in quality_rules.rules(docs, told).filter("kept").collect()} == kept


def test_repeated_rows_clashing_columns_and_long_texts(spark):
    """Each operator on rows of one id, columns with its own names, and a text of a megabyte."""
    long = "lorem ipsum dolor " * 60_000
    rows = [(1, "the same text here for all of us", "en")] * 3 + [(1, "another text of the same id", "en"), (2, long, "de"), (3, None, None)]
    clash = ["n_words bigint", "score string", "component_id string", "key string", "class string", "file int", "media string", "start string", "_id int", "_text string", "stratum string", "n string", "id string", "held_out string"]
    docs = spark.createDataFrame([(*r, *([None] * len(clash))) for r in rows], "doc_id long, text string, lang string, " + ", ".join(clash))
    model = language_id.train(docs)
    found = [
        language_id.identify(docs, model), byte_bpe.digests(docs, RANKS), token_files.read_files(token_files.write_files(docs, JSON)),
        language_model.score(docs, *language_model.train(docs)), toxicity.score(docs, toxicity.train(docs, docs.selectExpr("doc_id", "1 AS toxic"))),
        jaccard_join.clustered(docs), quality_rules.rules(docs, docs.selectExpr("doc_id", "1 AS quality", "n_words")), media.media_features(media.to_media(docs.select("doc_id", "text"))),
    ]
    for frame in found:
        got = [tuple(r) for r in frame.collect()]
        assert len(got) == 6 and Counter(r[0] for r in got) == {1: 4, 2: 1, 3: 1}
    packed = packing.pack(docs, JSON).collect()
    assert {r.doc_id for r in packed} == {1, 2, 3} and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert quality_rules.filtered(docs, docs.selectExpr("doc_id", "1 AS quality")).columns == docs.columns
    assert language_id.accepted(docs, model).columns == docs.columns


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(100, 0), (500, 1), (900, 3), (2000, 7)]
    frame = spark.createDataFrame(cases, "n long, k long")
    for r in frame.withColumn("p", quality_rules._tail(F.col("n"), F.col("k"), 0.005, 0.0)).collect():
        exact = sum(math.comb(r.n, i) * 0.005**i * 0.995 ** (r.n - i) for i in range(r.k + 1))
        assert math.isclose(r.p, exact if r.k < r.n * 0.005 else 1.0, rel_tol=1e-6)


def test_media(docs, rows, empty):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_features(media.to_media(docs.select("doc_id", "text"))).collect())
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        data = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want[r[0], len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:])] += 1
    assert got == want
    with pytest.raises(ValueError, match="size|short"):
        media.inspect(media.wrap(bytes(192))[:-50])
    # the stored form and its feature, by the plain layout: one chunk every 8 units, a key frame every 16
    for r in media.media_features(media.to_media(docs.select("doc_id", "text"))).collect():
        assert r.error is None and r.media_bytes > r.payload_bytes
        stored = media.wrap(media.padded((dict((x[0], x[1]) for x in rows)[r.doc_id] or "").encode()))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        begin = stored.index(b"mdat") + 4
        frames = ",".join(f"{begin + 192 * i}+192" for i in range(0, r.payload_bytes // 192, 16))
        assert r.feature == f"codec=raw;timescale=8000;duration={r.payload_bytes};samples={r.payload_bytes // 192};keyframes={frames}"
    assert media.media_features(media.to_media(empty.select("doc_id", "text"))).count() == 0


def test_media_faults(spark):
    whole = media.wrap(bytes(192 * 40))
    cases = [None, b"", whole[:-1], whole.replace(b"stsz", b"stsx"), whole.replace(b"stsd", b"stsx"), whole.replace(b"mdhd", b"xxxx"), b"junk" * 9, whole]
    frame = spark.createDataFrame([(i, None if c is None else bytearray(c), "x") for i, c in enumerate(cases)], "id int, media binary, error_before string")
    got = {r.id: r for r in media.media_features(frame).collect()}
    assert [got[i].error is None for i in range(len(cases))] == [False] * 7 + [True]
    assert got[0].media_bytes is None and got[2].media_bytes == len(whole) - 1 and got[7].payload_bytes == 192 * 40


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2000), st.binary(min_size=1, max_size=8))
def test_media_any_fault_is_told(at, patch):
    whole = media.wrap(bytes(192 * 20))
    marred = (whole[:at] + patch + whole[at + len(patch) :])[: len(whole)]
    try:
        media.feature(layout := media.inspect(marred))
        media.payload(marred, layout)
    except (ValueError, media.struct.error):
        pass


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "\n", "\t", "\r", " ", " ", "\x1c", "\x85", "ab", "Straße", "'s", "12", ".,", "é", "日本", "<|endoftext|>", "\0"]), max_size=12).map("".join), max_size=5))
def test_units_as_the_library(texts):
    encoder = library_encoder(JSON)
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(texts) == want
    assert encoder.encode([*texts, None]) == [*want, b""]


def test_jaccard_wide_pivot(spark):
    """Two thousand sets that met one pivot in many components, of two sizes."""
    rnd = random.Random(11)
    rows, shared = [], [f"s{i}" for i in range(40)]
    for g in range(1000):
        w = shared[: rnd.choice([24, 40])] + [f"g{g}x{k}" for k in range(30)]
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join([*w, f"t{rnd.randrange(3)}"]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.clustered(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(t.split()) - 4, i - i % 2) for i, t in rows}


def test_jaccard_names_are_told_apart(docs, rows):
    """A naming of few bits, in which sets do share names, gives the same components."""
    sets = {jaccard_join.shingles(jaccard_join.WordHasher()(t)).tobytes() for _, t, *_ in rows if words(t)}
    digests = [jaccard_join.xxhash.xxh3_128_intdigest(s) for s in sets]
    rnd = random.Random(3)
    for _ in range(10_000):
        mask = rnd.getrandbits(57) & rnd.getrandbits(57)
        low = Counter(d & mask for d in digests)
        names = {d >> 64 & mask if low[d & mask] > 1 else d & mask for d in digests}
        if max(low.values()) > 1 and len(names) == len(digests):
            break
    assert max(low.values()) > 1
    table = jaccard_join.sets(docs, id_col="doc_id", text_col="text", width=5, bits=16, identity=jaccard_join.Identity(mask=mask))
    own, identity = jaccard_join._named_apart(table, mask)
    assert identity.shared
    assert {r["class"] for r in own.filter("n > 0").collect()} == names
    with pytest.raises(RuntimeError, match="share a name"):
        jaccard_join._named_apart(table.withColumn("other", F.hash("id").cast("long") * 2), 1)
