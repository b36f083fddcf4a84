"""Online packing, vector codes and spelling variants against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import codes, common, online, spelling

LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(4000))
ODD = "a  b \n c\t d  e 　 f's it's  \U0001F600 \x00 \x1c g <|endoftext|> h<|endoftext|>  \r\n end  "
TEXTS = [(1, "Hello World"), (2, "Hello World"), (2, "Hello World"), (3, None), (4, ""), (5, " "), (6, LONG), (7, ODD),
         (None, "no id"), (8, LONG + ODD), (9, "x" * 3000), (10, "\n\n  \n"), *[(100 + i, f"text {i} " * (i % 23)) for i in range(60)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "TEXT IN CAPITALS", 7) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT_ string, Doc int") \
        .withColumnRenamed("TEXT_", "TEXT").repartition(7)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(online.default_tokenizer())


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


# --- online packing

def check_packing(rows, tokenizer, texts, size):
    want = Counter()
    for i, t in texts:
        want[(i, tuple(plain_ids(tokenizer, t)))] += 1
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
    for (i, ids), n in want.items():
        mine = Counter((r.start, r.length, r.ids_crc32) for r in by_doc[(i, len(ids))])
        for start, length, crc in mine:
            assert crc == zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())
        # Every id lies in one piece: each place is covered as often as the document stands.
        cover = Counter(p for (s, ln, _), k in mine.items() for _ in range(k) for p in range(s, s + ln))
        assert set(cover) == set(range(len(ids))) and set(cover.values()) == {n}
    assert len(by_doc) == len({(i, len(ids)) for i, ids in want})
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    fills = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= size
        fills.append(at)
    return fills


def test_online_packing(spark, docs, tokenizer):
    # 7 partitions, two at a time: three levels of merging.
    rows = online.pack_online(docs, size=64, n_open=3, fan=2).collect()
    fills = check_packing(rows, tokenizer, TEXTS, 64)
    assert all(f == 64 or f & (f - 1) == 0 for f in fills)  # nothing is padded
    assert len({f for f in fills if f < 64}) == len([f for f in fills if f < 64])
    fills = check_packing(online.pack_online(docs).collect(), tokenizer, TEXTS, 1024)
    assert all(f == 1024 or f & (f - 1) == 0 for f in fills)
    assert online.pack_online(docs.filter("doc_id = -1")).count() == 0
    one = spark.createDataFrame([(5, None)], "doc_id int, text string")
    assert [tuple(r) for r in online.pack_online(one).collect()][0][:5] == (5, 0, 1, zlib.crc32(bytes(4)), 1)


def test_online_packing_of_words_kept_by_size(docs):
    """Documents that fit are cut only to fill up the fullest window."""
    windows = online.Windows(10, 2)
    assert windows.place(6) == [(0, 6, 0, 0)]
    assert windows.place(7) == [(0, 7, 1, 0)]
    assert windows.place(3) == [(0, 3, 1, 7)]                    # best fit fills window 1
    assert windows.place(8) == [(0, 8, 2, 0)]
    assert windows.place(5) == [(0, 2, 2, 8), (2, 3, 0, 6)]      # the fullest goes, the rest fits
    assert windows.place(23) == [(0, 10, 3, 0), (10, 10, 4, 0), (20, 3, 5, 0)]
    assert windows.open() == {0, 5}
    assert online.closing([3, 4, 6], 8) == [[(0, 3, 0, 0)], [(0, 4, 0, 3)], [(0, 1, 0, 7), (1, 4, 1, 0), (5, 1, 2, 0)]]


def test_open_windows_stay_bounded():
    random.seed(3)
    windows = online.Windows(64, 4)
    used = Counter()
    for _ in range(3000):
        n = random.randint(1, 200)
        parts = windows.place(n)
        assert [p[0] for p in parts] == list(np.cumsum([0, *[p[1] for p in parts[:-1]]])) and sum(p[1] for p in parts) == n
        assert len(windows.gaps) <= 4
        for _, length, w, offset in parts:
            assert used[w] == offset
            used[w] += length
    still = windows.open()
    assert all(n == 64 for w, n in used.items() if w not in still)


PIECES = st.sampled_from(["a", "word", "It's", " ", "  ", "\n", "\t", " ", "　", " ", "\x1c", "\x85", ".", "12", "é", "🙂",
                          "<|endoftext|>", "'ll", "\x00", "-", "ſ"])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=6))
def test_ids_are_the_tokenizers(texts):
    known = online.text_ids(online.default_tokenizer())
    flat, offsets = known.texts(pa.array(texts, pa.string()))
    from tokenizers import Tokenizer
    tokenizer = _shared.setdefault("t", None) or _shared.update(t=Tokenizer.from_file(online.default_tokenizer())) or _shared["t"]
    assert [flat[a:z].tolist() for a, z in zip(offsets, offsets[1:])] == [plain_ids(tokenizer, t) for t in texts]


_shared: dict = {}


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A normaliser makes the word rule unsure, so it isn't used."""
    import json
    made = json.load(open(online.default_tokenizer(), encoding="utf-8"))
    made["normalizer"] = {"type": "Replace", "pattern": {"String": " "}, "content": "_"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made), encoding="utf-8")
    from tokenizers import Tokenizer
    flat, _ = online.TextIds(str(path)).texts(pa.array(["one two  three"]))
    assert flat.tolist() == plain_ids(Tokenizer.from_file(str(path)), "one two  three")


def test_slices_cover_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * (i * 7 % 40) if i % 9 else None for i in range(50)])], names=["i", "t"])
    for rows, size in ((1000, 1), (7, 100), (50, 10**6)):
        parts = list(common.slices([batch, batch.slice(0, 0), batch.slice(10, 20)], 1, rows, size))
        assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(50), *range(10, 30)]
        assert all(p.num_rows == 1 or p.num_rows <= rows and sum(len(t or "") for t in p.column(1).to_pylist()) <= size for p in parts)


# --- vector codes

def brute_codes(rows, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    parts = [[v[p * width:(p + 1) * width] for _, v, _ in kept] for p in range(4)]
    books = [[list(v) for v in parts[p][:256]] for p in range(4)]

    def assign(p):
        return [min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(books[p])) for v in parts[p]]
    for _ in range(rounds):
        for p in range(4):
            best = assign(p)
            for k in {k for _, k in best}:
                mine = [v for v, (_, j) in zip(parts[p], best) if j == k]
                books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    best = [assign(p) for p in range(4)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, "".join(f"{best[p][n][1]:02x}" for p in range(4)), sum(best[p][n][0] for p in range(4)), label)
           for n, (i, _, label) in enumerate(kept)]
    by = Counter()
    for *_, e, label in out:
        by[label] += e
    return Counter((i, c, e, by[label], digest) for i, c, e, label in out)


def vectors(n, dims=8, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([rng.uniform(-1, 1), rng.choice([-0.5, 0.25, 0.0])]) for _ in range(dims)], rng.choice([None, 1, 1, 1, 2]))
            for i in range(n)]
    rows += [(rng.randrange(n), list(rows[k][1]), 1) for k in range(0, n, 9)]  # repeated vectors and ids
    rows += [(None, [0.125] * dims, None), (n + 1, None, 1), (n + 2, [None] + [0.0] * (dims - 1), 1), (-3, [float("nan")] * dims, 2),
             (-2, [float("inf")] + [0.0] * (dims - 1), 2), (-1, [-0.0001] * dims, 3)]
    return rows


@pytest.mark.parametrize("n", [5, 400])
def test_vector_codes(spark, n, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 50)
    rows = vectors(n)
    table = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows],
                                  "vec_id long, embedding array<double>, label int, LABEL_ string") \
        .withColumnRenamed("LABEL_", "LABEL").repartition(5)
    got = codes.vector_codes(table).collect()
    assert Counter(tuple(r) for r in got) == brute_codes(rows)
    monkeypatch.setattr(codes, "BROADCAST_LABELS", 0)
    assert Counter(tuple(r) for r in codes.vector_codes(table).collect()) == Counter(tuple(r) for r in got)


def test_vector_codes_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert codes.vector_codes(spark.createDataFrame([], schema)).collect() == []
    assert codes.vector_codes(spark.createDataFrame([(1, None, 2)], schema)).collect() == []
    big = [(i, [x * 2.0**16 for x in range(i, i + 4)], 1) for i in range(9)]  # needs 64 bits
    assert Counter(tuple(r) for r in codes.vector_codes(spark.createDataFrame(big, schema)).collect()) == brute_codes(big)
    for bad in ([(1, [1.0], 1)], [(1, [], 1)], [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)]):
        with pytest.raises(ValueError, match="components"):
            codes.vector_codes(spark.createDataFrame(bad, schema))


def test_block_distances_are_those_of_the_vectors():
    rng = np.random.default_rng(2)
    matrix = rng.integers(-50, 50, (300, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(matrix.tolist(), pa.list_(pa.int64()))], names=["i", "v"])
    (_, n, values, sizes, stored), = codes.to_blocks(batch, 8)
    block, book = codes.Block(n, values, sizes, stored.tobytes()), matrix[:20, 4:6]
    at, best = block.nearest(4, book)
    full = ((matrix[:, None, 4:6] - book) ** 2).sum(2)
    assert at.tolist() == full.argmin(1).tolist() and best.tolist() == full.min(1).tolist()
    sums = block.sums(4, 2, at, 20)
    assert all((sums[k] == matrix[at == k, 4:6].sum(0)).all() for k in range(20))


# --- spelling variants

def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows):
    import re
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_variants(words):
    form, out = {}, []
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out.append((w, n, len(others)))

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return Counter((w, form[w], root(w), n, k, words.get(form[w])) for w, n, k in out)


def word_rows():
    rng = random.Random(5)
    base = ["analysis", "receive", "naïveté", "straße", "aaaaaa", "banana", "abcabcabc", "münchen", "z" * 700]
    rows, words = [], list(base)
    for w in base:
        for _ in range(14):
            i = rng.randrange(len(w))
            c = rng.choice("abzéÿÀ")
            words.append(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1:], w[:i] + c + w[i + 1:], w + w[-1]]))
    words += [w + x for w in ("aaaaaaa", "aaaaab") for x in ("a", "b", "aa", "")]
    for k, w in enumerate(words):
        rows += [(k, f"{w} {w.upper() if k % 2 and w.isascii() else w}") for _ in range(rng.choice([1, 2, 3, 3, 16, 90]))]
    rows += [(None, "receive receive"), (7, None), (8, ""), (9, "12 34 -- ..")]
    rows += [(10_000 + i, "consider " * (1 + i % 3) + "x_underscore×multiply÷divide") for i in range(400)]  # some lose a letter
    return rows


def test_spelling_variants(spark):
    rows = word_rows()
    docs = spark.createDataFrame([(i, t, "other") for i, t in rows], "doc_id long, text string, TEXT_ string") \
        .withColumnRenamed("TEXT_", "Text").repartition(6)
    words = brute_words(rows)
    want = brute_variants(words)
    assert any(k[1] for k in want) and any(k[2] not in (k[0], k[1]) for k in want)  # forms, and chains of them
    for bucket in (spelling.BUCKET, 4):  # one index; keys split again and again
        assert Counter(tuple(r) for r in spelling.spelling_variants(docs, bucket).collect()) == want
    assert spelling.spelling_variants(docs.filter("doc_id = -1")).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=30), st.integers(1, 4))
def test_index_finds_what_brute_force_finds(words, wide):
    words = sorted(words, key=lambda w: zlib.crc32(w.encode()))
    was, spelling.WIDE = spelling.WIDE, wide
    try:
        index = spelling.BidirectionalIndex(words)
        ask = np.arange(len(words)).repeat(2)
        size = np.array([len(words[i]) for i in ask])
        before = np.where(np.arange(len(ask)) % 2, size // 2, 0)
        after = np.where(np.arange(len(ask)) % 2, 0, size - size // 2)
        a, b = index.near(ask, before, after)
    finally:
        spelling.WIDE = was
    got = {(words[x], words[y]) for x, y in zip(a, b)}
    assert got == {(x, y) for x in words for y in words if len(y) >= len(x) and near(x, y)}


def test_index_interval_of_a_pattern():
    """A match's interval is as wide as the number of its places."""
    words = ["banana", "bandana", "ananas", "band"]
    index = spelling.BidirectionalIndex(words)
    symbol = {c: s for w, coded in zip(words, index.coded) for c, s in zip(w, coded)}
    for pattern in ("an", "ana", "band", "nas", "dd"):
        for fm, order in ((index.left, pattern[::-1]), (index.right, pattern)):
            lo, hi = np.zeros(1, np.int64), np.array([fm.size])
            for c in order:
                lo, hi = fm.extend(np.array([symbol[c]]), lo, hi)
            assert hi[0] - lo[0] == sum(w.startswith(pattern, i) for w in words for i in range(len(w)))


def test_large_keys_are_split_to_small_zones(spark):
    words = spark.createDataFrame([(f"prefix{a}{b}{c}",) for a in "abcdefgh" for b in "abcdefgh" for c in "abcd"], "word string")
    parts = spelling.entries(words, 10)
    rows = [r for p in parts for r in p.collect()]
    keys = Counter(r.key for r in rows)
    zones = {r.key: r["size"] - r.before - r.after for r in rows}
    assert len(parts) > 1 and all(n <= 10 or zones[k] <= 1 for k, n in keys.items())
    got = {(r.word, r.near) for r in spelling.links(words, 10).collect()}
    names = [r.word for r in words.collect()]
    assert got == {(x, y) for x in names for y in names if near(x, y)}


# --- stored fingerprints

def test_likeness_of_stored_fingerprints(docs):
    """The likeness in a row is that of the two fingerprints in it, and of the next row's."""
    from tessera.llm import sketch
    rows = sorted(sketch.fingerprints(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    by_id = Counter(r.doc_id for r in rows)
    for r, after in zip(rows, [*rows[1:], rows[0]]):
        assert sketch.alike(r.fingerprint, r.edited_fingerprint) == r.near_edited
        if by_id[r.doc_id] == by_id[after.doc_id] == 1:
            assert sketch.alike(r.fingerprint, after.fingerprint) == r.near_next
    assert sketch.alike(rows[0].fingerprint, rows[0].fingerprint) == 1.0
    broken = "3:" + rows[0].fingerprint.partition(":")[2]
    assert sketch.alike(broken, rows[0].fingerprint) is None


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 400), st.integers(0, 400), st.integers(0, 400), st.integers(0, 2**32))
def test_fingerprints_of_any_sizes(common_, only_a, only_b, seed):
    from tessera.llm import sketch
    keys = np.unique(np.random.default_rng(seed).integers(1, 2**63, common_ + only_a + only_b, dtype=np.uint64))
    np.random.default_rng(seed + 1).shuffle(keys)
    x, y = keys[:common_ + only_a], np.concatenate([keys[:common_], keys[common_ + only_a:]])
    a, b = sketch.invertible([x, y])
    assert [sorted(s.tolist()) for s in sketch.inverted([a, b])] == [sorted(x.tolist()), sorted(y.tolist())]
    want = 1.0 if not len(keys) else common_ / len(keys)
    assert abs(sketch.alike(sketch.fingerprint(a, len(x)), sketch.fingerprint(b, len(y))) - want) < 1e-12


# --- the session

@pytest.mark.parametrize("name", ["lm", "fingerprints", "online", "codes", "spelling", "near", "packing", "pieces", "toxicity", "warc"])
def test_settings_of_the_session_stay(spark, docs, name):
    from tessera.llm import lm, near, packing, pieces, sketch, toxicity, warc
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    run = {"lm": lambda: lm.lm_scores(docs), "fingerprints": lambda: sketch.fingerprints(docs), "online": lambda: online.pack_online(docs),
           "codes": lambda: codes.vector_codes(spark.createDataFrame([(1, [0.5] * 4, 1)], "vec_id long, embedding array<double>, label int")),
           "spelling": lambda: spelling.spelling_variants(docs), "near": lambda: near.near_groups(docs),
           "packing": lambda: packing.pack(docs), "pieces": lambda: pieces.decode(pieces.tokenize(docs)),
           "toxicity": lambda: toxicity.toxicity(docs, labels),
           "warc": lambda: warc.read_archives(spark, warc.write_archives(pages))}[name]
    before = dict(spark.conf.getAll)
    run().count()
    now = dict(spark.conf.getAll)
    # A setting that was at its default may be written down, at the same value.
    assert {k: v for k, v in now.items() if k in before} == before
    assert all("arrow.max" in k for k in now.keys() - before.keys())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") in (before.get("spark.sql.execution.arrow.maxRecordsPerBatch"), "10000")
