"""Every stage of the pipeline, and the whole, against plain Python on a hostile table."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import WS, words_of

import corpus_pipeline as P
from tessera.llm import packing, toxicity

BASE = " ".join(f"alpha{i}" for i in range(60))
RUDE = ["vile scum filthy", "filthy vile scum", "scum vile filthy rotten", "rotten filthy scum"]
FINE = ["the quick brown fox jumps", "a lazy dog sleeps well", "over hills and far away", "rivers run to the sea"]
TEXTS = [
    (1, "Hello  World"), (2, "Hello World\n"), (3, "HelloWorld"), (4, None), (5, ""), (6, " \t\n"), (7, "hello world"),
    (8, BASE), (9, BASE + " omega"), (10, BASE.replace("alpha30", "beta")), (11, BASE.upper()), (12, "one two three"),
    (13, "mail me@host.org or 10.0.0.1 now"), (14, "call +1 212 555 0199, card 4111 1111 1111 1111"), (15, "x" * 9000),
    (16, " ".join(f"word{i % 977}" for i in range(7000))), (17, "Hello  World"), (17, "Hello  World"),
    (18, "a calm text, then vile scum filthy words " + BASE[::-1]), (20, "\U0001F600 me@host.org\U0001F600"),
    *[(100 + i, f"{RUDE[i % 4]} {i} {FINE[i % 4]}") for i in range(40)], *[(200 + i, f"{FINE[i % 4]} {i}") for i in range(40)],
]
LABELS = [(i, 1, int(i < 200)) for i, _ in TEXTS if i >= 100] + [(100, 0, None), (200, 0, 0), (1, 1, 0), (999, 0, 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", f"s{i}", None if t is None else len(t)) for i, t in TEXTS]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def plain(texts):
    return Counter((i, t, "en", f"s{i}", None if t is None else len(t)) for i, t in texts)


def fine(texts):
    """Those that a model fitted on the labelled rows doesn't reject."""
    toxic = defaultdict(int)
    for i, _, y in LABELS:
        if y is not None:
            toxic[i] = max(toxic[i], y)
    known = sorted({(i, t or "") for i, t in texts if i in toxic and zlib.crc32(str(i).encode()) % 5})
    values, bias = toxicity.train([t.lower().encode() for _, t in known], np.array([toxic[i] for i, _ in known]))
    scores = toxicity.scores_of([(t or "").lower().encode() for _, t in texts], values.astype(np.float32).astype(float), bias)
    return [x for x, s in zip(texts, scores) if s < 0.5]


def unequal(texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[WS.sub("", t or "")].append((i, t))
    return [min(g, key=lambda m: (-len(m[1] or ""), m[0])) for g in groups.values()]


def unlike(texts):
    sets = {}
    for i, t in texts:
        w = words_of(t)
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    ids, top = sorted(sets), {}
    for i in ids:  # the smallest document reachable over links
        reach, todo = {i}, [i]
        while todo:
            x = sets[todo.pop()]
            for j in ids:
                if j not in reach and x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                    reach.add(j)
                    todo.append(j)
        top[i] = min(reach)
    return [(i, t) for i, t in texts if top[i] == i]




def test_toxicity_stage(spark, docs, sf):
    want = fine(TEXTS)
    assert {i for i, _ in want} >= {i for i, _ in TEXTS if i >= 200} and not any(100 <= i < 200 or i == 18 for i, _ in want)
    assert rows_of(P.toxicity_filter(spark, docs, sf)) == plain(want)


def test_exact_stage(spark, docs, sf):
    assert rows_of(P.exact_dedup(spark, docs, sf)) == plain(unequal(TEXTS))


def test_near_stage(spark, docs, sf):
    once = unequal(TEXTS)
    kept = docs.join(spark.createDataFrame([(i,) for i, _ in once], "doc_id long"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    want = unlike(once)
    assert {8} == {i for i, _ in want if 8 <= i <= 11} and len(want) < len(once)
    assert rows_of(P.near_dedup(spark, kept, sf)) == plain(want)


def test_pii_stage(spark, docs, sf):
    out = P.pii_mask(spark, docs, sf)
    assert out.columns == P.COLUMNS
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(TEXTS)
    assert "me@host.org" not in got[13][0].text and "10.0.0.1" not in got[13][0].text and got[13][0].text.startswith("mail ")
    assert "4111" not in got[14][0].text and "0199" not in got[14][0].text
    assert got[20][0].text.startswith("\U0001F600 ") and "host" not in got[20][0].text
    for i, t in TEXTS:
        if i not in (13, 14, 20):
            assert {r.text for r in got[i]} == {x for j, x in TEXTS if j == i}
        for r in got[i]:
            assert r.n_chars == (None if r.text is None else len(r.text)) and (r.lang, r.source) == ("en", f"s{i}")


def check_pieces(rows, texts):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for i, t in texts:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, lo in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[lo:lo + 4096], "<u4")
            want[(i, k, lo, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for pieces in places.values():
        ends = [0]
        for offset, length in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 4096


def test_packing_stage(spark, docs, sf):
    check_pieces(P.packing(spark, docs, sf).collect(), TEXTS)


def test_whole_pipeline(spark, sf):
    want = unlike(unequal(fine(TEXTS)))
    rows = P.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in want}
    clean = [(i, t) for i, t in want if i not in (13, 14, 20)]  # no personal data in these
    assert len(want) == len(clean) + 3
    ids = {i for i, _ in clean}
    check = [r for r in rows if r.doc_id in ids]
    pieces = Counter(r.doc_id for r in check)
    assert set(pieces) == ids and sum(r.length for r in check if r.doc_id == 16) > 4096


def test_empty_table_and_clashing_columns(spark, docs, sf):
    none = docs.filter("doc_id = -1")
    extra = docs.withColumn("Kept", F.lit("x")).select("*", F.lit(7).alias("TEXT_")).withColumnRenamed("TEXT_", "TEXT")
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, none, sf).collect() == [], name
        assert rows_of(stage(spark, extra, sf)) == rows_of(stage(spark, docs, sf)), name
    assert P.packing(spark, none, sf).collect() == []
    assert P.packing(spark, extra, sf).count() == P.packing(spark, docs, sf).count()
