import hashlib
from collections import Counter

import corpus_pipeline as p
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import fingerprints, language_id, line_dedup


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(
        spark.createDataFrame([(None, None, None, None, None), (5, "", "en", "src1", 0), (5, "123 456", None, "src1", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    )
    sf = "/root/testdata/sf0.001"
    one = p.language(spark, docs, sf).cache()
    sure = {r.row for r in language_id.predict(p.numbered(docs).withColumn("x", F.lit(1)), language_id.fit(docs), id_col="row").where("lang_pred != 'und' AND score >= 0.3").select(F.col("doc_id").alias("row")).collect()}
    assert one.columns == list(p.COLUMNS) and one.count() == len(sure) and one.where("text IS NULL").count() == 0
    two = p.lines(spark, one, sf).cache()
    plain = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(one).collect()}
    assert two.columns == list(p.COLUMNS) and {(r.doc_id, r.text) for r in two.collect()} == plain
    three = p.near_copies(spark, two, sf).cache()
    assert three.columns == list(p.COLUMNS) and 0 < three.count() < two.count() and p.near_copies(spark, three, sf).count() == three.count()
    four = p.weighted(spark, three, sf).cache()
    times = {r[0]: r[1] for r in four.groupBy("doc_id").count().collect()}
    assert four.columns == list(p.COLUMNS) and max(times.values()) <= 3
    assert sorted(map(str, p.weighted(spark, three, sf).collect())) == sorted(map(str, four.collect()))
    five = p.tokens(spark, four, sf)
    assert five.count() == four.count() and five.where("n_tokens != size(ids)").count() == 0


def test_near_copies_of_similarity_above_the_bound(spark):
    rng = np.random.default_rng(7)
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    rows, near, far = [], [], []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(30, 600)))]
        copy = list(words)
        for at in rng.choice(len(words), max(1, int(len(words) * rng.uniform(0.002, 0.04))), replace=False):
            copy[at] = f"x{rng.integers(10**6)}"
        a, b = shingles(words), shingles(copy)
        (near if len(a & b) / len(a | b) >= 0.8 else far).append(2 * i + 1)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    # a repeated passage decides all bits of the fingerprint, but not the shingle set
    rows += [(9000 + i, "a b c d e " * 300 + " ".join(f"q{i}r{j}" for j in range(400))) for i in range(2)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in p.near_copies(spark, docs, "").collect()}
    assert len(near) > 150 and len(far) > 50
    assert len(kept & set(near)) <= 0.01 * len(near)
    assert kept - set(near) == {i for i, _ in rows} - set(near)


@pytest.mark.parametrize("key, parts, held, block", [(fingerprints.KEY, fingerprints.PARTS, fingerprints.HELD, fingerprints.BLOCK), (3, 5, 2000, 64)])
def test_no_near_copy_is_missed(spark, monkeypatch, key, parts, held, block):
    """Large groups around the bound, where a key's texts are mostly of one group; all pairs are compared here."""
    for name, value in (("KEY", key), ("PARTS", parts), ("HELD", held), ("BLOCK", block)):
        monkeypatch.setattr(fingerprints, name, value)
    rng = np.random.default_rng(3)
    texts = ["", None, "a b", "A b", "one two three four five"]
    for length, many, edits in ((150, 250, (2, 7)), (60, 120, (1, 3)), (400, 60, (3, 15))):
        base = [f"w{x}" for x in rng.integers(0, 10**6, length)]
        for _ in range(many):
            w = list(base)
            for at in rng.choice(length, int(rng.integers(*edits)), replace=False):
                w[at] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(w))
        texts += [" ".join([*base[:40], *(f"y{x}" for x in rng.integers(0, 10**6, 100))]) for _ in range(40)]
    texts += texts[5:15]
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for w in words]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if root[a] != root[b] and (not union or len(sets[a] & sets[b]) / union >= 0.8):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    assert 100 < len(set(root)) < len(texts) - 100
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    group = {r.doc_id: r.component_id for r in fingerprints.similar_groups(df, id_col="row").collect()}
    low = {}
    for i in sorted(group):
        low.setdefault(group[i], i)
    assert [low[group[i]] for i in range(len(texts))] == root


def test_bitmaps_never_say_too_much():
    rng = np.random.default_rng(4)
    for n, m, both in ((0, 0, 0), (1, 3, 1), (300, 310, 250), (100, 900, 90), (5000, 70, 0)):
        x = np.unique(rng.integers(0, 1 << 64, n + m - both, np.uint64))
        a, b = x[:n], x[n - both :]
        bits = fingerprints.apart(fingerprints.bitmap(a), fingerprints.bitmap(b))
        assert bits <= n + m - 2 * both and (bits >= 0.6 * (n + m - 2 * both) or max(n, m) > 2 * min(n, m))


def test_what_near_copies_hold_is_bounded():
    """A held prefix doesn't keep its set, and rows with texts are unpacked few at a time."""
    own = np.unique(np.random.default_rng(5).integers(0, 1 << 64, 1000, np.uint64))
    for frequent in (np.zeros(0, np.uint64), own[::3].copy()):
        first = fingerprints.prefix(own, 0.8, frequent)
        assert first.base is None and len(first) == 201
    batch = pa.RecordBatch.from_pydict({"a": list(range(1000))})
    parts = list(fingerprints.few_rows(iter([batch, batch.slice(0, 0), batch.slice(0, 3)])))
    assert max(p.num_rows for p in parts) <= fingerprints.FEW and [x for p in parts for x in p.column(0).to_pylist()] == [*range(1000), 0, 1, 2]


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "ein Text", None, "s", 8), (2, "123 456", None, "s", 7), (3, None, None, "s", 0), (4, "ñ", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.language(spark, docs, "")
    assert got.columns == list(p.COLUMNS) and {(r.doc_id, r.lang) for r in got.collect()} == {(1, None), (4, None)}


def test_odd_tables(spark):
    """Empty tables, only nulls, very long texts, repeated ids and columns with clashing names go through all stages."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, component_id long, copy int, times int, taken long, size long, fp long, node long"
    extra = (1, 2, 3, 4, 5, 6, 7, 8)
    rng = np.random.default_rng(2)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"], 200_000))
    tables = {
        "empty": [],
        "nulls": [(None, None, None, None, None)] * 3,
        "odd": [(1, "", "en", "a", 0), (1, "the same text of the two rows", "en", "a", 29), (1, "the same text of the two rows", None, None, 29), (None, "a text without an id", "en", "b", 20), (4, long, "en", "a", len(long)), (5, long + " tail", "en", "b", len(long)), (6, "!!! 123", "en", "a", 7)],
    }
    kept = {}
    for name, rows in tables.items():
        docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
        for stage, f in p.STAGES:
            docs = f(spark, docs, "").cache()
            kept[name, stage] = docs.count()
            assert docs.columns == list(p.COLUMNS) or stage == p.STAGES[-1][0]
    assert set(v for (n, _), v in kept.items() if n in ("empty", "nulls")) == {0}
    assert kept["odd", "language ID"] == kept["odd", "line dedup"] == 5 and kept["odd", "SimHash near-dedup"] == 3


def brute(rows, net):
    """All stages in plain Python over (doc_id, text, source): what is left of each document, as often as the mix takes it."""
    pooled = language_id.pooled(net, [(t or "").encode() for _, t, _ in rows])
    rows = [r for r, x in zip(rows, pooled) if r[1] and any(map(str.isalpha, r[1])) and x.max() >= p.LEAST_SCORE]
    seen, out = set(), []
    for i, t, s in sorted(rows, key=lambda r: r[0]):
        lines = t.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if any(x.encode().split() for x in w):
                gone |= {k, k + 1, k + 2} if w in seen else set()
                seen.add(w)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), s))
    rows = out

    def shingles(t):
        w = [x.lower() for x in t.encode().split()]
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            union = len(sets[a] | sets[b])
            if not union or len(sets[a] & sets[b]) / union >= p.SIMILAR:
                x, y = sorted((find(a), find(b)))
                root[y] = x  # rows are in the order of ids, so the root is the smallest
    rows = [r for k, r in enumerate(rows) if find(k) == k]
    sizes, by = [len(t.encode().split()) for _, t, _ in rows], {}
    for (_, _, s), n in zip(rows, sizes):
        by[s] = by.get(s, 0) + n
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight, target, open_ = {s: 1 + k % 3 for k, s in enumerate(names)}, {}, set(names)
    while True:
        left, w = sum(by.values()) - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= 3 * by[s]}
        if not over:
            break
        target |= {s: 3 * by[s] for s in over}
        open_ -= over
    target |= {s: left * weight[s] / w for s in open_}
    times = [0] * len(rows)
    for s in names:
        own = [k for k in range(len(rows)) if rows[k][2] == s]
        full = min(3, int(target[s] // by[s])) if by[s] else 0
        budget, run = target[s] - full * by[s], 0
        for k in sorted(own, key=lambda k: hashlib.md5(str(rows[k][0]).encode()).hexdigest()):
            run += sizes[k]
            times[k] = min(3, full + (run <= budget)) if sizes[k] else 0
    return Counter((r[0], r[1]) for r, n in zip(rows, times) for _ in range(n))


def test_run_against_brute_force(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text, r.source) for r in docs.collect()], language_id.fit(docs))
    library = Tokenizer.from_file(p.vocabulary())
    library.no_truncation()
    got = Counter((r.doc_id, tuple(r.ids)) for r in p.run(spark, sf).collect())
    assert got == Counter({(i, tuple(library.encode(t, add_special_tokens=False).ids)): n for (i, t), n in want.items()}) and len(got) > 50
