"""The pipeline's stages against plain versions of themselves, on the smallest tables."""

import sys

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages():
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    return pytest.importorskip("corpus_pipeline").STAGES


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_roots(rows):
    """The least id that each of rows (id, text) reaches by links of 0.8, by an index of all shingles."""
    sets = {i: shingles(t) for i, t in rows}
    at, root = {}, {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        met = {}
        for x in s:
            for j in at.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            at[x].append(i)
        for j, n in met.items():
            if n * 10 >= 8 * (len(s) + len(sets[j]) - n) and (a := find(i)) != (b := find(j)):
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def coverage(item, words, shortest):
    """The words of item in greedy tiles, the longest first, on diagonals of equal words."""
    free_i, free_w, out = [True] * len(item), [True] * len(words), 0
    places = {}
    for t, x in enumerate(words):
        places.setdefault(x, []).append(t)
    while True:
        runs, best, at = {}, 0, None
        for i in range(len(item) - 1, -1, -1):
            new = {}
            for t in places.get(item[i], []):
                if free_i[i] and free_w[t]:
                    new[t] = n = runs.get(t + 1, 0) + 1
                    if n > best or n == best and (i, t) < at:
                        best, at = n, (i, t)
            runs = new
        if best < shortest:
            return out
        free_i[at[0] : at[0] + best] = free_w[at[1] : at[1] + best] = [False] * best
        out += best


def test_stages(spark, stages, tmp_path):
    """Each stage against a plain version of it on all that the one before kept: quality by scores of the query, the others by brute force, mixing by its SQL."""
    import string

    import duckdb

    from tessera.llm import mixing, quality

    source = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, columns = source, source.columns
    kept = {}
    for name, stage in stages:
        out = stage(spark, docs, DATA)
        if name != stages[-1][0]:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= set(rows) and ids
        kept[name] = (rows, ids)
    rows, ids = kept["quality"]
    scores = quality.score(source, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    assert ids == {r.doc_id for r in scores if r.predicted}
    rows, ids = kept["exact_dedup"]
    best = {}
    for i, t in rows.items():
        best.setdefault("".join((t or "").split(" ")).translate({k: None for k in range(9, 14)}), []).append((-len(t or ""), i))
    assert ids == {min(x)[1] for x in best.values()}
    rows, ids = kept["near_dedup"]
    assert ids == {i for i, root in near_roots(rows.items()).items() if i == root}
    rows, ids = kept["decontaminate"]
    plain = str.maketrans(string.punctuation, " " * len(string.punctuation))
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "").translate(plain)).split()
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    starts = [(w, min(4, len(w)), {tuple(w[k : k + min(4, len(w))]) for k in range(len(w) - min(4, len(w)) + 1)}) for w in items if w]
    dirty = set()
    for i, t in rows.items():
        w = words(t)
        grams = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in {x[1] for x in starts}}
        if any(seeds & grams[n] and coverage(item, w, n) >= 0.6 * len(item) for item, n, seeds in starts):
            dirty.add(i)
    assert ids == set(rows) - dirty
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/decontaminate/*.parquet')")
    want = con.sql(mixing.sql()).fetchall()
    assert kept["mix"][1] == {r[0] for r in want}
    assert {"topic", "n_tokens", "probability", "sample_weight"} <= set(docs.columns)


def test_empty_odd_and_long_documents(spark, stages, tmp_path):
    """Extra columns with the operators' own names, nulls in every column, a very long text, repeated rows, and no rows at all."""
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "word " * 200_000, "en", "src0", 1), (2, None, None, None, None), (None, None, None, None, None), (3, "a plain text about nothing, at length and in order", "en", "src1", 5)] * 2
    made = {c: F.lit(1) for c in ("did", "fp", "v", "a", "c", "n", "root", "key", "body", "topic", "w", "score", "_kept", "keep", "rep")}
    docs = spark.createDataFrame(rows, schema).withColumns(made)
    labels = tmp_path / "sf"
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(labels / f"{name}.parquet"))
    for name, stage in stages:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, str(labels))
            n = out.count()
            assert n <= table.count() and (name == "mix" or out.columns == table.columns)
            if name == "decontaminate" and n:
                assert n == 8


def test_rows_without_an_id(spark, stages, tmp_path):
    """They are merged with equal texts, pass the dedup stages together, and are judged one by one for benchmark passages."""
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where("text is not null").first().text
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    full = lambda i, t: (i, t, "en", "src0", len(t or ""))
    rows = [full(None, "one text without an id that stays"), full(None, item), full(1, "another text that is clean"), full(2, "another text that is  clean"), full(3, None)]
    docs = spark.createDataFrame(rows, schema)
    by = dict(stages)
    for name, want in [("exact_dedup", [0, 1, 3, 4]), ("near_dedup", [0, 1, 2, 4]), ("decontaminate", [0, 2, 3, 4])]:
        got = by[name](spark, docs, DATA)
        assert sorted(map(str, got.collect())) == sorted(str(docs.collect()[i]) for i in want)
        assert by[name](spark, docs.limit(0), DATA).count() == 0


def test_near_stage_takes_pairs_at_80(spark, stages):
    """Against brute-force shingle sets at 0.8, with pairs on both sides of it and of 0.85."""
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts = {}
    for k, n in enumerate([30, 44, 45, 46, 50, 54, 58, 62, 66, 70, 90] * 3):
        w = [word() for _ in range(n + 4)]
        texts[2 * k] = " ".join(w)
        w[n // 2] = "other"
        texts[2 * k + 1] = " ".join(w)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    alike = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in texts if i % 2 == 0}
    assert any(0.8 <= x < 0.85 for x in alike.values()) and any(x < 0.8 for x in alike.values())
    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts.items()], schema)
    got = {x.doc_id for x in dict(stages)["near_dedup"](spark, docs, DATA).collect()}
    assert got == {i for i in texts if i % 2 == 0 or alike[i - 1] < 0.8}
