"""The corpus operators against brute force, on a small corpus with odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, exact_dedup, licences, mixing, near_dedup, quality, secrets, substring_dedup, suffix_dedup, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did string, v int, p double, body string, k int"
SPACE = " \t\n\r\x0b\x0c"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(r.randint(0, 120))) for _ in range(60)]
    texts += [t + " " + passage for t in texts[:10]] + [passage.replace(" ", "\n")] * 3 + texts[:5]
    for t in texts[10:30]:
        w = t.split()
        if len(w) > 20:
            w[r.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t", "a", "a a a a", "x" * 5000, "ab " * 3000, "A b C d", "é" * 300, passage + "\x00" + passage]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(None, passage), rows[3], rows[3]]
    r.shuffle(rows)
    return [(i, t, r.choice(["en", "de", None]), r.choice(["src0", "src1", "other", None]), len(t or ""), "x", 1, 0.5, "b", 2) for i, t in rows]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered():
    """Distinct (doc_id, text), a null doc_id first."""
    return sorted({(i, t or "") for i, t, *_ in ROWS}, key=lambda x: (x[0] is not None, x[0] or 0))


def test_suffix_dedup(docs, none):
    want, seen = {}, set()
    for i, t in ordered():
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            else:
                seen.add(w)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(ROWS)
    for row in got:
        assert (row.n_bytes, row.n_removed, row.n_spans, bytes(row.kept)) == want[row.doc_id]
        assert row.kept_sha256 == hashlib.sha256(row.kept).hexdigest()
    assert suffix_dedup.remove_repeats(none).count() == 0
    for most in (1, 2):  # anchors with more runs go window by window
        assert sorted(map(str, suffix_dedup.remove_repeats(docs, most=most).collect())) == sorted(map(str, got))


def test_suffix_order_survives_hash_collisions():
    import numpy as np

    rows = np.random.default_rng(1).integers(1, 4, (50, 12))
    group = np.sort(np.random.default_rng(2).integers(0, 4, 50))
    suffixes = suffix_dedup.Suffixes(rows)
    order, common = suffixes.ordered(group)
    want = sorted(range(50), key=lambda i: (group[i], tuple(rows[i])))
    assert [tuple(rows[i]) for i in order] == [tuple(rows[i]) for i in want]
    suffixes.hash[:] = 0  # every hash collides
    assert [tuple(rows[i]) for i in suffixes.ordered(group)[0]] == [tuple(rows[i]) for i in want]
    assert (suffixes.ordered(group)[1] == common).all()


def by_hash(spark, rows):
    """Rows (doc_id, text) in the operators' order: doc_id, a null first, then the hash of the text."""
    table = spark.createDataFrame(rows, "doc_id long, text string").distinct()
    return [(r.doc_id, r.text) for r in table.selectExpr("doc_id", "text", "doc_id IS NOT NULL AS named", "xxhash64(text) AS h").orderBy("named", "doc_id", "h").collect()]


def test_repeats_in_rows_without_an_id(spark):
    """2,000 texts without a doc_id and some that share one are documents of their own, in slices of one row; removed spans or not make no difference to the columns."""
    r = random.Random(8)
    shared = [" ".join(f"w{r.randrange(500)}" for _ in range(40)) for _ in range(30)]
    rows = []
    for i in range(2400):
        own = [f"x{r.randrange(10**6)}" for _ in range(r.randint(0, 30))]
        at = r.randint(0, len(own))
        if r.random() < 0.5:
            own[at:at] = r.choice(shared).split()
        rows.append((None if i < 2000 else i % 100, " ".join(own)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen, seen_words, want, want_words = set(), set(), {}, {}
    for i, t in by_hash(spark, rows):
        b, w = t.encode(), t.split()
        gone, gone_words = bytearray(len(b)), set()
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen_words:
                gone_words |= set(range(k, k + 20))
            seen_words.add(tuple(w[k : k + 20]))
        want[i, len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)] = want.get((i, len(b), sum(gone), bytes(x for x, g in zip(b, gone, strict=True) if not g)), 0) + 1
        want_words[i, len(w), len(gone_words), " ".join(x for k, x in enumerate(w) if k not in gone_words)] = 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {(x.doc_id, x.n_bytes, x.n_removed, bytes(x.kept)) for x in suffix_dedup.remove_repeats(table).collect()}
        assert got == set(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for most in (3, 10_000):
        assert {(x.doc_id, x.n_bytes, x.n_removed, bytes(x.kept)) for x in suffix_dedup.remove_repeats(table, most=most).collect()} == set(want)
        assert {(x.doc_id, x.n_words, x.n_removed, x.kept.decode()) for x in substring_dedup.remove_repeats(table, most=most).collect()} == set(want_words)
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()) for i, w in ((i, t.split()) for i, t in by_hash(spark, rows))]
    near = near_dedup.near_groups(table).collect()
    assert sorted((x.doc_id is not None, x.doc_id or 0, x.n_shingles) for x in near) == sorted((i is not None, i or 0, len({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())) for i, w in ((i, t.split()) for i, t in rows))
    # ids are the nodes: rows that share one (or have none) are one document of several sets
    root: dict = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    full = [(i, s) for i, s in sets if s]
    for x, (i, s) in enumerate(full):
        for j, t in full[x + 1 :]:
            if len(s & t) * 100 >= 85 * len(s | t) and find(i) != find(j):
                lo, hi = sorted((find(i), find(j)), key=lambda y: (y is not None, y or 0))
                root[hi] = lo
    for x in near:
        if x.n_shingles:
            assert x.component_id == find(x.doc_id)


def test_bytes_decide(monkeypatch):
    """With every hash of runs alike, within a slice and in the solver, bytes alone tell copies."""
    import numpy as np
    import pyarrow as pa

    from tessera.llm import _windows

    texts = [bytes(np.random.default_rng(i % 5).integers(97, 100, 60).astype(np.uint8)) for i in range(12)]
    order = sorted(range(12), key=lambda i: (texts[i], i))
    columns = [[7] * 12, order, [0] * 12, [10 << 8 | 20] * 12, [texts[i] for i in order], [0] * 12]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int32()]
    batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["a", "did", "fp", "v", "tokens", "k"])
    tables = []
    solve = lambda tokens, at, group, o, n, rank, spell: tables.append(spell(np.arange(len(at)), 0 * at, 0 * at + 60)) or np.zeros((len(at), 1), bool)
    found = list(_windows.solving(solve, suffix_dedup.tokenise, 41)(iter([batch.slice(0, 3), batch.slice(3)])))
    assert sorted(d for x in found for d in x.column(0).to_pylist()) == list(range(5, 12))
    assert sorted(tables[0]) == sorted(texts[:5])

    monkeypatch.setattr(_windows, "hashed", lambda tokens, first, n, o, length: np.zeros(len(first), np.int64))
    monkeypatch.setattr(_windows, "runs_of", lambda tokens, starts, ends, length, seed: [(np.arange(12), np.zeros(12, np.int64), np.full(12, 20), np.full(12, 10), np.zeros(12, np.uint64), starts)])
    rows = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array([0] * 12), pa.array([x.decode() for x in texts])], names=["did", "fp", "text"])
    (out,) = _windows.scan(suffix_dedup.tokenise, 41, 24)(iter([rows]))
    local = [d for d, v in zip(out.column(2).to_pylist(), out.column(4).to_pylist(), strict=True) if v < 0]
    assert local == [5, 10]  # those with the bytes of the first; the rest go on


def test_exact_dedup(docs, none):
    norm = lambda t: (t or "").translate({ord(c): None for c in SPACE})
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is not None, i))
    got = exact_dedup.exact_groups(docs, table_bytes=2000).collect()  # small enough to spill and recurse
    assert len(got) == len(ROWS)
    by = {hashlib.sha256(k.encode()).hexdigest(): (min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(v)) for k, v in groups.items()}
    for row in got:
        assert (row.keep_id, row.group_size) == by[row.text_sha256]
        assert row.kept == (row.doc_id == row.keep_id)
    whole = exact_dedup.exact_groups(docs)
    assert sorted(map(str, whole.collect())) == sorted(map(str, got))
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_dedup_parts_until_texts_fit(tmp_path):
    """Long repetitive texts count with their true size, one text beyond the limit is not parted, and there is no last level."""
    import zlib

    texts = [bytes([97 + i % 26]) * 100_000 + str(i).encode() for i in range(40)] * 2
    rows = [(i % 40, hashlib.sha256(t).digest(), zlib.compress(t, 1), -len(t), i, 1, len(t)) for i, t in enumerate(texts)]
    deepest = []
    part = exact_dedup.Table.add

    def add(self, *x):
        part(self, *x)
        deepest.append(sum(map(len, self.texts)))

    exact_dedup.Table.add = add
    try:
        got = list(exact_dedup.grouped(lambda: iter(rows), str(tmp_path), sum(map(exact_dedup.weight, rows)), 0, 250_000))
    finally:
        exact_dedup.Table.add = part
    assert sorted(got) == sorted((hashlib.sha256(t).digest(), i, 2) for i, t in enumerate(texts[:40]))
    assert max(deepest) <= 250_000 and not list(tmp_path.iterdir())


def test_substring_dedup(docs, none):
    want, seen = {}, set()
    for i, t in ordered():
        w = t.encode().split()
        gone = set()
        for k in range(len(w) - 19):
            q = tuple(w[k : k + 20])
            if q in seen:
                gone |= set(range(k, k + 20))
            else:
                seen.add(q)
        want[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone))
    got = substring_dedup.remove_repeats(docs).collect()
    assert len(got) == len(ROWS)
    for row in got:
        assert (row.n_words, row.n_removed, bytes(row.kept)) == want[row.doc_id]
    assert substring_dedup.remove_repeats(none).count() == 0
    for most in (1, 2):
        assert sorted(map(str, substring_dedup.remove_repeats(docs, most=most).collect())) == sorted(map(str, got))


def test_near_dedup(docs, none):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    rows = ordered()
    sets = {i: shingles(t) for i, t in rows}
    order = [i for i, _ in rows]
    root = {i: i for i in order}
    find = lambda i: i if root[i] == i else find(root[i])
    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                lo, hi = (ra, rb) if order.index(ra) < order.index(rb) else (rb, ra)
                root[hi] = lo
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == len(ROWS)
    for row in got:
        assert (row.n_shingles, row.component_id) == (len(sets[row.doc_id]), find(row.doc_id))
    assert near_dedup.near_groups(none).count() == 0


def test_near_dedup_in_blocks(docs, monkeypatch):
    want = sorted(map(str, near_dedup.near_groups(docs).collect()))
    monkeypatch.setattr(near_dedup, "BLOCK", 50)
    assert sorted(map(str, near_dedup.near_groups(docs).collect())) == want


def test_components_of_hubs_and_chains(spark, monkeypatch):
    """Stars on their least and greatest node, a chain, and scattered links, with nodes of over 20 links as hubs."""
    from tessera.llm import _runtime

    monkeypatch.setattr(_runtime, "LEAST_HUB", 20)
    r = random.Random(6)
    edges = [(1, i) for i in range(2, 300)] + [(999, i) for i in range(400, 700)] + [(i, i + 1) for i in range(2000, 2100)] + [(r.randrange(3000, 5000), r.randrange(3000, 5000)) for _ in range(900)]
    root = {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = _runtime.components(spark.createDataFrame(edges + edges[:50], "a long, b long")).collect()
    assert sorted((x.node, x.root) for x in got) == sorted((i, find(i)) for i in nodes)
    assert _runtime.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("keys", [0, 100_000])
def test_near_dedup_splits_large_buckets(docs, spark, monkeypatch, keys):
    words = [f"w{i}" for i in range(200)]
    copies = [(1000 + i, " ".join([*words[:i], "other", *words[i + 1 :]])) for i in range(0, 60)]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame(copies, "doc_id long, text string"))
    want = sorted(map(str, near_dedup.near_groups(rows).collect()))
    assert sum("component_id=1000," in x for x in want) == len(copies)
    monkeypatch.setattr(near_dedup, "BUCKET", 4)
    monkeypatch.setattr(near_dedup, "HOT_KEYS", keys)
    assert sorted(map(str, near_dedup.near_groups(rows).collect())) == want


def test_tiles_are_greedy():
    import numpy as np

    r = random.Random(3)

    def brute(item, text, shortest):
        free_i, free_t, out = [True] * len(item), [True] * len(text), 0
        while True:
            best = 0
            for i in range(len(item)):
                for t in range(len(text)):
                    n = 0
                    while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and free_i[i + n] and free_t[t + n]:
                        n += 1
                    if n > best:
                        best, at = n, (i, t)
            if best < shortest:
                return out
            for n in range(best):
                free_i[at[0] + n] = free_t[at[1] + n] = False
            out += best

    for kinds in [12, 3, 1, 30] * 40:
        item, text = ([r.randrange(kinds) for _ in range(r.randint(1, 25))] for _ in range(2))
        found = decontaminate.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert all(item[i : i + n] == text[t : t + n] and n >= 3 for i, t, n in found)
        covered = [i + k for i, _, n in found for k in range(n)]
        assert len(covered) == len(set(covered))
        assert len(covered) == brute(item, text, 3)


def test_tiles_of_long_repetitive_texts():
    import time

    import numpy as np

    began = time.time()
    item = np.array([1] * 60 + [2] + [1] * 60 + [3, 4, 5] * 20, np.uint64)
    text = np.array([1] * 200_000 + [3, 4, 5] * 30_000 + [2] + [1] * 30, np.uint64)
    found = decontaminate.tiles(item, text, 4)
    assert sum(n for _, _, n in found) == 180  # the single 2 is shorter than a tile
    assert time.time() - began < 60


def test_decontaminate_against_brute_force(spark):
    """Every document against every item, by plain tiling of the words, with passages cut, reordered and varied."""
    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)]
    items = {i: [r.choice(vocabulary) for _ in range(r.randint(2, 24))] for i in range(12)}
    rows = {}
    for d in range(80):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if d % 2:
            x = items[r.randrange(12)]
            cut = r.randint(0, len(x))
            w[3:3] = r.choice([x, x[cut:] + x[:cut], x[: max(1, len(x) * 2 // 3)], x[cut:] + ["other"] + x[:cut], [*x[:5], "odd", *x[6:]]])
        rows[d] = w

    def brute(item, text, shortest):
        free_i, free_t, tiles = [True] * len(item), [True] * len(text), []
        while True:
            best, at = 0, None
            for i in range(len(item)):
                for t in range(len(text)):
                    n = 0
                    while i + n < len(item) and t + n < len(text) and free_i[i + n] and free_t[t + n] and item[i + n] == text[t + n]:
                        n += 1
                    if n > best:
                        best, at = n, (i, t)
            if best < shortest:
                return tiles
            free_i[at[0] : at[0] + best] = free_t[at[1] : at[1] + best] = [False] * best
            tiles.append(best)

    want = set()
    for d, w in rows.items():
        for i, x in items.items():
            found = brute(x, w, min(4, len(x)))
            if sum(found) >= 0.6 * len(x):
                want.add((d, i, sum(found), len(x), len(found)))
    spell = lambda w: ", ".join(x.upper() if k % 3 else x for k, x in enumerate(w)) + "."
    table = spark.createDataFrame([(d, spell(w)) for d, w in rows.items()], "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id, x.matched_words, x.item_words, x.n_tiles) for x in decontaminate.overlaps(table, tests).collect()}
    assert got == want and len(want) > 20
    assert {x.doc_id for x in decontaminate.clean(table, tests, block_bytes=100).collect()} == set(rows) - {x[0] for x in want}


def test_decontaminate(spark, docs, none):
    w = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(w)), (2, None), (3, ""), (4, "alpha beta"), (5, "Q. " + " ".join(f"u{i}" for i in range(12)))], "item_id long, text string")
    rows = [(1, "x y " + " ".join(w) + " z"), (2, " ".join(w[15:] + ["mid"] + w[:15])), (3, " ".join(w[:12])), (4, "say Alpha, beta now"), (5, "alpha x beta"), (6, None), (7, ""), (None, " ".join(w).upper())]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(table, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 4), (None, 1)}
    assert got[2, 1].n_tiles == 2 and got[2, 1].coverage == 1.0
    small = decontaminate.overlaps(table, items, block_bytes=1)
    assert {(r.doc_id, r.item_id) for r in small.collect()} == set(got)
    assert decontaminate.overlaps(docs, items).count() == 0
    assert decontaminate.overlaps(none, items).count() == 0
    assert decontaminate.overlaps(table, items.limit(0)).count() == 0


def test_quality(spark, docs, none):
    r = random.Random(2)
    rows = [(i, "Good words, in order. " * r.randint(1, 9) if i % 3 else "JUNK!! | " * r.randint(1, 9)) for i in range(900)]
    table = spark.createDataFrame([*rows, (None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(900)] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(table, labels).collect()
    assert len(got) == 902
    for row in got:
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
        assert row.held_out == (row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
    held = [row for row in got if row.held_out and row.doc_id < 900]
    assert sum(row.predicted == int(row.doc_id % 3 != 0) for row in held) >= 0.97 * len(held)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    assert sorted(map(str, quality.score(table, flipped).collect())) == sorted(map(str, got))
    assert quality.score(docs, labels.limit(0)).where("score <> 0.5").count() == 0
    assert quality.score(none, labels).count() == 0
    assert quality.accepted(docs, labels).columns == docs.columns


def plain_statistics(text):
    """quality.STATISTICS of one text, word by word."""
    b = text.encode()
    w = b.split()
    letter = lambda c: 65 <= c < 91 or 97 <= c < 123 or c >= 128
    digit = lambda c: 48 <= c < 58
    mark = lambda c: not letter(c) and not digit(c) and c not in b" \t\n\r\x0b\x0c"
    n, m = max(len(b), 1), max(len(w), 1)
    letters = max(sum(map(letter, b)), 1)
    pairs = list(zip(w, w[1:], strict=False))
    size = [len(x) for x in w]
    mean = sum(size) / m
    ended = sum(mark(x[-1]) for x in w) / m
    most = lambda x: max((x.count(y) for y in set(x)), default=0)
    return {
        "log_chars": math.log1p(len(b)), "log_words": math.log1p(len(w)), "upper": sum(65 <= c < 91 for c in b) / letters, "digits": sum(map(digit, b)) / n, "marks": sum(map(mark, b)) / n,
        "odd_marks": sum(mark(c) and c not in b".,;:'\"-()" for c in b) / n, "bars": b.count(b"|") / m, "high": sum(c >= 128 for c in b) / n, "distinct": len(set(w)) / m, "top": most(w) / m,
        "runs": sum(x == y for x, y in pairs) / m, "twos": (1 - len(set(pairs)) / len(pairs)) if pairs else 0.0, "threes": most(pairs) / max(len(pairs), 1), "word_length": mean,
        "word_spread": math.sqrt(max(sum(x * x for x in size) / m - mean**2, 0)), "short": sum(x <= 3 for x in size) / m, "line_length": math.log1p(len(w) / (1 + b.count(b"\n"))),
        "no_letters": sum(not any(map(letter, x)) for x in w) / m, "ends_marked": ended, "marks_spread": sum(x == y for x, y in zip(w, w[2:], strict=False)) / m,
    }


def test_quality_against_plain_sums(spark):
    """Statistics text by text, the ridge weights from whole matrices, the isotonic curve by its minimax formula, and the scores from them."""
    import numpy as np

    r = random.Random(17)
    word = lambda: r.choice(["alpha", "Beta", "ga,", "x9", "é|", "!!", "no.", "ABC"])
    texts = ["", None, "one", "a a a a", "é" * 40, " \n\t"] + [r.choice([" ", "\n"]).join(word() for _ in range(r.randint(1, 60))) for _ in range(700)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    marked = [(i, int(r.random() < (0.8 if (t or "").count("!") % 2 else 0.3))) for i, t in enumerate(texts) if i % 5]
    labels = spark.createDataFrame(marked, "doc_id long, quality int")
    measured = quality.measure(table)
    x = np.array([[plain_statistics(t or "")[k] for k in quality.STATISTICS] for t in texts])
    got = {row.doc_id: row.x for row in measured.collect()}
    assert np.allclose(np.array([got[i] for i in range(len(texts))]), x, atol=1e-6)  # a root of a difference
    model = quality.fit(measured, labels, width=48)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.maximum(x.std(axis=0), 1e-9))
    rest = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in marked}
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-9), -6, 6)
    z = np.hstack([np.sqrt(2 / 48) * np.cos(z @ model.directions + model.phases), z / 10, np.ones((len(z), 1))])
    fit = [(i, y) for i, y in marked if rest[i] < 2]
    a, y = z[[i for i, _ in fit]], np.array([y for _, y in fit])
    # the same system as least squares with as many rows more as weights
    wide = a.shape[1]
    weights = np.linalg.lstsq(np.vstack([a, np.sqrt(quality.RIDGE * len(a) / wide) * np.eye(wide)]), np.r_[y, np.zeros(wide)], rcond=None)[0]
    raw = z @ weights
    assert np.allclose(model.weights, weights, atol=1e-6)
    bins = {}
    for i, y in marked:
        if rest[i] == 3:
            bins.setdefault(int(np.clip(np.floor((raw[i] + 1) * (quality.BINS / 3)), 0, quality.BINS - 1)), []).append((raw[i], y))
    bins = [bins[k] for k in sorted(bins)]
    total, count = np.cumsum([0] + [sum(y for _, y in b) for b in bins]), np.cumsum([0] + [len(b) for b in bins])
    level = [max(min((total[k] - total[h]) / (count[k] - count[h]) for k in range(j + 1, len(bins) + 1)) for h in range(j + 1)) for j in range(len(bins))]
    centre = {}
    for b, v in zip(bins, level, strict=True):
        centre.setdefault(round(v, 12), []).extend(p for p, _ in b)
    knots = [(sum(v) / len(v), k) for k, v in sorted(centre.items())]
    want = np.clip(np.interp(raw, [k for k, _ in knots], [v for _, v in knots]), 0, 1)
    scores = {row.doc_id: row.score for row in quality.scored(measured, model).collect()}
    assert np.allclose([scores[i] for i in range(len(texts))], want, atol=1e-5) and want.std() > 0.05


def test_licences(spark, docs, none):
    rows = [(1, "Intro\nlicensed under the apache license, version 2.0\n\nend"), (2, "Released under the MIT license!"), (3, "This is not a notice."), (4, None), (5, ""), (None, "Released under the MIT license."), (6, "One line\n\ntwo lines here\nthree")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line, r.template) for r in licences.scan(table).collect()}
    assert got == {(1, 2, "Apache-2.0"), (2, 1, "MIT"), (None, 1, "MIT")}
    two = licences.scan(table, {"two": "one line\ntwo lines here"}).collect()
    assert [(r.doc_id, r.line, r.dice) for r in two] == [(6, 1, 1.0)]
    assert licences.scan(docs).count() == 0 and licences.scan(none).count() == 0


def test_licences_wherever_they_stand(spark, tmp_path):
    """Whole licence texts, notices inside a line or wrapped, with words changed, cut off at the end or side by side, against every window by brute force and against the SQL."""
    import duckdb

    r = random.Random(31)
    filler = lambda n: " ".join(r.choice(["the", "software", "and", "of", "licensed", "under", "alpha", "copy", "License"]) for _ in range(n))
    texts = ["This file is released under the MIT license, see below.", "Licensed under the\n  Apache\nLicense, Version\n2.0", "x " * 30 + licences.TEMPLATES["MIT-text"].replace("\n", " ").upper()]
    for _ in range(60):
        body = re.findall(r"\S+", licences.TEMPLATES[r.choice(sorted(licences.TEMPLATES))])
        for _ in range(r.randint(0, len(body) // 8)):
            body[r.randrange(len(body))] = r.choice(["odd", "the"])
        body = body[: r.choice([len(body), len(body), max(2, len(body) * 3 // 4)])]
        texts.append(filler(r.randint(0, 20)) + r.choice([" ", "\n"]) + r.choice([" ", "\n", "\n\n"]).join(body) + (" " + filler(r.randint(1, 9)) if r.random() < 0.6 else ""))
    texts += [licences.TEMPLATES["MIT"] + "\n" + licences.TEMPLATES["GPL-2.0"], None, "", "one", "ünder thé MIT lícense"]

    def brute(text):
        w, line = [], []
        for k, body in enumerate((text or "").split("\n"), 1):
            new = re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in body))
            w, line = w + new, line + [k] * len(new)
        rows = []
        for name, body in licences.TEMPLATES.items():
            known = re.findall("[a-z0-9]+", body.lower())
            own = set(zip(known, known[1:], strict=False))
            for s in range(len(w) - 1):
                part = w[s : s + len(known)]
                g = set(zip(part, part[1:], strict=False))
                if (w[s], w[s + 1]) in own and (dice := 2 * len(g & own) / (len(g) + len(own))) >= 0.8:
                    rows.append((s, s + len(part), -dice, -len(known), name))
        out, group, upto = [], [], -1
        for row in sorted(rows) + [(10**9, 0, 0, 0, "")]:
            if row[0] >= upto and group:
                x = min(group, key=lambda y: (y[2], y[3], y[4], y[0]))
                out.append((line[x[0]], x[4], round(-x[2], 6)))
                group, upto = [], -1
            group.append(row)
            upto = max(upto, row[1])
        return out

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents"))
    got = sorted((x.doc_id, x.line, x.template, round(x.dice, 6)) for x in licences.scan(spark.read.parquet(str(tmp_path / "documents"))).collect())
    assert got == sorted((i, *x) for i, t in enumerate(texts) for x in brute(t))
    assert {x[2] for x in got} > {"MIT", "Apache-2.0", "MIT-text", "BSD-3-Clause-text"} and {0, 1, 2} <= {x[0] for x in got}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    assert sorted(con.sql(licences.sql()).fetchall()) == got


def test_warc(spark):
    schema = "page_id long, url string, html string, digest string, head int"
    rows = [(1, "http://a/ b", "<p>é\r\n\r\nWARC/1.1\r\n</p>", "x", 1), (2, None, None, "x", 1), (3, "u", "", "x", 1), (7, "u", "same", "x", 1), (9, "v", "same", "x", 1), (8, "v", "same", "x", 1), (None, "n", "n", "x", 1), (12, "l", "y" * 300_000, "x", 1), (-4, "m", "m\x00", "x", 1)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {1, 2, 3, 7, 8, 9, 12, -4}
    for page, _, html, *_ in rows:
        if page is not None:
            data = (html or "").encode()
            assert (got[page].payload_bytes, got[page].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
            response = got[page].capture.response
            assert response.type == got[page].record_type and got[page].capture.request.block.startswith(b"GET ")
            if response.type == "response":
                assert bytes(response.block).endswith(data)
    assert {p: r.refers_to for p, r in got.items() if r.record_type == "revisit"} == {7: 9, 8: 9, 2: 3}
    least = {r.page_id: r.record_type for r in warc.round_trip(spark.createDataFrame(rows, schema), least=5).collect()}
    assert set(least.values()) == {"response"}
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0


def test_warc_keeps_repeated_rows(spark, tmp_path, monkeypatch):
    """One row for each of pages, as the SQL has it, with equal rows, one page at two urls, and rows without an id."""
    import duckdb

    from tessera.llm import queries

    monkeypatch.setattr(warc, "RUN", 2, raising=False)
    rows = [(1, "u", "same")] * 5 + [(1, "v", "same"), (2, "w", "same"), (2, "w", "same"), (3, "x", None), (3, "x", ""), (4, None, "one")] + [(None, "n", "same"), (None, "n", "alone"), (None, "n", "alone"), (None, None, "alone")]
    schema = "page_id long, url string, html string"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op9_warc(spark, str(tmp_path))
    want = duckdb.connect()
    want.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = want.sql(queries.SQL["op9_warc"])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(str(tuple(x)) for x in got.collect()) == sorted(str(tuple(x[i] for i in order)) for x in want.fetchall())
    captures = warc.round_trip(spark.createDataFrame(rows, schema), nameless=True).select("capture").collect()
    names = [x.capture.response.record_id for x in captures]
    assert len(names) == len(set(names)) == len(rows) and all(x.capture.request and x.capture.metadata for x in captures)
    assert {x.capture.response.refers_to_id for x in captures} - {None} <= {x.capture.response.record_id for x in captures if x.capture.response.type == "response"}


def test_warc_pieces_make_records():
    """Blocks that begin, end and are filled with the separator come back whole, whatever follows them."""
    blocks = [b"", b"a", b"\r\n", b"a\r\n", b"\r\n\r\n", b"x\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\ny", b"\r\n\r\n\r\n", b"\r\r\n\r\n\r", b"\xff\x00\n"]
    data = b"".join(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(x) + x + b"\r\n\r\n" for x in blocks)
    assembly = warc.Assembly()
    got = [block for path in "ab" for piece in data.split(b"\r\n\r\n") for _, block in assembly.add(path, piece)]
    assert got == blocks * 2
    with pytest.raises(ValueError):
        list(assembly.add("c", b"no record"))


def test_warc_archives_of_others(spark, tmp_path):
    """Several requests and headers, a response that names its request, and archives that are not gzipped."""
    import gzip

    def one(kind, name, block, *fields):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    data = [
        one("warcinfo", "i", b"software: x\r\n"), one("response", "r1", b"HTTP/1.1 200 OK\r\n\r\nbody\r\n", ("WARC-Concurrent-To", "<q1>")),
        one("request", "q2", b"GET /2", ("WARC-Concurrent-To", "<r1>")), one("request", "q1", b"GET /1", ("WARC-Concurrent-To", "<r1>"), ("WARC-Concurrent-To", "<m>")),
        one("metadata", "m", b"k: v", ("WARC-Concurrent-To", "<r1>")), one("response", "r2", b"no head"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in data[:3]))
    (tmp_path / "b.warc").write_bytes(b"".join(data[3:]))
    got = {x.capture_id: x for x in warc.transactions(warc.read(spark, str(tmp_path))).collect()}
    assert set(got) == {"r1", "r2", "m"}
    assert (got["r1"].payload_bytes, got["r1"].request.record_id, got["r1"].metadata.record_id) == (6, "q1", "m")
    assert got["r1"].payload_digest == base64.b32encode(hashlib.sha1(b"body\r\n").digest()).decode()
    assert got["r2"].payload_bytes is None and got["m"].response is None and got["m"].request.record_id == "q1"


def test_warc_of_large_pages(spark):
    """Pages of several megabytes, more of them than are handed on together."""
    rows = [(i, f"u{i}", (f"{i} " + "<p>\r\n\r\n" * 3) * (400_000 if i % 3 else 4)) for i in range(24)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = {x.page_id: (x.payload_bytes, x.payload_digest, x.record_type) for x in warc.round_trip(table).drop("capture").collect()}
    assert got == {i: (len(t), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), "response") for i, _, t in rows}


def brute_secrets(text):
    spans = []
    for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    base = sorted(spans)
    found = []
    for m in re.finditer(secrets.CANDIDATE, text):
        value = m[0]
        if any(s <= m.start() and e >= m.end() for s, _, e in base) or any(re.search(p, value) for p in secrets.ALLOWED):
            continue
        limit = next((bits for _, p, bits in secrets.CLASSES if re.search(p, value)), None)
        top = 0.0
        for i in range(len(value) - secrets.WINDOW + 1):
            window = value[i : i + secrets.WINDOW]
            top = max(top, -sum(window.count(c) / len(window) * math.log2(window.count(c) / len(window)) for c in set(window)))
        if limit is not None and top >= limit:
            found.append((m.start(), 3, m.end()))
    return base, sorted(base + found)


def test_secrets(spark, docs, none):
    r = random.Random(9)
    blob = "".join(r.choice("ABCDEFGHabcdefghijkLMNOPqrstuvwxyz0123456789+/") for _ in range(60))
    texts = [f'é😀 Password : "abc123" token=short x', "AKIA" + "Z" * 16 + " AKIAQ", "0123456789abcdef01234567f", f"key {blob} end", f"😀{blob}", "secret:ab token = abcdefgh", "token=token=abcdefgh", "password=" + blob,
             "550e8400-e29b-41d4-a716-446655440000", "internationalizationinternational", "", None, "a" * 100_000, blob * 50, "API_KEY='x.y-z=12'", "ſecret=abcdefgh", "PassWD=" + "ab" * 20]
    table = spark.createDataFrame(list(enumerate(texts)) + [(None, "token=abcdefgh")], "doc_id long, text string")
    names = [k[0] for k in secrets.KINDS] + ["entropy"]
    write = lambda x: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in x)
    got = {row.doc_id: row for row in secrets.digest(table).collect()}
    assert len(got) == len(texts) + 1
    for i, text in enumerate(texts):
        base, every = brute_secrets(text or "")
        row = got[i]
        assert (row.spans, row.base_sha256) == (write(every), hashlib.sha256(write(base).encode()).hexdigest()), text
        assert [row.n_assign, row.n_access, row.n_hex] == [sum(x[1] == k for x in base) for k in range(3)]
    assert secrets.digest(docs).count() == len(ROWS) and secrets.digest(none).count() == 0


def test_secrets_beside_labels_and_allowed_words(spark):
    """A key in a run of one class is found whatever is joined to it, and so are keys of 16 to 23 characters; words are not."""
    r = random.Random(11)
    hexes = ["".join(r.choice("0123456789ABCDEF") for _ in range(40)) for _ in range(20)]
    key, short = "q7Zp2LxV9bTn4KsW8dRm3HcY", "Zk3Qv9Lw2Xr7Tb5N"
    hidden = [(f"{label}{h}", h) for h in hexes for label in ("", "SIG=", "KEY=", "hash/", "example-")]
    hidden += [(f"example/path/{key}", key), (f"placeholder={key}", key), (f"x {short} y", short), (f"see example/{short}", short), (f"SIG={hexes[0][:16]}0F3A", hexes[0][:16] + "0F3A")]
    plain = ["internationalization", "a/path/of/plain/words/only", "some-hyphened-words-together", "0000000000000000", "1234567890123456", "MAXIMUMCONNECTIONS", "example/placeholder/changeme"]
    rows = [*(t for t, _ in hidden), *plain]
    got = {x.doc_id: x for x in secrets.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for i, (text, secret) in enumerate(hidden):
        at = text.index(secret)
        assert any(x.start <= at and x.end >= at + len(secret) for x in got[i].entropy), text
    assert all(not got[i].entropy for i in range(len(hidden), len(rows)))


def test_secrets_of_a_megabyte(spark):
    """Long candidates take time in proportion to their length and no stack: base64, hyphenated words, thousands of keys, one letter."""
    import time

    r = random.Random(12)
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    blob = draw("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 1_000_000)
    keys = [draw("0123456789GHIJKLMNOP", 32) for _ in range(20_000)]
    rows = [(1, blob), (2, "-".join(["word"] * 200_000)), (3, " ".join(keys)), (4, "a" * 1_000_000), (5, "ab-" * 20_000 + "x")]
    began = time.time()
    got = {x.doc_id: x.spans for x in secrets.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert time.time() - began < 90
    assert got[1] == "entropy:0:1000000" and got[2] == got[5] == ""
    entropy = lambda t: -sum(t.count(c) / 24 * math.log2(t.count(c) / 24) for c in set(t))
    found = [i for i, k in enumerate(keys) if max(entropy(k[j : j + 24]) for j in range(9)) >= 3.9]
    assert 0 < len(found) < len(keys) and got[3] == ",".join(f"entropy:{33 * i}:{33 * i + 32}" for i in found)
    assert got[4] == "hex:0:1000000"


def test_mixing_meets_the_targets(spark, docs, none):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(1, 20), r.choice(["en"] * 4 + ["de"]), r.choice(["src0"] * 5 + ["src1", "src2"])) for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"src0": 0.4, "src1": 0.3, "*": 0.3}, "lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 1.0}}
    got = mixing.mix(table, targets, budget=0.3).collect()
    weight = lambda f: sum(x.n_tokens * x.sample_weight for x in got if f(x)) / sum(x.n_tokens * x.sample_weight for x in got)
    assert abs(weight(lambda x: x.source == "src0") - 0.4) < 0.05 and abs(weight(lambda x: x.lang == "de") - 0.4) < 0.06
    total = sum(len(x[1].split()) for x in rows)
    assert abs(sum(x.n_tokens for x in got) / total - 0.3) < 0.04
    assert all(0 < x.probability <= 1 and x.sample_weight >= 1 for x in got)
    assert sorted(x.doc_id for x in mixing.mix(table, targets, budget=1.0).collect())
    assert mixing.mix(docs).columns == [*docs.columns, "topic", "n_tokens", "probability", "sample_weight"]
    assert mixing.mix(docs).count() <= len(ROWS) and mixing.mix(none).count() == 0
    assert mixing.mix(table, {**targets, "lang": {"fr": 1.0}}).count() == 0
    assert mixing.mix(table.withColumn("kind", F.lit("poem")), {**targets, "topic": {"poem": 1.0}}, topic_of="kind").first().topic == "poem"


def test_mixing_comes_near_its_targets(spark, monkeypatch):
    """Margins end within the tolerance, however many cells there are and however raking is done; contradictory targets end too."""
    r = random.Random(14)
    rows = [(i if i % 50 else None, "w " * r.randint(1, 20) + str(i), r.choice(["en"] * 8 + ["de", "fr"]), r.choice(["a"] * 9 + ["b", "c"])) for i in range(2000)]
    rows += [(10**6, "w " * 5000, "en", "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"a": 0.2, "b": 0.3, "c": 0.5}, "lang": {"en": 0.2, "de": 0.5, "*": 0.3}, "topic": {"prose": 1.0}}
    want = {"a": 0.2, "b": 0.3, "c": 0.5, "en": 0.2, "de": 0.5, "*": 0.3, "prose": 1.0}
    near = mixing.balance(table, targets, rounds=2).collect()
    assert all(abs(x.reached - want[x.value]) <= mixing.TOLERANCE and x.off <= mixing.TOLERANCE for x in near) and len(near) == 7
    once = sorted((str(x.doc_id), x.text, round(x.probability, 6)) for x in mixing.mix(table, targets, rounds=4).collect())
    assert 5 < sum(x[0] == "None" for x in once) < 40  # rows without an id are drawn one by one
    monkeypatch.setattr(mixing, "ONE_ROW", 1)
    assert sorted((str(x.doc_id), x.text, round(x.probability, 6)) for x in mixing.mix(table, targets, rounds=4).collect()) == once
    monkeypatch.undo()
    split = spark.createDataFrame([(1, "x x", "en", "a"), (2, "y", "de", "b")], "doc_id long, text string, lang string, source string")
    off = mixing.balance(split, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "de": 0.9}}, rounds=2).collect()
    assert max(x.off for x in off) > 0.1
    many = {"source": {**{str(i): 1.0 for i in range(12_000)}, "a": 12_000.0}}
    assert mixing.mix(table, many, rounds=1).where("source = 'a'").count() > 0
