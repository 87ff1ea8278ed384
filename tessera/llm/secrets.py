"""Secret scans with DataFrame functions only.

Known shapes are found by pattern. On top of those, candidate strings are measured by the Shannon entropy of a
sliding window: for each step the count of the character that enters and of the one that leaves change by one, and
with them the running sum of c * log2(c). The counts are packed into a few integers, and a string's characters are taken from it once, so
a step costs the same whatever the window and the length, and a scan is linear in the text. The alphabet of a
candidate (its character class) sets the threshold, and an allow-list of patterns suppresses it. A candidate is a string
of all the characters, and, where that is not suspicious as a whole, each maximal run of one class in it, with the limit and the allow-list
applied to the run alone: a label, a path or an allowed word beside a key does not hide it. A run shorter than the window is a window of its
own length, and its limit is the same share of the most that so many characters can have.

Positions are code points, end exclusive. Cases: null text counts as empty and gives a row without spans; rows with
the same doc_id each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds in their order, each with its pattern, the group that counts, its least length, and whether it has the characters of candidates only.
KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, False),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    ("hex", r"[0-9a-f]{24,}", 0, 24, True),
]
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
WIDE = r"[A-Za-z0-9+/_=-]{%d,}"
WINDOW = 24
#: The runs that are candidates of their own, in the order in which they are tried, and their least length.
RUNS = [r"[A-Za-z0-9+/_-]{16,}={0,2}", r"[A-Za-z0-9+/]{16,}={0,2}", r"[A-Za-z0-9_-]{16,}={0,2}", r"[A-Za-z0-9]{16,}", r"[0-9a-fA-F]{16,}"]
SHORTEST = 16
#: Character class of a whole candidate, and the bits per character that a window must reach.
CLASSES = [("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[A-Za-z0-9]+$", 3.9), ("base64", r"^[A-Za-z0-9+/_=-]+$", 4.0)]
#: Possessive throughout: a repeated group that may give back recurses in the JVM's matcher, once for each repetition.
#: Never a secret: a word in letters of one case, perhaps with a capital or hyphens; numbers; a UUID; one repeated character; placeholders.
ALLOWED = [
    r"^[A-Za-z]?[a-z]++(?:[-_/][A-Za-z]?[a-z]++)*+$",
    r"^[A-Z]++(?:[-_/][A-Z]++)*+$",
    r"^[0-9]++$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^(.)\1*+$",
    r"(?i)example|placeholder|changeme|xxxxxx",
]
SPAN = "array<struct<start:int,kind:int,end:int>>"
FOUND = "array<struct<start:int,kind:int,end:int,value:string>>"


def bound(x: Column, use) -> Column:
    """use(x), with x computed once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def running(rows: Column, zero: int, step) -> Column:
    """The numbers that step(number, row) gives after each row, from zero on, as an array.

    A fold copies its state at each step, so one over n rows that keeps them all would take time as their square. Here folds over
    about the root of n rows are put together by a fold over as many parts."""

    def parts(r: Column) -> Column:
        n = F.size(r)
        wide = F.greatest(F.floor(F.sqrt(n.cast("double"))).cast("int"), F.lit(16))
        last = lambda x: F.element_at(x, -1)
        part = lambda number, k: F.aggregate(F.slice(r, k * wide + 1, wide), F.array(number), lambda acc, x: F.concat(acc, F.array(step(last(acc), x))))
        grown = lambda acc, k: F.concat(acc, F.array(F.slice(part(last(last(acc)), k), F.lit(2), wide)))
        every = F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / wide).cast("int")), F.array(F.array(F.lit(zero))), grown)
        return F.flatten(F.slice(every, F.lit(2), n))

    return bound(rows, lambda r: F.when(F.size(r) > 0, parts(r)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Array of (start, kind, end, value) of the leftmost non-overlapping matches whose group has at least so many characters.

    The pieces between the matches and the matches themselves give every position by adding up lengths."""

    def located(found: Column) -> Column:
        measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        lengths = lambda x: F.transform(x, lambda y: F.length(y))
        rows = F.arrays_zip(found.alias("hit"), lengths(measured).alias("size"), F.slice(lengths(F.split(text, pattern, -1)), F.lit(1), F.size(found)).alias("gap"))
        return F.when(F.size(found) > 0, bound(rows, placed)).otherwise(F.array().cast(FOUND))

    def placed(r: Column) -> Column:
        ends = running(F.transform(r, lambda x: x["gap"] + F.length(x["hit"])), 0, lambda at, x: at + x)
        kept = F.filter(F.arrays_zip(r.alias("r"), ends.alias("end")), lambda x: x["r"]["size"] >= least)
        return F.transform(kept, lambda x: F.struct((x["end"] - F.length(x["r"]["hit"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["r"]["hit"].alias("value")))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def within(spans: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """matches() in the values of spans, with their places in the text. The same as in the text for patterns that cannot match beyond a span."""
    moved = lambda x: F.transform(
        matches(x["value"], pattern, kind, group, least),
        lambda y: F.struct((y["start"] + x["start"]).alias("start"), y["kind"].alias("kind"), (y["end"] + x["start"]).alias("end"), y["value"].alias("value")),
    )
    return F.when(F.size(spans) > 0, F.flatten(F.transform(spans, moved))).otherwise(F.array().cast(FOUND))


def top_entropy(text: Column, window: int | Column = WINDOW, most: int = WINDOW) -> Column:
    """Greatest Shannon entropy, in bits per character, of any window (of ``most`` characters at most) of an ASCII string at least that long.

    One pass: counts holds how often each of 128 characters is in the window, several to an integer, total the sum of c * log2(c)."""
    bits = most.bit_length()
    each = 62 // bits
    mask = (1 << bits) - 1
    size = F.lit(window) if isinstance(window, int) else window
    term = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(most + 1)))
    state = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-128 // each)).alias("counts"), F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))
    one = F.array(*(F.lit(1 << bits * i).cast("long") for i in range(each)))
    half = F.array(*(F.lit(bits * i) for i in range(each)))

    def measure(codes: Column) -> Column:
        left = F.concat(F.array_repeat(F.lit(None).cast("int"), size), codes)
        rows = F.arrays_zip(codes.alias("new"), F.slice(left, F.lit(1), F.size(codes)).alias("old"), F.sequence(F.lit(1), F.size(codes)).alias("i"))

        def step(s: Column, x: Column) -> Column:
            new, old = x["new"], x["old"]
            count = lambda c: F.get(s["counts"], F.floor(c / each).cast("int")).bitwiseAND(F.element_at(one, c % each + 1) * mask)
            held = lambda c: F.call_function("shiftrightunsigned", count(c), F.get(half, c % each)).cast("int")
            at = lambda c: F.floor(c / each).cast("int")

            def change(y: Column) -> Column:
                counts = F.transform(s["counts"], lambda n, k: n + F.when(k == y["into"], y["more"]).otherwise(F.lit(0).cast("long")) - F.when(k == y["from"], y["less"]).otherwise(F.lit(0).cast("long")))
                total = s["total"] + F.get(term, y["rise"] + 1) - F.get(term, y["rise"]) + F.when(y["fall"] > 0, F.get(term, y["fall"] - 1) - F.get(term, y["fall"])).otherwise(F.lit(0.0))
                return F.struct(counts.alias("counts"), total.alias("total"))

            same = new == old
            moved = F.when(
                old.isNotNull() & same, F.struct(s["counts"].alias("counts"), s["total"].alias("total"))
            ).otherwise(
                bound(
                    F.struct(
                        at(new).alias("into"), F.get(one, new % each).alias("more"), held(new).alias("rise"),
                        F.when(old.isNotNull(), at(old)).otherwise(-1).alias("from"), F.when(old.isNotNull(), F.get(one, old % each)).otherwise(F.lit(0).cast("long")).alias("less"),
                        F.when(old.isNotNull(), held(old)).otherwise(0).alias("fall"),
                    ),
                    change,
                )
            )
            seen = lambda y: F.struct(y["counts"].alias("counts"), y["total"].alias("total"), F.when(x["i"] >= size, F.least(s["least"], y["total"])).otherwise(s["least"]).alias("least"))
            return bound(moved, seen)

        return F.aggregate(rows, state, step, lambda s: F.log2(size.cast("double")) - s["least"] / size)

    return bound(F.transform(F.split(text, ""), lambda c: F.ascii(c)), measure)


def outside(spans: Column, others: Column) -> Column:
    """The spans that lie in none of the others, in order of start: one pass over both, sorted, with the furthest end so far."""
    mark = lambda x, own: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["kind"].alias("kind"), x["end"].alias("end"))
    marks = F.concat(
        F.transform(others, lambda x: F.struct(mark(x, 0).alias("at"), F.lit(None).cast("string").alias("value"))),
        F.transform(spans, lambda x: F.struct(mark(x, 1).alias("at"), x["value"].alias("value"))),
    )

    def left(m: Column) -> Column:
        far = running(F.transform(m, lambda x: x["at"]), -1, lambda far, x: F.when(x["own"] == 0, F.greatest(far, x["end"])).otherwise(far))
        kept = F.filter(F.arrays_zip(m.alias("m"), far.alias("far")), lambda x: (x["m"]["at"]["own"] == 1) & (x["m"]["at"]["end"] > x["far"]))
        return F.transform(kept, lambda x: F.struct(*(x["m"]["at"][c].alias(c) for c in ("start", "kind", "end")), x["m"]["value"].alias("value")))

    return F.when(F.size(spans) == 0, F.array().cast(FOUND)).otherwise(bound(F.array_sort(marks), left))


def scan(documents: DataFrame, window: int = WINDOW, classes=CLASSES, allowed=ALLOWED) -> DataFrame:
    """doc_id, and arrays of (start, kind, end): base by the known shapes, entropy by the method (kind 3), less what lies in a base span; text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select("doc_id", text.alias("text"))
    shortest = min(SHORTEST, window)
    # all but the assignments lie in a run of the candidates' characters: most texts have none, and skip the rest
    docs = docs.withColumn("wide", matches(F.col("text"), WIDE % shortest, 3, 0, shortest))
    base = F.concat(*(within(F.col("wide"), p, k, g, n) if inside and n >= shortest else matches(F.col("text"), p, k, g, n) for k, (_, p, g, n, inside) in enumerate(KINDS)))
    plain = lambda spans: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    docs = docs.withColumn("base", F.array_sort(plain(base)))

    def suspicious(span: Column) -> Column:
        value = span["value"]
        suppressed = F.lit(False)
        for p in allowed:
            suppressed = suppressed | value.rlike(p)
        limit = F.lit(None).cast("double")
        for _, p, bits in reversed(classes):
            limit = F.when(value.rlike(p), bits).otherwise(limit)
        size = F.least(F.length(value), F.lit(window))
        limit = limit * F.when(size < window, F.log2(size.cast("double")) / math.log2(window)).otherwise(1.0)
        return F.when(suppressed, F.lit(False)).otherwise(F.coalesce(top_entropy(value, size, window) >= limit, F.lit(False)))

    docs = docs.withColumn("entropy", F.array().cast(SPAN)).withColumn("runs", F.filter("wide", lambda x: F.length(x["value"]) >= window))
    for run in [None, *RUNS]:
        if run:
            docs = docs.withColumn("runs", within(F.col("wide"), run, 3, 0, shortest))
        left = F.when(F.size("runs") == 0, F.array().cast(FOUND)).otherwise(outside(F.col("runs"), F.concat("base", "entropy")))
        docs = docs.withColumn("entropy", F.concat("entropy", plain(F.filter(left, suspicious))))
    return docs.select("doc_id", "text", "base", F.array_sort("entropy").alias("entropy"))


def written(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS), F.lit("entropy"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def digest(documents: DataFrame) -> DataFrame:
    """Counts of each kind, the hash of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return scan(documents).select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
    )
