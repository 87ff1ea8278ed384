"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents fall into cells of source, language and topic. Raking multiplies the cells' token shares, one
margin after the other, until every margin has its target. Documents are then sampled, each with the
probability that gives its cell the raked share of the token budget; a cell that would need more tokens than
it has keeps all of them, the others share the rest, and the weight makes up the difference, so that weighted
samples meet the targets.

Raking goes on until no margin's share is further than ``TOLERANCE`` from its target, or more rounds bring them no nearer, as where targets
contradict each other; ``residual`` tells how far they are.

A margin's values are those named in its targets; all others count as "*". So the number of cells is bounded by the
targets, not by the data. Up to ``ONE_ROW`` cells they are one row while they are raked, and broadcast after; more are raked as a table, by sums over each margin, and joined.

Cases: null source or language is "*"; null and empty texts have no tokens and are sampled by the
probability of their cell, 0 if the cell has no tokens at all; targets are rescaled to the values that occur; rows
without a doc_id are sampled by their text; rows that repeat a doc_id (or, without one, a text) share its fate; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import cut

WORDS = r"[^\x20\x09-\x0D]+"
#: Cells that are raked as one row and broadcast; more are raked as a table.
ONE_ROW = 10_000
#: The share by which a margin may miss its target.
TOLERANCE = 1e-6
TARGETS = {
    "source": {**{f"src{i}": 0.05 for i in range(20)}, "*": 0.05},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.1, "*": 0.05},
    "topic": {"prose": 0.9, "tabular": 0.04, "licence": 0.03, "*": 0.03},
}
#: Rounds between two looks at the residual.
ROUNDS = 20
BUDGET = 0.5


def topic(text: Column) -> Column:
    """A coarse topic from counts over the whole text: a table has a bar to 20 words, a licence speaks of licences once in 200."""
    n = tokens(text)
    bars, licences = F.regexp_count(text, F.lit("[|]")), F.regexp_count(text, F.lit("[Ll][Ii][Cc][Ee][Nn][CcSs]"))
    return F.when(n == 0, "*").when(bars * 20 >= n, "tabular").when(licences * 200 >= n, "licence").otherwise("prose")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def bucketed(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin([k for k in targets if k != "*"]), value).otherwise("*")


def raked(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells(keys..., n) with w, the raked share of tokens."""
    return _in_one_row(cells, targets, rounds, tolerance) if spanned(targets) <= ONE_ROW else _as_table(cells, targets, rounds, tolerance)


def spanned(targets: dict[str, dict[str, float]]) -> int:
    """The cells that targets span."""
    return math.prod(len(set(values) | {"*"}) for values in targets.values())


def _settled(residual: float | None, before: float | None, tolerance: float) -> bool:
    """Whether to stop: near enough, or half of what was missing before is missing still."""
    return residual is None or residual <= tolerance or (before is not None and residual > before / 2)


def _goals(cells: DataFrame, margin: str, goal: dict[str, float]) -> DataFrame:
    """(margin, share) of the values that occur in cells, rescaled to them."""
    table = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in goal.items()], f"{margin} string, goal double")
    occur = cells.select(margin).distinct().join(table, margin, "left").withColumn("goal", F.coalesce("goal", F.lit(0.0)))
    return occur.join(F.broadcast(occur.agg(F.sum("goal").alias("every")))).select(margin, F.coalesce(F.try_divide("goal", "every"), F.lit(0.0)).alias("share"))


def residual(cells: DataFrame, targets: dict[str, dict[str, float]]) -> DataFrame:
    """(margin, value, target, reached, off) of raked cells: the share each value was to have, rescaled to those that occur, and the share it has."""
    out = None
    for d, goal in targets.items():
        sums = cells.groupBy(d).agg(F.sum("w").alias("reached")).join(_goals(cells, d, goal), d)
        rows = sums.select(F.lit(d).alias("margin"), F.col(d).alias("value"), F.col("share").alias("target"), "reached")
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("off", F.abs(F.col("reached") - F.col("target")))


def _in_one_row(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int, tolerance: float) -> DataFrame:
    """All cells, bounded by ONE_ROW, are one row meanwhile."""
    dims = list(targets)
    names = {d: [*(k for k in targets[d] if k != "*"), "*"] for d in dims}
    goal = [F.coalesce(*(F.when(F.col(d) == k, F.lit(float(v))) for k, v in targets[d].items()), F.lit(0.0)) for d in dims]
    place = [F.coalesce(*(F.when(F.col(d) == k, F.lit(i)) for i, k in enumerate(names[d]))) for d in dims]
    cell = F.struct(F.array(*dims).alias("ks"), F.array(*place).alias("ps"), F.array(*goal).alias("ts"), F.col("n").cast("double").alias("n"))
    one = cells.where("n > 0").groupBy().agg(F.array_sort(F.collect_list(cell)).alias("cs"))
    size, most = len(dims), max(len(x) for x in names.values())
    # goals are rescaled to the values that occur
    occur = "aggregate(sequence(0, {last}), 0D, (a, v) -> a + coalesce(get(filter(cs, x -> get(x.ps, {j}) = v), 0).ts[{j}], 0D))"
    whole = ", ".join(occur.format(j=j, last=len(names[d]) - 1) for j, d in enumerate(dims))
    one = one.selectExpr("cs", f"array({whole}) AS goals", "aggregate(cs, 0D, (a, x) -> a + x.n) AS total")
    shares = ", ".join(f"coalesce(try_divide(get(c.ts, {j}), get(goals, {j})), 0D)" for j in range(size))
    one = one.selectExpr(f"transform(cs, c -> named_struct('ks', c.ks, 'ps', c.ps, 'ts', array({shares}), 'n', c.n, 'w', c.n / total)) AS cs")
    # even steps add up the weights by value of one margin, odd steps rake them
    j = f"(i div 2) % {size}"
    add = f"named_struct('cs', s.cs, 'sums', transform(sequence(0, {most - 1}), v -> aggregate(s.cs, 0D, (a, x) -> a + if(get(x.ps, {j}) = v, x.w, 0D))))"
    new = f"named_struct('ks', c.ks, 'ps', c.ps, 'ts', c.ts, 'n', c.n, 'w', if(c.w > 0, c.w * get(c.ts, {j}) / get(s.sums, get(c.ps, {j})), 0D))"
    rake = f"named_struct('cs', transform(s.cs, c -> {new}), 'sums', s.sums)"
    start = "named_struct('cs', cs, 'sums', cast(array() AS array<double>))"
    # the greatest distance of a value's share from its target, over all margins
    off = "array_max(transform(sequence(0, {last}), v -> abs(aggregate(cs, 0D, (a, x) -> a + if(get(x.ps, {j}) = v, x.w, 0D)) - coalesce(get(get(filter(cs, x -> get(x.ps, {j}) = v), 0).ts, {j}), 0D))))"
    offs = ", ".join(off.format(j=j, last=len(names[d]) - 1) for j, d in enumerate(dims))
    before = None
    while True:
        one = cut(one.selectExpr(f"aggregate(sequence(0, {2 * size * rounds - 1}), {start}, (s, i) -> if(i % 2 = 0, {add}, {rake}), s -> s.cs) AS cs"))
        now = one.where("size(cs) > 0").selectExpr(f"array_max(array({offs})) AS off").first()
        if _settled(now and now[0], before, tolerance):
            break
        before = now[0]
    rows = one.select(F.explode("cs").alias("c"))
    return rows.select(*(F.get("c.ks", F.lit(k)).alias(d) for k, d in enumerate(dims)), F.col("c.n").alias("n"), F.col("c.w").alias("w"))


def _as_table(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int, tolerance: float) -> DataFrame:
    """Any number of cells, one row each. A margin's sums have a row for each of its values."""
    from pyspark.sql import Window

    dims = list(targets)
    rows = cells.where("n > 0").select(*dims, F.col("n").cast("double").alias("n"))
    rows = rows.withColumn("w", F.col("n") / F.lit(rows.agg(F.sum("n")).first()[0]))
    for d in dims:
        rows = rows.join(_goals(rows, d, targets[d]).withColumnRenamed("share", f"share_{d}"), d)
    rows, before = cut(rows), None
    while True:
        for _ in range(rounds):
            for d in dims:
                by = F.col(f"share_{d}") / F.sum("w").over(Window.partitionBy(d))
                rows = rows.withColumn("w", F.when(F.col("w") > 0, F.col("w") * by).otherwise(F.lit(0.0)))
            rows = cut(rows)
        now = residual(rows, targets).agg(F.max("off")).first()[0]
        if _settled(now, before, tolerance):
            return rows.select(*dims, "n", "w")
        before = now


def probabilities(cells: DataFrame, dims: list[str], budget: float) -> DataFrame:
    """cells(keys..., n, w) with p and weight: p = min(1, x * w / n), x such that the expected tokens are the budget's share."""
    from pyspark.sql import Window

    rate = F.col("w") / F.col("n")
    order = Window.partitionBy("one").orderBy(F.col("rate").desc(), *dims)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy("one")
    rows = cells.withColumn("rate", rate).withColumn("one", F.lit(1))
    rows = rows.withColumn("total", F.sum("n").over(every)).withColumn("before", before).withColumn("after", after)
    x = (F.lit(float(budget)) * F.col("total") - F.col("before")) / F.col("after")
    rows = rows.withColumn("x", F.when(F.col("after") > 0, x)).withColumn("fits", F.col("x") * F.col("rate") <= 1)
    # rates fall, and the first that fits settles x; if none does, all cells with a share are kept whole
    found = F.min(F.when(F.col("fits"), F.struct(-F.col("rate"), F.col("x").alias("x")))).over(every)["x"]
    most = F.max(F.when(F.col("rate") > 0, 1 / F.col("rate"))).over(every)
    rows = rows.withColumn("scale", F.coalesce(F.greatest(found, F.lit(0.0)), most))
    wanted = F.col("scale") * F.col("rate")
    return rows.select(*dims, F.least(F.lit(1.0), wanted).alias("p"), F.when(wanted > 1, wanted).otherwise(F.lit(1.0)).alias("weight"))


def chance(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from the doc_id, or without one from the text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def _made(documents: DataFrame, targets: dict[str, dict[str, float]], topic_of) -> tuple[DataFrame, DataFrame]:
    """The rows with topic, n_tokens and their cell, and the cells (keys..., n)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    about = F.col(topic_of).cast("string") if isinstance(topic_of, str) else topic_of(text)
    own = [c for c in documents.columns if c not in ("topic", "n_tokens", "probability", "sample_weight")]
    made = documents.select(*own, F.coalesce(about, F.lit("*")).alias("topic"), tokens(text).alias("n_tokens"))
    keys = [bucketed(F.coalesce(F.col(d).cast("string"), F.lit("*")), targets[d]).alias(f"__mix_{d}") for d in targets]
    cells = made.select(*keys, "n_tokens").groupBy(*(f"__mix_{d}" for d in targets)).agg(F.sum("n_tokens").alias("n"))
    return made.select("*", *keys), cells.select(*(F.col(f"__mix_{d}").alias(d) for d in targets), "n")


def balance(documents: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, rounds: int = ROUNDS, tolerance: float = TOLERANCE, topic_of=topic) -> DataFrame:
    """The targets, and how near raking comes to them: margin, value, target, reached, off."""
    _, cells = _made(documents, targets, topic_of)
    return residual(raked(cells, targets, rounds, tolerance), targets)


def mix(documents: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, budget: float = BUDGET, rounds: int = ROUNDS, seed: str = "mix", topic_of=topic, tolerance: float = TOLERANCE) -> DataFrame:
    """The sampled rows of documents, with their own columns and topic, n_tokens, probability and sample_weight.

    targets: shares of tokens by value for source, lang and topic. budget: share of all tokens to sample. topic_of: a column of documents, or a function of the text."""
    made, cells = _made(documents, targets, topic_of)
    dims = list(targets)
    own = [c for c in documents.columns if c not in ("topic", "n_tokens", "probability", "sample_weight")]
    cells = raked(cells, targets, rounds, tolerance)
    table = probabilities(cells, dims, budget).select(*(F.col(d).alias(f"__mix_{d}") for d in dims), F.col("p").alias("__mix_p"), F.col("weight").alias("__mix_w"))
    drawn = made.join(F.broadcast(table) if spanned(targets) <= ONE_ROW else table, [f"__mix_{d}" for d in dims])
    drawn = drawn.where(chance(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")), seed) < F.col("__mix_p"))
    return drawn.select(*own, "topic", "n_tokens", F.col("__mix_p").alias("probability"), F.col("__mix_w").alias("sample_weight"))


def sql(documents: str = "documents", targets=TARGETS, budget: float = BUDGET, rounds: int = ROUNDS, seed: str = "mix") -> str:
    """DuckDB SQL for mix(): doc_id, topic, n_tokens, and probability and sample_weight to six places."""
    words = r"[^\x20\x09-\x0D]+"
    dims = list(targets)
    column = {"source": "source", "lang": "lang", "topic": "topic"}
    named = lambda d: ", ".join(f"'{k}'" for k in targets[d] if k != "*")
    goal = lambda d: f"CASE {d} " + " ".join(f"WHEN '{k}' THEN {float(v)}::DOUBLE" for k, v in targets[d].items()) + " ELSE 0::DOUBLE END"
    steps = [
        f"""counted AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '{words}'))::BIGINT AS n_tokens FROM {documents})""",
        """made AS (SELECT doc_id, source, lang, n_tokens, coalesce(doc_id::VARCHAR, 'text:' || md5(text)) AS name,
  CASE WHEN n_tokens = 0 THEN '*' WHEN 20 * len(regexp_extract_all(text, '[|]')) >= n_tokens THEN 'tabular' WHEN 200 * len(regexp_extract_all(text, '[Ll][Ii][Cc][Ee][Nn][CcSs]')) >= n_tokens THEN 'licence' ELSE 'prose' END AS topic FROM counted)""",
        "keyed AS (SELECT doc_id, name, topic AS own_topic, n_tokens, " + ", ".join(f"CASE WHEN {column[d]} IN ({named(d)}) THEN {column[d]} ELSE '*' END AS {d}" for d in dims) + " FROM made)",
        f"cells AS (SELECT {', '.join(dims)}, sum(n_tokens)::DOUBLE AS n FROM keyed GROUP BY ALL HAVING sum(n_tokens) > 0)",
        "goals AS (SELECT *, " + ", ".join(f"{goal(d)} AS g_{d}" for d in dims) + " FROM cells)",
        "parts AS (SELECT *, " + ", ".join(f"g_{d} / count(*) OVER (PARTITION BY {d}) AS u_{d}" for d in dims) + " FROM goals)",
        f"w0 AS (SELECT {', '.join(dims)}, n, " + ", ".join(f"g_{d} / sum(u_{d}) OVER () AS t_{d}" for d in dims) + ", n / sum(n) OVER () AS w FROM parts)",
    ]
    for i in range(rounds * len(dims)):
        d = dims[i % len(dims)]
        steps.append(f"w{i + 1} AS MATERIALIZED (SELECT {', '.join(dims)}, n, {', '.join(f't_{x}' for x in dims)}, CASE WHEN w > 0 THEN w * t_{d} / sum(w) OVER (PARTITION BY {d}) ELSE 0 END AS w FROM w{i})")
    order = f"ORDER BY w / n DESC, {', '.join(dims)}"
    steps += [
        f"""sorted AS (SELECT *, w / n AS rate, sum(n) OVER () AS total, coalesce(sum(n) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM w{rounds * len(dims)})""",
        f"tried AS (SELECT *, CASE WHEN after > 0 THEN ({float(budget)}::DOUBLE * total - before) / after END AS x FROM sorted)",
        "scaled AS (SELECT *, coalesce(greatest((SELECT arg_max(x, rate) FROM tried WHERE x * rate <= 1), 0), (SELECT max(1 / rate) FROM tried WHERE rate > 0)) AS scale FROM tried)",
        f"table_p AS (SELECT {', '.join(dims)}, least(1::DOUBLE, scale * rate) AS p, CASE WHEN scale * rate > 1 THEN scale * rate ELSE 1::DOUBLE END AS weight FROM scaled)",
    ]
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, own_topic AS topic, n_tokens, round(p, 6) AS probability, round(weight, 6) AS sample_weight FROM keyed JOIN table_p USING ({', '.join(dims)})"
        f" WHERE ('0x' || substr(md5('{seed}:' || name), 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE < p"
    )
