"""Quality rules: base limits, then robust multivariate outliers.

Statistics of each text are transformed to a vector; for each (language, source), each
language and the whole table a minimum-covariance-determinant estimate is made from the
texts that pass the base limits.  From STARTS, centres at the quartiles, concentration steps
refit mean and covariance on the share SUPPORT of smallest distances, each until its
determinant stops falling; the estimate of least determinant is taken.  A group's estimate
is shrunk towards that of its language, and a language's towards the whole table's, as if
SHRINK texts more had come from there, so that small groups need no rule of their own; the
table is shrunk towards a spread so wide that a few texts reject nothing.  A text is
rejected if its Mahalanobis distance under its group's estimate exceeds CUTOFF.  Quantiles
come from exact counts on a fixed fine grid, so they need neither a sort nor a sketch.
DataFrame and SQL operations only.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm import common
from vellum.llm.text_stats import STATS, with_stats

LEAST_WORDS = 10
#: A text fails if over this share (percent) of its words lie in repeated windows.
MOST_REPEAT_PERCENT = 20
SUPPORT = 0.6
#: Quantiles of each coordinate at which the starts have their centres.
STARTS = (0.5, 0.25, 0.75)
#: Least fall of a determinant's logarithm that counts.
FALL = 1e-6
#: Weight of the parent's estimate, in texts.
SHRINK = 100
#: The chi-squared quantiles of 4 degrees of freedom at SUPPORT and at one in a million.
CHI2_SUPPORT, CUTOFF = 4.0446, 33.377
#: Most rows of (group, estimate) or of rejected texts that are broadcast, 200 bytes each.
BROADCAST_ROWS = 100_000
#: Steps of the grids on which quantiles are counted: of a vector's value, of ln(1 + distance).
VALUE_GRID, DISTANCE_GRID = 200, 50
#: Transformed statistics and the spread that is always granted to each.  Word length is
#: shrunk by 50 words of 5 characters, as short texts scatter widely.
FEATURES = {
    "x1": ("ln((word_chars + 250.0D) / (n_words + 50.0D))", 0.05),
    "x2": ("ln(1.0D + 10.0D * n_symbols / n_words)", 0.25),
    "x3": ("ln(1.0D + n_dup_lines)", 0.7),
    "x4": ("CAST(n_repeat_words AS DOUBLE) / n_words", 0.1),
}
BASE_FAILED = f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words)"
X = list(FEATURES)

#: Mean and covariance from counts and sums, then its Cholesky factor, in evaluation order.
MOMENTS = [("n", "COUNT(*)")] + [(f"s{i}", f"SUM(x{i})") for i in (1, 2, 3, 4)] + [(f"s{i}{j}", f"SUM(x{i} * x{j})") for i in (1, 2, 3, 4) for j in range(1, i + 1)]
MEANS = [(f"m{i}", f"s{i} / n") for i in (1, 2, 3, 4)]
PAIRS = [(i, j) for i in (1, 2, 3, 4) for j in range(1, i + 1)]
SPREAD = [(f"c{i}{j}", f"s{i}{j} / n - m{i} * m{j}" + (f" + {FEATURES[f'x{i}'][1] ** 2:.6f}D" if i == j else "")) for i, j in PAIRS]
FACTOR = []
for _j in (1, 2, 3, 4):
    _minus = "".join(f" - l{_j}{k} * l{_j}{k}" for k in range(1, _j))
    FACTOR.append((f"l{_j}{_j}", f"sqrt(greatest(c{_j}{_j}{_minus}, 1e-12D))"))
    for _i in range(_j + 1, 5):
        _minus = "".join(f" - l{_i}{k} * l{_j}{k}" for k in range(1, _j))
        FACTOR.append((f"l{_i}{_j}", f"(c{_i}{_j}{_minus}) / l{_j}{_j}"))
DETERMINANT = [("det", "ln(l11) + ln(l22) + ln(l33) + ln(l44)")]
M, C, L = [f"m{i}" for i in (1, 2, 3, 4)], [f"c{i}{j}" for i, j in PAIRS], [f"l{i}{j}" for i, j in PAIRS]
PARAMS = M + L
DISTANCE = [(f"z{i}", f"(x{i} - m{i}" + "".join(f" - l{i}{k} * z{k}" for k in range(1, i)) + f") / l{i}{i}") for i in (1, 2, 3, 4)]
DISTANCE += [("d2", "z1 * z1 + z2 * z2 + z3 * z3 + z4 * z4"), ("bin", f"CAST(floor(ln(1.0D + d2) * {DISTANCE_GRID}) AS BIGINT)")]
#: The table's parent: its own centre, and spreads so wide that they reject nothing.
PRIOR = {f"pm{i}": f"m{i}" for i in (1, 2, 3, 4)} | {f"pc{i}{j}": f"{(5 * FEATURES[f'x{i}'][1]) ** 2:.6f}D" if i == j else "0.0D" for i, j in PAIRS} | {"pscale": "1.0D"}
#: From an estimate and its parent's (p...), the shrunk one (q...).
SHRUNK = [(f"q{v}", f"(n * {v} + {SHRINK} * p{v}) / (n + {SHRINK})") for v in (*M, "scale")]
SHRUNK += [(f"qc{i}{j}", f"(n * c{i}{j} + {SHRINK} * pc{i}{j}) / (n + {SHRINK}) + (m{i} - pm{i}) * (m{j} - pm{j}) * (n / (n + {SHRINK})) * ({SHRINK} / (n + {SHRINK}))") for i, j in PAIRS]
SHRUNK_NAMES = [*M, *C, "scale"]


def _steps(df: DataFrame, exprs: list[tuple[str, str]]) -> DataFrame:
    for name, e in exprs:
        df = df.withColumn(name, F.expr(e))
    return df


def _threshold(hist: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Smallest grid value at which the share of rows is reached; hist has value and n."""
    w = Window.partitionBy(*by)
    c = hist.withColumn("__c", F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("n").over(w))
    return c.groupBy(*by).agg(*[F.min(F.when(F.col("__c") >= share * F.col("__n"), F.col(value))).alias(name) for name, share in shares.items()])


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast only if it was counted to be small; else Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _histogram(x: DataFrame, params: DataFrame, by: list[str]) -> DataFrame:
    """Counts and moments of the rows by their distance's bin under each estimate."""
    return _steps(x.join(_small(params), "g"), DISTANCE).groupBy(*by, "bin").agg(*[F.expr(e).alias(k) for k, e in MOMENTS])


def fit(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Estimates by group: g (level and key), n, M, C, scale, before shrinkage."""
    x = stats.filter(f"NOT {BASE_FAILED}").select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), *[F.expr(e).alias(k) for k, (e, _) in FEATURES.items()])
    x = x.select(F.explode_outer(_levels_of("lang", "source")).alias("g"), *X)

    # starts: quartiles and their spreads on the value grid
    long = x.select("g", F.explode_outer(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(k) * VALUE_GRID + 0.5).cast("long").alias("q")) for i, k in enumerate(X, 1)])).alias("v")).select("g", "v.i", "v.q")
    hist = long.groupBy("g", "i", "q").agg(F.count("*").alias("n"))
    at = _threshold(hist, ["g", "i"], "q", {f"q{k}": share for k, share in enumerate(STARTS)})
    wide = at.groupBy("g").agg(*[F.max(F.when(F.col("i") == i, F.col(f"q{k}"))).alias(f"q{k}{i}") for k in range(len(STARTS)) for i in (1, 2, 3, 4)], *[F.max(F.when(F.col("i") == i, F.col("q2") - F.col("q1"))).alias(f"w{i}") for i in (1, 2, 3, 4)])
    starts = [F.struct(F.lit(k).alias("start"), *[(F.col(f"q{k}{i}") / float(VALUE_GRID)).alias(f"m{i}") for i in (1, 2, 3, 4)]) for k in range(len(STARTS))]
    wide = wide.withColumn("s", F.explode_outer(F.array(*starts))).select("g", "s.*", *[f"w{i}" for i in (1, 2, 3, 4)])
    spread = [(f"l{i}{j}", f"w{i} / {VALUE_GRID}.0D / 1.349D + {FEATURES[f'x{i}'][1]}D" if i == j else "0.0D") for i, j in PAIRS]
    now = common.stage(_steps(wide, spread).select("g", "start", *PARAMS, F.lit(float("inf")).alias("det")), "mcd")

    # concentration steps of those estimates whose determinant still falls
    reached, step = [], 0
    while not now.isEmpty():
        step += 1
        h = _histogram(x, now.select("g", "start", *PARAMS), ["g", "start"])
        w = Window.partitionBy("g", "start")
        near = h.withColumn("__c", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).withColumn("__n", F.sum("n").over(w)).filter(F.col("__c") < SUPPORT * F.col("__n"))
        sums = near.groupBy("g", "start").agg(*[F.sum(k).alias(k) for k, _ in MOMENTS])
        old = now.select(F.col("g").alias("__g"), F.col("start").alias("__s"), F.col("det").alias("__d"))
        # joined and written before the filter: neither the aggregate nor a condition should take
        # in the long chain of expressions, which would be written out in full
        made = sums.join(old, (F.col("g") == F.col("__g")) & (F.col("start") == F.col("__s")))
        made = _steps(made, [*MEANS, *SPREAD, *FACTOR, *DETERMINANT]).select("g", "start", F.lit(step).alias("step"), *M, *C, *L, "det", "__d")
        now = common.stage(made, "mcd").filter(F.col("det") < F.col("__d") - FALL).drop("__d")
        reached.append(now)
    if not reached:  # an empty table
        return _steps(wide, [*spread, *[(c, "0.0D") for c in C], ("n", "0L"), ("scale", "1.0D")]).select("g", "n", *SHRUNK_NAMES)
    every = functools.reduce(DataFrame.unionByName, reached)
    least = F.min_by(F.struct(*M, *C, *L), F.struct(F.round("det", 6), "start", -F.col("step")))
    best = common.stage(every.groupBy("g").agg(least.alias("p")).select("g", "p.*"), "mcd")
    h = _histogram(x, best.select("g", *PARAMS), ["g"])
    cut = _threshold(h.select("g", "bin", "n"), ["g"], "bin", {"cut": SUPPORT})
    size = h.groupBy("g").agg(F.sum("n").alias("n"))
    scale = F.expr(f"greatest(1.0D, (exp((cut + 1) / {DISTANCE_GRID}.0D) - 1.0D) / {CHI2_SUPPORT}D)")
    return best.join(cut, "g").join(size, "g").select("g", "n", *M, *C, scale.alias("scale"))


def _model(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """g (language and source), PARAMS and scale, each level shrunk towards the next."""
    fitted = common.stage(fit(stats, lang, source), "mcd")
    parent = None
    for level in (2, 1, 0):
        own = fitted.filter(F.col("g.level") == level)
        if parent is None:
            own = own.withColumns({k: F.expr(e) for k, e in PRIOR.items()})
        else:
            up = F.struct(F.lit(level + 1).alias("level"), (F.col("g.lang") if level == 0 else F.lit("")).alias("lang"), F.lit("").alias("source"))
            own = own.withColumn("__up", up).join(_small(parent), "__up")
        own = _steps(own, SHRUNK)
        parent = own.select(F.col("g").alias("__up"), *[F.col(f"q{k}").alias(f"p{k}") for k in SHRUNK_NAMES])
    return _steps(own.select("g", *[F.col(f"q{k}").alias(k) for k in SHRUNK_NAMES]), FACTOR).select(F.col("g").alias("__m"), *PARAMS, "scale")


def _judged(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """stats with base_failed and kept."""
    model = common.stage(_model(stats, lang, source), "mcd")
    d = stats.withColumns({k: F.expr(f"CASE WHEN {BASE_FAILED} THEN 0.0D ELSE {e} END") for k, (e, _) in FEATURES.items()})
    # a group without a text that passes the base limits has no estimate, and needs none
    d = d.withColumn("__g", _levels_of(lang, source)[0]).join(_small(model), F.col("__g") == F.col("__m"), "left")
    d = _steps(d, DISTANCE).withColumn("base_failed", F.expr(BASE_FAILED))
    return d.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= F.col("scale") * CUTOFF, F.lit(True))).select(*stats.columns, "base_failed", "kept")


def _levels_of(lang: str, source: str):
    def key(level, a, b):
        return F.struct(F.lit(level).alias("level"), a.alias("lang"), b.alias("source"))

    # null is a language and a source like any other; the mark keeps it apart from ''
    a = F.coalesce(F.concat(F.lit("="), F.col(f"`{lang}`")), F.lit("null"))
    b = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit("null"))
    none = F.lit("")
    return F.array(key(0, a, b), key(1, a, none), key(2, none, none))


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """key, STATS, base_failed and kept for each row.

    A null text counts as empty and fails the base limit of words; null languages and
    sources form groups of their own; repeated rows and null keys are kept as rows.  An
    empty table gives no rows.
    """
    narrow = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{lang}`").alias("__lang"), F.col(f"`{source}`").alias("__source"), F.col(f"`{text}`").alias("__text"))
    stats = common.stage(with_stats(narrow, "__text").drop("__text"), "stats")
    return _judged(stats, "__lang", "__source").select(F.col("__key").alias(key), *STATS, "base_failed", "kept")


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names.

    A verdict depends on text, language and source alone.  Only statistics are written; the
    rejected texts, told by 128 bits of hash, are then left out of docs.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    who = [F.xxhash64(body), F.xxhash64(F.lit(1), body), F.coalesce(F.concat(F.lit("="), F.col(f"`{lang}`")), F.lit("null")), F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), F.lit("null"))]
    narrow = docs.select(*[c.alias(f"__h{i}") for i, c in enumerate(who)], F.col(f"`{lang}`").alias("__lang"), F.col(f"`{source}`").alias("__source"), body.alias("__text"))
    stats = common.stage(with_stats(narrow, "__text").drop("__text"), "stats")
    names = [f"__h{i}" for i in range(len(who))]
    gone = common.stage(_judged(stats, "__lang", "__source").filter("NOT kept").select(*names).distinct(), "rejected")
    base = docs.select(*[F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)], *[c.alias(n) for c, n in zip(who, names, strict=True)])
    return base.join(_small(gone), names, "left_anti").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])


def oracle_sql(table: str = "documents", steps: int = 24) -> str:
    """The same rules in DuckDB SQL, texts compared as words, not as hashes; as many steps
    are written out as an estimate may need at the size of the SQL's tables."""
    duck = lambda e: re.sub(r"(?<=[0-9])D\b", "", e)
    w = r"[^\x20\x09-\x0D]"
    ctes = [
        f"doc AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM {table})",
        f"word AS (SELECT rid, doc_id, lang, source, t, regexp_extract_all(t, '{w}+') AS w FROM doc)",
        "win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM word))",
        "twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1)",
        "rep AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid)",
        f"""st AS (SELECT rid, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
              CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
              CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{w}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{w}')))) AS BIGINT) AS n_dup_lines,
              CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM word LEFT JOIN rep USING (rid))""",
        "stat AS (SELECT *, coalesce('=' || lang, 'null') AS a, coalesce('=' || source, 'null') AS b FROM st)",
        "vec AS (SELECT [{'l': 0, 'a': a, 'b': b}, {'l': 1, 'a': a, 'b': ''}, {'l': 2, 'a': '', 'b': ''}] AS gs, " + ", ".join(f"{duck(e)} AS {k}" for k, (e, _) in FEATURES.items()) + f" FROM stat WHERE NOT {BASE_FAILED})",
        f"x AS (SELECT unnest(gs) AS g, {', '.join(X)} FROM vec)",
    ]
    grid = " UNION ALL ".join(f"SELECT g, {i} AS i, CAST(floor(x{i} * {VALUE_GRID} + 0.5) AS BIGINT) AS q FROM x" for i in (1, 2, 3, 4))
    ctes.append(f"h0 AS (SELECT g, i, q, count(*) AS n FROM ({grid}) GROUP BY ALL)")
    ctes.append("h1 AS (SELECT g, i, q, sum(n) OVER (PARTITION BY g, i ORDER BY q) AS c, sum(n) OVER (PARTITION BY g, i) AS t FROM h0)")
    ctes.append("h2 AS (SELECT g, i, min(CASE WHEN c >= 0.25 * t THEN q END) AS qa, min(CASE WHEN c >= 0.5 * t THEN q END) AS qb, min(CASE WHEN c >= 0.75 * t THEN q END) AS qc FROM h1 GROUP BY g, i)")
    ctes.append(f"h3 AS MATERIALIZED (SELECT g, i, qa / {VALUE_GRID}.0 AS qa, qb / {VALUE_GRID}.0 AS qb, qc / {VALUE_GRID}.0 AS qc, (qc - qa) / {VALUE_GRID}.0 / 1.349 AS w FROM h2)")
    spread = ", ".join((f"max(CASE WHEN i = {i} THEN w END) + {FEATURES[f'x{i}'][1]}" if i == j else "0.0") + f" AS l{i}{j}" for i, j in PAIRS)
    begin = [f"SELECT g, {k} AS start, {', '.join(f'max(CASE WHEN i = {i} THEN {q} END) AS m{i}' for i in (1, 2, 3, 4))}, {spread}, 1e300 AS det FROM h3 GROUP BY g" for k, q in enumerate(("qb", "qa", "qc"))]
    ctes.append("p0 AS MATERIALIZED (" + " UNION ALL ".join(begin) + ")")
    dist = ", ".join(f"{duck(e)} AS {k}" for k, e in DISTANCE)
    exprs = lambda es: ", ".join(f"{duck(e)} AS {k}" for k, e in es)
    for t in range(steps):
        ctes.append(f"d{t} AS MATERIALIZED (SELECT g, start, {', '.join(X)}, {dist} FROM x JOIN p{t} USING (g))")
        ctes.append(f"f{t} AS MATERIALIZED (SELECT g, start, min(CASE WHEN c >= {SUPPORT} * t THEN bin END) AS cut FROM (SELECT g, start, bin, sum(count(*)) OVER (PARTITION BY g, start ORDER BY bin) AS c, sum(count(*)) OVER (PARTITION BY g, start) AS t FROM d{t} GROUP BY g, start, bin) GROUP BY g, start)")
        ctes.append(f"k{t} AS MATERIALIZED (SELECT g, start, {', '.join(f'{e} AS {k}' for k, e in MOMENTS)} FROM d{t} JOIN f{t} USING (g, start) WHERE bin <= cut GROUP BY g, start)")
        ctes.append(f"p{t + 1} AS MATERIALIZED (SELECT * FROM (SELECT g, start, {', '.join((*M, *C, *L))}, det FROM (SELECT g, start, {exprs([*MEANS, *SPREAD, *FACTOR, *DETERMINANT])} FROM k{t})) q WHERE q.det < (SELECT o.det FROM p{t} o WHERE o.g = q.g AND o.start = q.start) - {FALL})")
    every = " UNION ALL ".join(f"SELECT {t} AS step, * FROM p{t}" for t in range(1, steps + 1))
    ctes.append(f"best AS MATERIALIZED (SELECT * FROM ({every}) QUALIFY row_number() OVER (PARTITION BY g ORDER BY round(det, 6), start, step DESC) = 1)")
    ctes.append(f"dz AS (SELECT g, {dist} FROM x JOIN best USING (g))")
    ctes.append("ez AS (SELECT g, bin, sum(count(*)) OVER (PARTITION BY g ORDER BY bin) AS c, sum(count(*)) OVER (PARTITION BY g) AS t FROM dz GROUP BY g, bin)")
    ctes.append(f"fz AS (SELECT g, CAST(max(t) AS BIGINT) AS n, min(CASE WHEN c >= {SUPPORT} * t THEN bin END) AS cut FROM ez GROUP BY g)")
    ctes.append(f"fitted AS MATERIALIZED (SELECT g, n, {', '.join((*M, *C))}, greatest(1.0, (exp((cut + 1) / {DISTANCE_GRID}.0) - 1.0) / {CHI2_SUPPORT}) AS scale FROM best JOIN fz USING (g))")
    own = ", ".join(f"s.{v}" for v in ("g", "n", *SHRUNK_NAMES))
    after = ", ".join(f"q{v} AS {v}" for v in SHRUNK_NAMES)
    for level, up in ((2, ""), (1, "''"), (0, "s.g.a")):
        parent = f"SELECT {own}, {', '.join(f'{duck(e)} AS {k}' for k, e in PRIOR.items())} FROM fitted s WHERE s.g.l = 2" if level == 2 else f"SELECT {own}, {', '.join(f'u.{v} AS p{v}' for v in SHRUNK_NAMES)} FROM fitted s JOIN v{level + 1} u ON u.g.a = {up} WHERE s.g.l = {level}"
        ctes.append(f"v{level} AS MATERIALIZED (SELECT g, {after} FROM (SELECT g, {exprs(SHRUNK)} FROM ({parent})))")
    ctes.append(f"model AS (SELECT g, {', '.join(M)}, scale, {exprs(FACTOR)} FROM v0)")
    ctes.append("lev AS (SELECT stat.*, {'l': 0, 'a': stat.a, 'b': stat.b} AS g FROM stat)")
    feats = ", ".join(f"CASE WHEN {BASE_FAILED} THEN 0.0 ELSE {duck(e)} END AS {k}" for k, (e, _) in FEATURES.items())
    ctes.append(f"fin AS (SELECT doc_id, {', '.join(STATS)}, {BASE_FAILED} AS base_failed, scale, {feats}, {dist} FROM lev LEFT JOIN model USING (g))")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, {', '.join(STATS)}, base_failed, (NOT base_failed) AND coalesce(d2 <= scale * {CUTOFF}, true) AS kept FROM fin"
