"""Quality rules with DataFrame functions only.

Base statistics of a text are counted in one projection.  Then a robust
multivariate outlier test runs: for each language and source, a minimum
covariance determinant (MCD) estimate of centre and scatter of transformed
statistics, and rejection by Mahalanobis distance.

MCD by concentration steps.  A step keeps the ``h`` share of rows nearest to the
group's estimate and takes mean and covariance of these; that never raises the
determinant.  Each group has three starts: medians with the floors as scale, medians
with the coordinate-wise median absolute deviations, and mean and covariance of all
rows.  After ``TRIAL`` steps the start of the least determinant goes on, until no
group's logarithm of the determinant falls by ``SETTLED``, for ``STEPS`` more at most.
Three fixed starts are fewer than the hundreds of random ones that are usual for small
data; a test compares the outcome with these.

Quantiles are exact within a fixed logarithmic grid: rows are counted by (group,
start, cell), map-side first.  Means and covariances are sums, combined map-side.  The
Cholesky factor of a group's scatter and the distances are column expressions.  Rows
are never exchanged by group: the table of estimates, a row for each group and start,
is broadcast if it has ``BROADCAST_GROUPS`` rows at most, and else joined by group and
salt.  Only a count and a difference reach the driver, and rows carry their numbers
along, never their text.

Groups of fewer than ``min_group`` rows pool by language, and pools that are still
small pool over languages.  A floor is added to the variances, since most texts
have no symbol and no repeated line at all.

Defined results: a null text has no words (base_failed); null lang or source is a
value of its own; repeated rows are rows of their own; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuplewise.llm.common import cut, temporary

#: characters that separate words, and characters that count as symbols (fixed values)
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

H = 0.75
TRIAL, STEPS, SETTLED = 2, 10, 1e-4
#: rows of estimates (of some 200 bytes) that are broadcast; more are joined by group and one of SALTS salts
BROADCAST_GROUPS, SALTS = 20_000, 64
MIN_GROUP = 200
#: share of ordinary rows that may lie beyond the cut-off, were the statistics normal
TAIL = 1e-9
#: transformed statistics, and the standard deviation that is granted to each at least
FEATURES = {"f_length": 0.05, "f_symbol": 0.25, "f_line": 0.5, "f_repeat": 0.25, "f_upper": 0.25}
_CELLS = 256  # of the distance grid for each power of e


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated(words: Column) -> Column:
    """Words that lie in a five-word window found twice or more in the text."""

    def covered(pairs: Column) -> Column:
        last = F.size(pairs) - 1
        hash_at = lambda i: F.get(pairs, i)["g"]
        twice = F.filter(pairs, lambda p, i: ((i > 0) & (hash_at(i - 1) == p["g"])) | ((i < last) & (hash_at(i + 1) == p["g"])))
        starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
        gaps = let(starts, lambda s: F.transform(s, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(s, i + 1) - x, F.lit(5)))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def counted(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(pairs, covered)).otherwise(0)

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    return F.when(F.size(words) > 5, let(grams, counted)).otherwise(0)


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) with the base statistics and a hash instead of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        let(words, lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(w).cast("long").alias("n_repeat_words"),
        )).alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_upper"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    out = named.select("doc_id", "lang", "source", "text_hash", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "n_upper", "l.n_lines")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _transformed(stats: DataFrame) -> DataFrame:
    """Ratios, steadied for short texts by a prior weight, on a logarithmic scale."""
    rate = lambda n, of, prior: F.log1p(20.0 * F.col(n) / (F.col(of) + F.lit(prior)))
    return stats.withColumns({
        "f_length": F.log((F.col("word_chars") + 300.0) / (F.col("n_words") + 50.0)),
        "f_symbol": rate("n_symbols", "n_words", 50.0),
        "f_line": rate("n_dup_lines", "n_lines", 10.0),
        "f_repeat": rate("n_repeat_words", "n_words", 50.0),
        "f_upper": rate("n_upper", "word_chars", 300.0),
    })


def chi2_share(x: float, p: int) -> float:
    """P(chi-square with p degrees of freedom <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = p / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def chi2_point(share: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, p) < share else (low, mid)
    return high


def _at_share(rows: DataFrame, by: list[str], cell: str, share: float) -> DataFrame:
    """For each ``by``, the smallest cell up to which at least ``share`` of its rows lie."""
    counted = rows.groupBy(*by, cell).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by)
    up = counted.withColumns({"_up": F.sum("_n").over(w.orderBy(cell)), "_all": F.sum("_n").over(w)})
    return up.filter(F.col("_up") >= F.lit(share) * F.col("_all")).groupBy(*by).agg(F.min(cell).alias("_at"))


def _grouped(rows: DataFrame, min_group: int) -> DataFrame:
    """Adds ``_grp``: language and source, the language's pool, or the pool of all."""
    named = rows.withColumns({"_lang": F.coalesce("lang", F.lit("\x00")), "_source": F.coalesce("source", F.lit("\x00"))})
    sizes = named.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("_n"))
    small = F.col("_n") < min_group
    pools = sizes.filter(small).groupBy("_lang").agg(F.sum("_n").alias("_pool"))
    own = F.to_json(F.array("_lang", "_source"))
    keys = sizes.join(pools, "_lang", "left").select(
        "_lang", "_source",
        F.when(~small, own).when(F.col("_pool") >= min_group, F.to_json(F.array("_lang"))).otherwise("[]").alias("_grp"),
    )
    keys = cut(keys)
    return _beside(named, keys, ["_lang", "_source"], _few(keys)).drop("_lang", "_source")


def _few(table: DataFrame) -> bool:
    return table.count() <= BROADCAST_GROUPS


def _beside(rows: DataFrame, table: DataFrame, by: list[str], few: bool) -> DataFrame:
    """``rows`` with the columns of a ``table`` of groups: its one row, or few rows, of the same ``by``; ``few``: the table may be broadcast."""
    if few:
        return rows.join(F.broadcast(table), by)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, [*by, "_salt"]).drop("_salt")


def _medians(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    """A row for each group with the medians of ``values``, to a 64th, as columns name0, name1, ..."""
    cells = F.array(*[F.struct(F.lit(k).alias("_k"), F.round(v * 64).cast("long").alias("_cell")) for k, v in enumerate(values)])
    long = rows.select("_grp", F.explode(cells).alias("_c")).select("_grp", "_c._k", "_c._cell")
    at = _at_share(long, ["_grp", "_k"], "_cell", 0.5)
    return at.groupBy("_grp").agg(*[F.max(F.when(F.col("_k") == k, F.col("_at") / 64.0)).alias(f"{name}{k}") for k in range(len(values))])


def _sums(rows: DataFrame, names: list[str], *by: str) -> DataFrame:
    p = len(names)
    sums = [F.sum(n).alias(f"_s{i}") for i, n in enumerate(names)]
    products = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"_q{i}_{j}") for i in range(p) for j in range(i + 1)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *sums, *products)


def _factored(moments: DataFrame, floors: list[float], factor: float) -> DataFrame:
    """From sums to mean, Cholesky factor and log determinant of the scatter, as columns _m{i}, _l{i}_{j} and _det."""
    p = len(floors)
    out = moments.withColumns({f"_m{i}": F.col(f"_s{i}") / F.col("_n") for i in range(p)})
    cov = {(i, j): F.lit(factor) * (F.col(f"_q{i}_{j}") / F.col("_n") - F.col(f"_m{i}") * F.col(f"_m{j}")) for i in range(p) for j in range(i + 1)}
    for j in range(p):
        left = cov[j, j] + F.lit(floors[j] ** 2)
        for k in range(j):
            left = left - F.col(f"_l{j}_{k}") * F.col(f"_l{j}_{k}")
        out = out.withColumn(f"_l{j}_{j}", F.sqrt(F.greatest(left, F.lit(floors[j] ** 2))))
        for i in range(j + 1, p):
            left = cov[i, j]
            for k in range(j):
                left = left - F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}")
            out = out.withColumn(f"_l{i}_{j}", left / F.col(f"_l{j}_{j}"))
    return out.select("_grp", "_start", *_parts(p), _log_det(p))


def _parts(p: int) -> list[str]:
    return [f"_m{i}" for i in range(p)] + [f"_l{i}_{j}" for i in range(p) for j in range(i + 1)]


def _log_det(p: int) -> Column:
    return sum((2 * F.log(F.col(f"_l{i}_{i}")) for i in range(1, p)), 2 * F.log(F.col("_l0_0"))).alias("_det")


def _distances(rows: DataFrame, estimate: DataFrame, names: list[str], few: bool, more: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the squared Mahalanobis distance ``distance2`` from their group's estimates, and the columns ``more`` of these."""
    out = _beside(rows, estimate, ["_grp"], few)
    p = len(names)
    for i in range(p):
        left = F.col(names[i]) - F.col(f"_m{i}")
        for k in range(i):
            left = left - F.col(f"_l{i}_{k}") * F.col(f"_y{k}")
        out = out.withColumn(f"_y{i}", left / F.col(f"_l{i}_{i}"))
    total = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, p)), F.col("_y0") * F.col("_y0"))
    return out.withColumn("distance2", total).select(*rows.columns, *more, "distance2")


def _starts(rows: DataFrame, names: list[str], floors: list[float]) -> DataFrame:
    """Three estimates for each group: _grp, _start, mean and Cholesky factor, _det."""
    p = len(names)
    middle = cut(_medians(rows, [F.col(n) for n in names], "_m"))
    spread = _medians(_beside(rows, middle, ["_grp"], _few(middle)), [F.abs(F.col(n) - F.col(f"_m{i}")) for i, n in enumerate(names)], "_d")
    plain = middle.join(spread, "_grp")
    scaled = lambda start, own: plain.withColumns({"_start": F.lit(start)} | {f"_l{i}_{j}": own(i) if i == j else F.lit(0.0) for i in range(p) for j in range(i + 1)})
    both = scaled(0, lambda i: F.lit(floors[i])).unionByName(scaled(1, lambda i: F.greatest(1.4826 * F.col(f"_d{i}"), F.lit(floors[i]))))
    whole = _factored(_sums(rows.withColumn("_start", F.lit(2)), names, "_grp", "_start"), floors, 1.0)
    return both.select("_grp", "_start", *_parts(p), _log_det(p)).unionByName(whole)


def mcd_estimates(rows: DataFrame, features: dict[str, float], h: float = H, steps: int = STEPS) -> DataFrame:
    """A row for each ``_grp`` of the stored ``rows``: its MCD estimate as mean, Cholesky factor and log determinant."""
    names, floors = list(features), list(features.values())
    p = len(names)
    q = chi2_point(h, p)
    factor = h / chi2_share(q, p + 2)  # makes the scatter of the nearest h unbiased for normal rows
    rows = rows.select("_grp", *names)
    cell = F.floor(F.log1p(F.col("distance2")) * _CELLS).cast("long")
    estimate = cut(_starts(rows, names, floors))
    few = _few(estimate)  # of three starts; later there are fewer
    for turn in range(TRIAL + steps):
        near = _distances(rows, estimate, names, few, ("_start",)).withColumn("_cell", cell)
        limit = estimate.join(_at_share(near, ["_grp", "_start"], "_cell", h), ["_grp", "_start"])
        kept = _distances(rows, limit, names, few, ("_start", "_at")).filter(cell <= F.col("_at"))
        step = _factored(_sums(kept, names, "_grp", "_start"), floors, factor)
        if turn < TRIAL - 1:
            estimate = cut(step)
        elif turn == TRIAL - 1:
            best = F.min(F.struct("_det", "_start", *_parts(p))).alias("best")
            estimate = cut(step.groupBy("_grp").agg(best).select("_grp", "best.*"))
        else:
            step = cut(step.withColumnRenamed("_det", "_new").join(estimate.select("_grp", F.col("_det").alias("_was")), "_grp"))
            fall = step.agg(F.max(F.col("_was") - F.col("_new"))).first()[0]
            estimate = step.withColumnRenamed("_new", "_det").drop("_was")
            if fall is None or fall < SETTLED:
                break
    return estimate.drop("_start")


def mcd_distances(rows: DataFrame, features: dict[str, float], h: float = H, steps: int = STEPS, min_group: int = MIN_GROUP) -> DataFrame:
    """``rows`` (lang, source and ``features``) with ``distance2`` under their group's MCD estimate.

    ``features`` gives each column's floor on the standard deviation.
    """
    rows = cut(_grouped(rows, min_group))
    with temporary(rows.sparkSession):
        estimate = cut(mcd_estimates(rows, features, h, steps), lasting=True)
    return _distances(rows, estimate, list(features), _few(estimate)).drop("_grp")


def quality_rules(docs: DataFrame, h: float = H, steps: int = STEPS, min_group: int = MIN_GROUP, tail: float = TAIL) -> DataFrame:
    """A row per document with its statistics, ``base_failed``, ``distance2`` and ``kept``."""
    rows = cut(_transformed(statistics(docs)))
    out = mcd_distances(rows, FEATURES, h, steps, min_group)
    far = F.col("distance2") > chi2_point(1 - tail, len(FEATURES))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "lang", "source", "n_upper", "n_lines", *FEATURES, "distance2", "text_hash",
    )
