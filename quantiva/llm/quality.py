"""Quality rules: robust multivariate outliers by minimum covariance determinant; DataFrame functions only.

Each text gets a vector of transformed statistics. For each language and source the minimum covariance determinant
is sought: from several starts (medians and absolute deviations, and small subsets picked by hash) concentration
steps take the CORE share of the rows with the least distances as the next subset. After a few steps the start of
least determinant goes on until that no longer falls. Rows far from that estimate (Mahalanobis) are rejected, and so are
rows that fail two plain limits. "Far" is the upper quantile of chi-square for a probability of TAIL, once the
median of the squared distances is brought down to that of chi-square.

All estimates are sums and mergeable quantile sketches that are combined before the shuffle, so one source may hold
any share of the rows. A covariance of so many statistics needs MIN_ROWS rows: smaller groups share one group per
language, those of small languages one for all; if even that is smaller it rejects nothing.

Defined cases: a null text has no words and fails; null languages and sources count as empty strings; repeated
rows are judged alike; rows as far as the cut are in the subset, however many tie; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize, salted_join

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_SHARE, WINDOW = 10, 20, 5
#: the vector: name, and the least standard deviation that counts for it (so that a component that is the same
#: in most rows doesn't make any other value infinitely far)
VECTOR = [("x_words", 1.2), ("x_length", 0.1), ("x_symbols", 0.04), ("x_lines", 0.12), ("x_repeats", 0.06)]
NAMES = [n for n, _ in VECTOR]
MIN_ROWS = 5 * len(VECTOR)
CORE, STARTS, SUBSET, FIRST_STEPS, MAX_STEPS = 0.75, 5, 12, 2, 30
STABLE = 0.01  # least fall of a determinant's logarithm that calls for another step
RANKS = 1000  # accuracy of quantiles: errors of at most one rank in so many
TAIL = 1e-11
GROUPS = 20_000  # rows of a table of groups that are broadcast at most (some 10 MB); larger ones are joined with salt


def chi_square_limit(tail: float, odd: int) -> float:
    """The value that chi-square with ``odd`` degrees of freedom exceeds with probability ``tail``."""

    def above(x: float) -> float:
        total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        for k in range(1, odd, 2):
            total, term = total + term, term * x / (k + 2)
        return total

    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        low, high = ((low + high) / 2, high) if above((low + high) / 2) > tail else (low, (low + high) / 2)
    return low


LIMIT, MEDIAN = chi_square_limit(TAIL, len(VECTOR)), chi_square_limit(0.5, len(VECTOR))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Number of words in windows of ``width`` words that are found twice or more in ``words``.

    Windows are told apart by 64-bit hashes of their words' hashes.
    """

    def covered(windows: Column) -> Column:
        ranked = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda k: F.get(s, k)["w"] == F.get(s, k + 1)["w"]
            hit = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(same(k), F.lit(False)) | (k > 0) & F.coalesce(same(k - 1), F.lit(False)))
            starts = F.array_sort(F.transform(hit, lambda k: F.get(s, k)["i"]))
            # the union of [start, start + width): each start adds what lies beyond the one before it
            add = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(width), p + width - acc["to"])).alias("n"), (p + width).alias("to"))
            return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("to")), add, lambda acc: acc["n"])

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(ranked, positions))

    def windows(hs: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(hs) - width), lambda i: F.xxhash64(*(F.get(hs, i + k) for k in range(width))))
        return F.when(F.size(hs) < width, F.lit(0)).otherwise(_let(made, covered))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), windows).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` of whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
    words = F.filter(F.split("text", BLANK), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    counted = _let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))
    worded = _let(words, lambda ws: F.struct(F.size(ws).alias("n"), repeat_words(ws).alias("rep")))
    got = src.select("doc_id", "lang", "source", F.length(F.translate("text", BLANKS, "")).cast("bigint").alias("word_chars"), (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"), counted.alias("l"), worded.alias("w"))
    return got.select("doc_id", "lang", "source", F.col("w.n").cast("bigint").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").cast("bigint").alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"), F.col("l.n").cast("bigint").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))


def _vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "x_words": F.log(n),
        "x_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "x_symbols": F.log1p(F.col("n_symbols") / n),
        "x_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "x_repeats": F.col("n_repeat_words") / n,
    }


def _entries() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _factor(cov: DataFrame) -> DataFrame:
    """``grp, start``, means, the lower Cholesky factor of the covariances ``c_ij`` with each variance raised by its
    least, and the logarithm of the determinant."""
    made = []
    for j, (_, least) in enumerate(VECTOR):  # adding to the diagonal keeps the matrix positive
        made.append(f"sqrt(greatest(c_{j}{j} + {least * least}D{_less(f'l_{j}{k} * l_{j}{k}' for k in range(j))}, 1e-9D)) as l_{j}{j}")
        made += [f"(c_{i}{j}{_less(f'l_{i}{k} * l_{j}{k}' for k in range(j))}) / l_{j}{j} as l_{i}{j}" for i in range(j + 1, len(NAMES))]
    logdet = " + ".join(f"2 * ln(l_{i}{i})" for i in range(len(NAMES)))
    return cov.selectExpr("grp", "start", *(f"m_{n}" for n in NAMES), *made, f"{logdet} as logdet")  # each may use those before it


def _less(terms) -> str:
    return "".join(f" - {t}" for t in terms)


def _estimate(rows: DataFrame) -> DataFrame:
    """Means and factors of the rows of each ``grp, start``."""
    sums = rows.groupBy("grp", "start").agg(*(F.avg(n).alias(f"m_{n}") for n in NAMES), *(F.avg(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s_{i}{j}") for i, j in _entries()))
    return _factor(sums.select("grp", "start", *(f"m_{n}" for n in NAMES), *((F.col(f"s_{i}{j}") - F.col(f"m_{NAMES[i]}") * F.col(f"m_{NAMES[j]}")).alias(f"c_{i}{j}") for i, j in _entries())))


def _attach(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner", few: bool | None = None) -> DataFrame:
    """Written ``rows`` with the columns of a table of groups; ``few`` says whether it is known to be GROUPS rows at most."""
    if groups.count() <= GROUPS if few is None else few:
        return rows.join(F.broadcast(groups), key, how)
    return salted_join(rows, groups, key, NAMES[0], how)


def _measured(rows: DataFrame) -> DataFrame:
    """``rows``, which have their group's estimate, with the squared Mahalanobis distance ``d2`` by forward substitution."""
    steps = [f"({n} - m_{n}{_less(f'l_{i}{k} * z_{k}' for k in range(i))}) / l_{i}{i} as z_{i}" for i, n in enumerate(NAMES)]
    d2 = " + ".join(f"z_{i} * z_{i}" for i in range(len(NAMES)))
    return rows.selectExpr("*", *steps, f"{d2} as d2").drop(*(f"z_{i}" for i in range(len(NAMES))))


def _starts(core: DataFrame) -> DataFrame:
    """First estimates: start 0 from medians and absolute deviations, the others from some SUBSET rows each."""
    half = lambda c: F.percentile_approx(c, 0.5, RANKS)
    middle = materialize(core.groupBy("grp").agg(F.count("*").alias("n"), *(half(n).alias(f"m_{n}") for n in NAMES)), "quality-middle")
    placed = _attach(core, middle, "grp")
    spread = placed.groupBy("grp").agg(*(F.first(f"m_{n}").alias(f"m_{n}") for n in NAMES), *((1.4826 * half(F.abs(F.col(n) - F.col(f"m_{n}")))).alias(f"d_{i}") for i, n in enumerate(NAMES)))
    robust = _factor(spread.select("grp", F.lit(0).alias("start"), *(f"m_{n}" for n in NAMES), *((F.col(f"d_{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}{j}") for i, j in _entries())))
    few = placed.select("grp", "n", *NAMES, F.explode(F.sequence(F.lit(1), F.lit(STARTS - 1))).alias("start"))
    picked = few.filter(F.pmod(F.xxhash64("start", *NAMES), F.lit(1 << 30)) * F.col("n") < SUBSET * (1 << 30))
    out = materialize(robust.unionByName(_estimate(picked)), "quality-step")
    discard(middle)
    return out


def _step(core: DataFrame, now: DataFrame, share: float, few: bool) -> DataFrame:
    """A written table: the estimates of the ``share`` of rows that are nearest to those of ``now``."""
    far = _measured(_attach(core, now, "grp", few=few))
    cut = far.groupBy("grp", "start").agg(F.percentile_approx("d2", share, RANKS).alias("cut")).join(now, ["grp", "start"])
    after = materialize(_estimate(_measured(_attach(core, cut, "grp", few=few)).filter("d2 <= cut")), "quality-step")
    discard(now)
    return after


def _least(now: DataFrame) -> DataFrame:
    """Of each group's starts the one of least determinant."""
    best = now.groupBy("grp").agg(F.min(F.struct("logdet", "start")).alias("best")).select("grp", F.col("best.start").alias("start"))
    out = materialize(now.join(best, ["grp", "start"]), "quality-best")
    discard(now)
    return out


def least_determinant(core: DataFrame, share: float = CORE) -> DataFrame:
    """A written table: for each ``grp`` of written rows of the vector the estimate of least determinant found.

    All starts take FIRST_STEPS; the best of each group goes on until its determinant no longer falls.
    """
    now = _starts(core)
    few = now.count() <= GROUPS
    for _ in range(FIRST_STEPS):
        now = _step(core, now, share, few)
    now = _least(now)
    was: float | None = None
    for _ in range(MAX_STEPS):
        now = _step(core, now, share, few)
        total = now.agg(F.sum("logdet")).first()[0]  # falls as long as any determinant does
        if was is None or total is None or total < was - STABLE:
            was = total
            if total is not None:
                continue
        break
    return now


def judge(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``d2`` and ``kept`` for every row."""
    named = statistics(docs).withColumns({"own": F.concat(F.lit("2"), "lang", F.lit("\x1f"), "source"), "pooled": F.concat(F.lit("1"), "lang"), **_vector()})
    stats = materialize(named, "quality")
    fit = F.col("n_words") >= MIN_WORDS
    large = lambda key: materialize(stats.filter(fit).groupBy(key).count().filter(F.col("count") >= MIN_ROWS).select(key, F.lit(True).alias(f"has_{key}")), "quality-groups")
    own, pooled = large("own"), large("pooled")
    with_own = _attach(stats, own, "own", "left")
    grouped = with_own.join(F.broadcast(pooled), "pooled", "left") if pooled.count() <= GROUPS else salted_join(with_own, pooled, "pooled", NAMES[0], "left")
    grp = F.when(F.col("has_own"), F.col("own")).when(F.col("has_pooled"), F.col("pooled")).otherwise(F.lit("0"))
    rows = materialize(grouped.withColumn("grp", grp).drop("own", "pooled", "has_own", "has_pooled"), "quality-rows")
    discard(stats, own, pooled)
    core = rows.filter(fit)
    best = least_determinant(core)
    middle = _measured(_attach(core, best, "grp")).groupBy("grp").agg(F.count("*").alias("n_group"), F.percentile_approx("d2", 0.5, RANKS).alias("middle"))
    final = materialize(best.join(middle, "grp"), "quality-final")
    discard(best)
    distance = F.col("d2") * MEDIAN / F.greatest(F.col("middle"), F.lit(MEDIAN))
    far_off = F.coalesce((F.col("n_group") >= MIN_ROWS) & (distance > limit), F.lit(False))
    judged = _measured(_attach(rows, final, "grp", "left"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~far_off).alias("kept"), distance.alias("d2"), "lang", "source")
