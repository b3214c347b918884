"""Quality rules: a decision list learned by sequential covering, emitted as a Spark CASE expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capturelake.llm.common import SPACE_CHARS, cut, few, documents, free_names, let, words_of

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: Bins a feature; a threshold is the edge of a bin.
BINS = 64
#: Where learning ends; :attr:`DecisionList.ended` says if it was there.
MAX_RULES = 32
MAX_CONDITIONS = 3
#: Weight of the share of bad rows that a condition starts from, in rows: small, so that precision counts more than cover.
PRIOR_ROWS = 2
#: A rule must be right on this share of the labelled documents it covers, in both halves, and cover this many.
MIN_PRECISION = 0.95
MIN_COVER = 8

#: Name: expression over the statistics, and the value that fills all bins (None: three bins a doubling).
FEATURES = {
    "n_words": ("n_words", None),
    "word_length": ("word_chars / greatest(n_words, 1)", 16.0),
    "symbol_share": ("n_symbols / greatest(word_chars, 1)", 1.0),
    "upper_share": ("n_upper / greatest(word_chars, 1)", 1.0),
    "repeat_share": ("n_repeat_words / greatest(n_words, 1)", 1.0),
    "dup_lines": ("n_dup_lines", 64.0),
}


def _covered(places: Column) -> Column:
    """Words under windows of three that start at the places (sorted)."""
    return let(places, lambda p: F.aggregate(
        F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), x - F.coalesce(F.get(p, i - 1), F.lit(-3).cast("long")))),
        F.lit(0).cast("long"), lambda total, x: total + x))


def _repeated(words: Column, key=F.xxhash64) -> Column:
    """Words that lie in a window of three words which the text has twice or more.

    Windows are sorted by ``key`` (a 64-bit hash of three words), and neighbours that agree are compared word by word.
    A text in which different windows agree is sorted by the words themselves, so the count is exact for every key.
    """

    def count(w: Column) -> Column:
        n = F.size(w)
        # a window is one long: its hash in the upper bits, its place in as many lower bits as the text needs
        bits = (F.floor(F.log2(n.cast("double"))) + 1).cast("int")
        places = F.sequence(F.lit(0), n - 3)
        top = lambda x, b: F.call_function("shiftright", x, b)
        place = lambda x, b: x - F.call_function("shiftleft", top(x, b), b)
        packed = lambda b: F.transform(places, lambda i: F.call_function("shiftleft", top(key(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), b), b).bitwiseOR(i.cast("long")))

        def clash(s: Column, b: Column) -> Column:
            """Whether two neighbours agree in their hash but not in their words."""

            def differ(x: Column, y: Column) -> Column:
                return let(place(x, b).cast("int"), lambda i: let(place(y, b).cast("int"), lambda j: (F.get(w, i) != F.get(w, j)) | (F.get(w, i + 1) != F.get(w, j + 1)) | (F.get(w, i + 2) != F.get(w, j + 2))))

            pairs = F.transform(s, lambda x, i: F.when((i > 0) & (top(x, b) == top(F.get(s, i - 1), b)), differ(x, F.get(s, i - 1))).otherwise(F.lit(False)))
            return F.exists(pairs, lambda x: x)

        def by_hash(s: Column, b: Column) -> Column:
            like = lambda x, y: F.coalesce(top(x, b) == top(y, b), F.lit(False))
            twice = F.filter(s, lambda x, i: like(x, F.get(s, i - 1)) | like(x, F.get(s, i + 1)))
            return _covered(F.sort_array(F.transform(twice, lambda x: place(x, b))))

        def by_words() -> Column:
            windows = F.sort_array(F.transform(places, lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.cast("long").alias("at"))))

            def twice(s: Column) -> Column:
                like = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
                return F.filter(s, lambda x, i: like(x, F.get(s, i - 1)) | like(x, F.get(s, i + 1)))

            return _covered(F.sort_array(F.transform(let(windows, twice), lambda x: x["at"])))

        return let(bits, lambda b: let(F.sort_array(packed(b)), lambda s: F.when(clash(s, b), by_words()).otherwise(by_hash(s, b))))

    return F.when(F.size(words) >= 3, let(words, count)).otherwise(F.lit(0).cast("long"))


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper (all long) for whole texts.

    A null text counts as ''. Columns of these names that ``df`` has are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.length(F.translate(body, SPACE_CHARS, ""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    words = let(words_of(body), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w).alias("r")))
    return df.withColumns({
        "_words": words,
        "word_chars": bare.cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_upper": (F.length(body) - F.length(F.translate(body, UPPER, ""))).cast("long"),
    }).withColumns({"n_words": F.col("_words.n"), "n_repeat_words": F.col("_words.r")}).drop("_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _bin(name: str) -> Column:
    value, full = FEATURES[name]
    x = F.expr(value).cast("double")
    b = F.floor(F.log2(x + 1) * 3) if full is None else F.floor(x / full * BINS)
    return F.least(F.greatest(b, F.lit(0)), F.lit(BINS - 1)).cast("int")


@dataclass(frozen=True)
class Condition:
    """feature bin >= edge, or < edge."""

    feature: str
    edge: int
    above: bool

    def column(self) -> Column:
        return (F.col(f"bin_{self.feature}") >= self.edge) if self.above else (F.col(f"bin_{self.feature}") < self.edge)

    def text(self) -> str:
        full = FEATURES[self.feature][1]
        value = 2 ** (self.edge / 3) - 1 if full is None else self.edge * full / BINS
        return f"{self.feature} {'>=' if self.above else '<'} {value:.4g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; the first that holds decides (reject), none keeps. ``ended``: 'no rule left', or 'max_rules' where the
    limit stopped the learning."""

    rules: tuple[tuple[Condition, ...], ...]
    ended: str = "no rule left"

    def rule(self) -> Column:
        """Number of the first rule that holds, from 1; 0 if none does. Needs the columns of :func:`with_bins`."""
        out = F.lit(0)
        for n, conditions in reversed(list(enumerate(self.rules, 1))):
            out = F.when(_all(conditions), F.lit(n)).otherwise(out)
        return out

    def text(self) -> list[str]:
        return [" and ".join(c.text() for c in r) for r in self.rules]


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def with_bins(df: DataFrame) -> DataFrame:
    return df.withColumns({f"bin_{f}": _bin(f) for f in FEATURES})


def _histogram(cells: DataFrame, where: Column) -> dict:
    """(feature, bin, part) -> [good, bad] over the labelled cells that ``where`` holds on; at most features x bins x 2 rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in FEATURES]))
    rows = cells.where(where).select(pairs.alias("x"), "part", "good", "bad").groupBy("x.f", "x.b", "part").agg(F.sum("good"), F.sum("bad"))
    return {(r[0], r[1], r[2]): (r[3], r[4]) for r in rows.collect()}


def _count(h: dict, part: int, c: Condition | None = None) -> tuple[int, int]:
    name = c.feature if c else next(iter(FEATURES))
    take = [v for (f, b, p), v in h.items() if f == name and p == part and (c is None or (b >= c.edge) == c.above)]
    return sum(v[0] for v in take), sum(v[1] for v in take)


def _best(h: dict, banned: set[Condition]) -> Condition | None:
    """The condition of best m-estimate on the growing half that is more precise than all rows are."""
    good, bad = _count(h, 0)
    if bad < MIN_COVER or good == 0:
        return None
    prior = bad / (good + bad)
    best, best_score = None, prior
    for f in FEATURES:
        for edge in range(1, BINS):
            for above in (True, False):
                c = Condition(f, edge, above)
                g, b = _count(h, 0, c)
                score = (b + PRIOR_ROWS * prior) / (g + b + PRIOR_ROWS)
                if c not in banned and b >= MIN_COVER and (score, b) > (best_score + 1e-9, 0):
                    best, best_score = c, score
    return best


def _as_broad(c: Condition) -> set[Condition]:
    """The condition and those on the same side of its feature that cover no less."""
    edges = range(1, c.edge + 1) if c.above else range(c.edge, BINS)
    return {Condition(c.feature, e, c.above) for e in edges}


def fit(labelled: DataFrame, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> DecisionList:
    """Learns the list that rejects class 0 from rows (statistics, ``label``, ``key``).

    Sequential covering on counts that Spark groups: rows are first summed by their bins. A rule grows by the
    condition of best m-estimate on the growing half (two thirds by the key's hash), up to ``max_conditions``; then
    conditions whose loss does not lower the precision on the pruning half are dropped; it is kept if it is right on
    MIN_PRECISION of what it covers in both halves. What it covers leaves, and the next rule grows. If no form of a rule is
    precise enough, its first condition is set aside, with those as broad, until a rule is found; learning ends when no first condition is
    left. Without rows of both classes the list is empty.
    """
    part = (F.pmod(F.xxhash64("key"), F.lit(3)) == 0).cast("int").alias("part")
    bins = [f"bin_{f}" for f in FEATURES]
    rows = with_bins(labelled.where("label is not null")).select(*bins, part, (F.col("label") != 0).cast("long").alias("good"), (F.col("label") == 0).cast("long").alias("bad"))
    # each step of the learning reads them all
    cells = few(rows.groupBy(*bins, "part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")))
    rules: list[tuple[Condition, ...]] = []
    free, aside = F.lit(True), set()
    precise = lambda good, bad: bad / max(good + bad, 1)
    whole = _histogram(cells, free)
    while len(rules) < max_rules:
        grown: list[Condition] = []
        while len(grown) < max_conditions:
            h = _histogram(cells, free & _all(grown)) if grown else whole
            best = _best(h, aside if not grown else set())
            if best is None:
                break
            grown.append(best)
        if not grown:
            return DecisionList(tuple(rules))
        score = {}
        for k in range(len(grown) + 1):
            conditions = tuple(grown[:k] + grown[k + 1 :]) if k < len(grown) else tuple(grown)
            if conditions:
                h = _histogram(cells, free & _all(conditions))
                score[conditions] = (_count(h, 0), _count(h, 1))
        full = tuple(grown)
        good_enough = {c: v for c, v in score.items() if precise(*v[0]) >= MIN_PRECISION and precise(*v[1]) >= MIN_PRECISION and v[0][1] + v[1][1] >= MIN_COVER}
        if not good_enough:
            aside |= _as_broad(grown[0])
            continue
        rule = max(good_enough, key=lambda c: (good_enough[c][0][1] + good_enough[c][1][1], -len(c), c == full))
        rules.append(rule)
        free, aside = free & ~_all(rule), set()
        whole = _histogram(cells, free)
    return DecisionList(tuple(rules), "max_rules")


def labelled_statistics(spark, sf_dir: str, stats: DataFrame) -> DataFrame:
    """The statistics of labelled rows with ``label`` and ``key``. A doc_id with several labels has the least, so 0 wins; null labels and ids drop out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.min("quality").alias("label"))
    return stats.join(labels, "doc_id").withColumn("key", F.col("doc_id"))


def verdicts(stats: DataFrame, rules: DecisionList) -> DataFrame:
    """Adds base_failed, rule (0: none) and kept."""
    judged = with_bins(stats).withColumn("rule", rules.rule()).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)).drop(*[f"bin_{f}" for f in FEATURES])


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Every document with its statistics and the verdict of the base rule and the learned list; a null text has no words."""
    stats = cut(with_statistics(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    out = verdicts(stats, fit(labelled_statistics(spark, sf_dir, stats)))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, with all their columns, whatever their names. One doc_id, null too, passes if all its rows do; null and empty texts
    fail the base rule; an empty table stays empty."""
    stats = cut(with_statistics(docs.select("doc_id", "text")).drop("text"))
    judged = verdicts(stats, fit(labelled_statistics(spark, sf_dir, stats)))
    name, kept = free_names(docs.columns, "id", "kept")
    good = judged.groupBy(F.col("doc_id").alias(name)).agg(F.min("kept").alias(kept)).where(F.col(kept))
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
