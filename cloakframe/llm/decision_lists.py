"""Quality rules learned as a decision list: conjunctions of thresholds, grown, pruned and put in order.

Every text gets a row of statistics, computed inside its row by Spark's own functions.  On a sample of labelled
texts sequential covering learns rules for *low* quality: a rule grows by the threshold with the highest
information gain on two thirds of the sample, loses its last conditions while that improves it on the other third,
and is kept if it is precise enough there; what it covers goes, and the next one is grown.  Growing needs only
counts by feature and bin, so no row reaches the driver.  The list is emitted as one conditional expression.

Defined cases: null and empty texts have zero words and fail the base rules; rows with null ids are scored like
others, and rows that repeat an id each by its own text; labels that are null, or whose id is not among the texts,
teach nothing; with no labels, or labels of one kind only, the list is empty and the base rules alone decide; the
caller's columns travel in one struct ``row``, whatever their names are; texts are read whole.

The list has at most ``max_rules`` rules of at most ``max_conditions`` thresholds, drawn from twice ``bins`` quantiles
of each feature: parameters of the learner, alike at every size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.text import with_computed
from cloakframe.llm.common import hash_sample, words
from cloakframe.sources.staging import staged

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_NO_SPACE = r"[^\x20\x09-\x0D]"


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, stats): the columns of ``docs`` in a struct, the base counts and ``n_lines``, ``n_distinct`` and
    ``n_upper`` in another.

    Cost is that of sorting a text's three-word windows, and only texts that repeat one are sorted.
    """
    text = F.coalesce(F.col("_t"), F.lit(""))
    df = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("_t"))
    df = df.withColumn("_w", words(F.col("_t")))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    h = F.col("_h")
    df = df.withColumn("_g", F.when(F.size("_h") > 2, F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(h, i + 1), F.get(h, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    g = F.col("_g")
    repeated = F.size(F.array_distinct(g)) < F.size(g)
    df = df.withColumn("_s", F.when(repeated, F.sort_array(F.transform(g, lambda k, i: F.struct(
        k.alias("k"), i.alias("i"))))))
    s = F.col("_s")
    same = lambda x, k: F.coalesce(x["k"] == F.get(s, k)["k"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(
        F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    p = F.col("_p")
    steps = F.transform(p, lambda v, k: F.least(F.coalesce(F.get(p, k + 1) - v, F.lit(3)), F.lit(3)))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_NO_SPACE))
    df = df.withColumn("_lines", lines)
    stats = F.struct(
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(steps, F.lit(0), lambda a, v: a + v), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_h")).cast("long").alias("n_distinct"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
    )
    return with_computed(df, "stats", stats).select("row", "stats")


def base_failed(stats: str = "stats") -> Column:
    s = F.col(stats)
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def features(stats: str = "stats") -> dict[str, Column]:
    """What rules may ask for: shares, so that long and short texts compare."""
    s = F.col(stats)

    def share(a: str, b: str) -> Column:
        return F.coalesce(s[a] / F.nullif(s[b], F.lit(0).cast("long")), F.lit(0.0))

    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "duplicate_line_share": share("n_dup_lines", "n_lines"),
        "repeated_word_share": share("n_repeat_words", "n_words"),
        "distinct_word_share": share("n_distinct", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "mean_word_chars": share("word_chars", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def test(self, value: Column) -> Column:
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a text is of low quality as soon as one holds."""

    rules: list[list[Condition]] = field(default_factory=list)

    def fired(self, values: dict[str, Column]) -> Column:
        """The number of the first rule that holds, else null."""
        out = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules))):
            out = F.when(_all(rule, values), F.lit(i)).otherwise(out)
        return out


def _all(rule: list[Condition], values: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, (c.test(values[c.feature]) for c in rule), F.lit(True))


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = 20_000, bins: int = 32, max_rules: int = 8, max_conditions: int = 3,
    precision: float = 0.97, support: int = 5,
) -> DecisionList:
    """A decision list for label 0 from about ``max_labelled`` labelled rows, chosen by a hash of their ids; their
    ids and labels alone are broadcast, which bounds that table's size."""
    given = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(
        "_y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"))
    given = hash_sample(given, "_id", max_labelled)
    df = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(given), "_id")
    df = with_statistics(df, "_t")
    names = list(features())
    df = staged(df.select("row._id", "row._y", *[v.alias(k) for k, v in features().items()]), "labelled-statistics")
    cuts = _cuts(df, names, bins)
    if not cuts:
        return DecisionList()

    split = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(3)) < 2
    bad, good = (F.count(F.when(F.col("_y") == y, 1)) for y in (0, 1))
    values = {n: F.col(n) for n in names}
    rules: list[list[Condition]] = []
    left = df
    while len(rules) < max_rules:
        rule: list[Condition] = []
        now = left.where(split)
        while len(rule) < max_conditions:
            best = _grow(now, cuts)
            if best is None:
                break
            condition, spoiled = best
            rule.append(condition)
            now = now.where(condition.test(F.col(condition.feature)))
            if not spoiled:
                break
        if not rule:
            break
        sizes = left.where(~split).agg(*[
            e for i in range(1, len(rule) + 1) for e in (
                F.count(F.when(_all(rule[:i], values) & (F.col("_y") == 0), 1)).alias(f"p{i}"),
                F.count(F.when(_all(rule[:i], values) & (F.col("_y") == 1), 1)).alias(f"n{i}"))]).first()
        worth = {i: (sizes[f"p{i}"] - sizes[f"n{i}"]) / max(1, sizes[f"p{i}"] + sizes[f"n{i}"])
                 for i in range(1, len(rule) + 1)}
        keep = max(worth, key=lambda i: (worth[i], -i))
        p, n = sizes[f"p{keep}"], sizes[f"n{keep}"]
        if p < support or p < precision * (p + n):
            break
        rules.append(rule[:keep])
        left = left.where(~_all(rule[:keep], values))
        if not left.agg(bad.alias("bad"), good.alias("good")).first()["bad"]:
            break
    return DecisionList(rules)


def _cuts(df: DataFrame, names: list[str], bins: int) -> dict[str, list[float]]:
    """Thresholds by feature: quantiles of either kind of text; none if one kind is missing."""
    at = [(i + 0.5) / bins for i in range(bins)]
    found = {r["_y"]: r for r in df.groupBy("_y").agg(
        *[F.percentile_approx(n, at).alias(n) for n in names]).collect()}
    if len(found) < 2:
        return {}
    return {n: sorted({*found[0][n], *found[1][n]}) for n in names}


def _grow(df: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition, int] | None:
    """The condition with the highest gain over ``df`` and the good texts it still covers."""
    def passed(name: str) -> Column:
        return F.size(F.filter(F.lit(cuts[name]), lambda t: t <= F.col(name)))

    place = F.array(*[F.struct(F.lit(n).alias("f"), passed(n).alias("bin")) for n in cuts])
    counts = df.select("_y", F.explode(place).alias("x")).groupBy("x.f", "x.bin").agg(
        F.count(F.when(F.col("_y") == 0, 1)).alias("p"), F.count(F.when(F.col("_y") == 1, 1)).alias("n")).collect()
    best, gain = None, 1e-9
    for name, thresholds in cuts.items():
        rows = {r["bin"]: (r["p"], r["n"]) for r in counts if r["f"] == name}
        p_all, n_all = (sum(r[i] for r in rows.values()) for i in (0, 1))
        if not p_all or not n_all:
            return None
        before, p_low, n_low = log2(p_all / (p_all + n_all)), 0, 0
        for i, t in enumerate(thresholds):
            p_low, n_low = (a + b for a, b in zip((p_low, n_low), rows.get(i, (0, 0))))
            for at_least, p, n in ((True, p_all - p_low, n_all - n_low), (False, p_low, n_low)):
                if p and (g := p * (log2(p / (p + n)) - before)) > gain:
                    best, gain = (Condition(name, at_least, t), n), g
    return best


def judged(docs: DataFrame, rules: DecisionList, text_col: str = "text") -> DataFrame:
    """(row, stats, base_failed, rule, kept): ``row`` holds the columns of ``docs``, ``rule`` is the first that holds."""
    df = with_statistics(docs, text_col)
    return df.withColumns({
        "base_failed": base_failed(),
        "rule": rules.fired(features()),
    }).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
