"""Quality rules as weak supervision.

Each rule votes that a document is good or bad, or abstains. Expectation
maximisation over the corpus estimates how often each rule votes each way on
good and on bad documents, and the posterior probability of being good takes
the place of a filter that all rules must pass. The votes of m rules have at
most 3^m patterns, so the corpus comes down to a small table of pattern counts,
and the estimation runs as one SQL expression over that. Which class is the bad
one is told by an anchor: documents that fail the base rules are known to be bad.
Nothing else ties a rule to a direction: one that votes at random ends without
weight, one that is wrong ends with the opposite. All of it is DataFrame
functions; a document's features come from its own row without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, cut, let, words

WINDOW, ROUNDS, THRESHOLD = 5, 30, 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of running text: letters or digits, inner marks, and at most one mark on either side.
_PLAIN = r"^[(\[\"'«„“¿¡]?[\p{L}\p{M}\p{N}]++(?:['’.@:/+，。、；：！？·…-]++[\p{L}\p{M}\p{N}]++)*+[.,;:!?)\]\"'»“”…。，、；：！？]?$"
#: Documents added to each rule's counts of bad votes, abstentions and good votes, in good and in bad documents: a weak prior.
PRIOR = ((1.0, 5.0, 10.0), (10.0, 5.0, 1.0))
#: The log-odds that votes start with: bad ones weigh four times a good one.
START = (-2.0, 0.0, 0.5)


def _chars(text: Column, chars: str) -> Column:
    """How many of the text's code points are among chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1)).cast("double")


def repeated_words(w: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of `size` words found twice or more among the words w."""
    windows = F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(*(F.get(w, i - 1 + k) for k in range(size))))

    def covered(h: Column) -> Column:
        placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at")))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["at"]))

        def total(p: Column) -> Column:
            reach = F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size))))
            return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(F.sort_array(placed), lambda s: let(starts(s), total))

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(w) > size, counted).otherwise(F.lit(0).cast("long"))


def features(docs: DataFrame, text: str = "text") -> Column:
    """A struct of a document's figures; a null text counts as empty."""
    t = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))

    def figures(w: Column, ls: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.translate(t, SPACE_CHARS, "")).cast("long").alias("word_chars"),
            _chars(t, "#*$%&|<>").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(ls).cast("long").alias("n_lines"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _chars(t, _UPPER).alias("n_upper"),
            _chars(t, "!").alias("n_exclaim"),
            F.size(F.filter(w, lambda x: x.rlike(_PLAIN))).cast("long").alias("n_plain"),
        )

    return let(words(t), lambda w: let(lines, lambda ls: figures(w, ls)))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, 0).when(good, 2).otherwise(1)


#: Each rule makes a vote from the figures: 0 bad, 1 abstains, 2 good.
RULES: dict[str, Callable[[Column], Column]] = {
    "symbols": lambda f: _vote(_share(f["n_symbols"], f["word_chars"]) < 0.005, _share(f["n_symbols"], f["word_chars"]) > 0.04),
    "exclaim": lambda f: _vote(F.lit(False), _share(f["n_exclaim"], f["n_words"]) > 0.2),
    "capitals": lambda f: _vote(F.lit(False), _share(f["n_upper"], f["word_chars"]) > 0.4),
    "repeats": lambda f: _vote(f["n_repeat_words"] == 0, _share(f["n_repeat_words"], f["n_words"]) > 0.3),
    "lines": lambda f: _vote(F.lit(False), (f["n_lines"] >= 4) & (_share(f["n_dup_lines"], f["n_lines"]) > 0.3)),
    "variety": lambda f: _vote(F.lit(False), (f["n_words"] >= 50) & (f["n_words"] <= 5000) & (_share(f["n_distinct"], f["n_words"]) < 0.1)),
    "length": lambda f: _vote(f["n_words"] >= 30, f["n_words"] < 10),
    "plain": lambda f: _vote(_share(f["n_plain"], f["n_words"]) > 0.9, _share(f["n_plain"], f["n_words"]) < 0.6),
}


def pattern(f: Column) -> Column:
    """The votes as one number, three values to a rule."""
    out = F.lit(0)
    for rule in RULES.values():
        out = out * 3 + rule(f)
    return out.cast("int")


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Rows (pattern, posterior) from columns pattern and base_failed; there are at most 3^rules patterns.

    The model has a probability for each rule, class and vote, with the weak
    PRIOR. Documents that fail the base rules count as bad throughout.
    """
    m = len(RULES)
    counts = patterns.groupBy("pattern").agg(*(F.sum(F.when(F.col("base_failed") == x, 1.0).otherwise(0.0)).alias(c) for c, x in (("n", False), ("failed", True))))
    votes = F.array(*((F.floor(F.col("pattern") / 3 ** (m - 1 - j)) % 3 + 3 * j).cast("int").alias(f"v{j}") for j in range(m)))
    table = counts.select(F.struct("pattern", "n", "failed", votes.alias("votes")).alias("p")).agg(F.sort_array(F.collect_list("p")).alias("ps"))

    def posterior(p: Column, prior: Column, ratio: Column) -> Column:
        z = F.aggregate(p["votes"], prior, lambda a, v: a + F.get(ratio, v))
        return 1 / (1 + F.exp(-z))

    def both(good: Column, bad: Column) -> Column:
        return F.struct(good.cast("double").alias("good"), bad.cast("double").alias("bad"))

    def summed(ws: Column, start: Column) -> Column:
        return F.aggregate(ws, start, lambda a, x: both(a["good"] + x["n"] * x["q"], a["bad"] + x["n"] * (1 - x["q"]) + x["failed"]))

    pseudo = F.array(*(both(F.lit(PRIOR[0][v]), F.lit(PRIOR[1][v])) for v in range(3)))

    def learn(state: Column, ps: Column) -> Column:
        weighed = F.transform(ps, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), p["failed"].alias("failed"), posterior(p, state["prior"], state["ratio"]).alias("q")))

        def step(ws: Column) -> Column:
            def ratio(s: Column) -> Column:
                each = lambda i: summed(F.filter(ws, lambda x: F.array_contains(x["votes"], i)), F.get(pseudo, i % 3))
                return F.struct(
                    F.log((s["good"] + 1) / (s["bad"] + 1)).alias("prior"),
                    F.transform(
                        F.sequence(F.lit(0), F.lit(3 * m - 1)),
                        lambda i: let(each(i), lambda e: F.log((e["good"] / (s["good"] + sum(PRIOR[0]))) / (e["bad"] / (s["bad"] + sum(PRIOR[1]))))),
                    ).alias("ratio"),
                )

            return let(summed(ws, both(F.lit(0.0), F.lit(0.0))), ratio)

        return let(weighed, step)

    start = F.struct(F.lit(0.0).alias("prior"), F.array(*(F.lit(x) for _ in range(m) for x in START)).alias("ratio"))
    model = table.select("ps", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: learn(s, F.col("ps"))).alias("model"))
    one = model.select(F.explode("ps").alias("p"), "model")
    return one.select(F.col("p.pattern").alias("pattern"), posterior(F.col("p"), F.col("model.prior"), F.col("model.ratio")).alias("posterior"))


def _judged(docs: DataFrame, id: str, text: str, threshold: float) -> DataFrame:
    """A narrow row for each of docs: _id, _hash (of the text), the figures, base_failed, kept and posterior."""
    f = F.col("_f")
    rows = cut(
        docs.select(docs[id].alias("_id"), F.xxhash64(docs[text]).alias("_hash"), features(docs, text).alias("_f")).select(
            "_id", "_hash", *(f[c].alias(c) for c in BASE), base_failed(f).alias("base_failed"), pattern(f).alias("pattern")
        )
    )
    known = fit(rows)
    kept = ~F.col("base_failed") & (F.col("posterior") >= threshold)
    return rows.join(F.broadcast(known), "pattern").withColumn("kept", kept)  # at most 3^rules rows


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: id, the base figures, base_failed, kept and posterior.

    Null and empty texts have no words and fail the base rules. Repeated rows
    are judged one by one and count as often in the estimate. A posterior at the
    threshold is kept. Texts of any length are read whole, in time that grows
    with their length (that of sorting their words). An empty table gives no
    rows.
    """
    return _judged(docs, id, text, threshold).select(F.col("_id").alias(id), *BASE, "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass the base rules and are good with at least the threshold's probability.

    The figures are found once; rows are told by id and a hash of the text, so
    that rows which share an id are judged each by its own text. Null ids take
    part. All columns are kept, whatever their names.
    """
    good = _judged(docs, id, text, threshold).where("kept").select("_id", "_hash").distinct()
    return docs.join(good, docs[id].eqNullSafe(good["_id"]) & (F.xxhash64(docs[text]) == good["_hash"]), "left_semi")
