"""Quality rules whose cutoffs are controlled for risk, in DataFrame functions only.

A rule rejects a document when a measure of it, a whole number from 0 to 1000, is above a cutoff. Cutoffs are set by stratum from labelled documents that the
fixed base rule lets pass. A third of these (by a hash of the identifier) proposes: of each rule the cutoff that gains most, where a good document lost
costs as much as COST bad ones found; rules that gain nothing are left out. The other two thirds, held out, decide: cutoffs are tried from the most lenient on, and the
last one stands whose false rejections are so few that the exact binomial bound holds the rate of false rejections below the rule's share of ALPHA; none is stricter than the proposal. As trials of a rule stop at the
first failure they need no correction among themselves; over all rules of all strata the error DELTA is divided evenly (Bonferroni). So, with probability 1 - DELTA, in every stratum
at most ALPHA of the good documents that pass the base rule are rejected. Strata with too few labels to show that for any cutoff reject nothing beyond the base rule.

Null texts count as empty and have no words: they fail the base rule. A null stratum is a stratum of its own. Labels of a document that is not there say nothing; a document with several labels is
good if one says so, null labels are none. Documents with a null identifier are measured and judged, but never labelled. Repeated rows are judged alike, one by one. Columns that are not named are not read. Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30  # the base rule: words, and percent of words in repeated windows
ALPHA, DELTA, COST = 0.05, 0.05, 20

#: Rules: what they measure, in whole numbers.
RULES = {
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "capitals": "1000 * n_upper div greatest(word_chars, 1)",
    "long_words": "20 * word_chars div greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rest(values: Column | str, n: int) -> Column:
    """The array without its first n values."""
    return F.slice(values, n + 1, F.greatest(F.size(values), F.lit(1)))


def neighbours_equal(values: str, field: str) -> Column:
    """Of a sorted array of structs those that share a field with the one before or after."""
    said = lambda at: F.get(F.col(values), at)[field]
    return F.filter(values, lambda x, i: F.coalesce(x[field] == said(i - 1), F.lit(False)) | F.coalesce(x[field] == said(i + 1), F.lit(False)))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """doc_id, stratum, the COUNTS, n_upper, n_lines and base_failed of each row. Texts are split and hashed where they are; nothing is shuffled.

    Windows of words are told apart by hashes first. Only where hashes repeat, windows are compared word by word.
    """
    stratum = F.lit(None).cast("string") if stratum_col is None else F.col(stratum_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), stratum.alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", "stratum", F.array_remove(F.split("text", SPACE), "").alias("words"), F.filter(F.split("text", "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "").alias("lines")
    )
    rows = rows.select(
        "doc_id", "stratum", "words", F.size("words").alias("n"), F.array_join("words", "").alias("joined"), F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("kinds"), F.transform("words", lambda w: F.xxhash64(w)).alias("h")
    )
    width = 1
    while width < WINDOW:
        rows = rows.withColumn("h", F.zip_with("h", rest("h", width), lambda a, b: F.xxhash64(a, b)))
        width *= 2
    rows = rows.withColumn("h", F.slice("h", 1, F.greatest(F.col("n") - WINDOW + 1, F.lit(0))))
    again = F.size(F.array_distinct("h")) < F.size("h")
    rows = rows.withColumn("same", F.when(again, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("at")))))).drop("h")
    rows = rows.withColumn("same", F.transform(neighbours_equal("same", "h"), lambda x: x["at"]))
    said = lambda at: F.concat_ws(" ", *[F.get(F.col("words"), at + k) for k in range(WINDOW)])
    rows = rows.withColumn("same", F.sort_array(F.transform("same", lambda at: F.struct(said(at).alias("said"), at.alias("at")))))
    rows = rows.withColumn("same", F.sort_array(F.transform(neighbours_equal("same", "said"), lambda x: x["at"])))
    covered = F.aggregate(F.zip_with("same", rest("same", 1), lambda a, b: F.least(F.lit(WINDOW), b - a)), F.lit(0), lambda s, x: s + x)
    without = lambda some: (F.char_length("joined") - F.char_length(F.translate("joined", some, ""))).cast("long")
    rows = rows.select(
        "doc_id", "stratum", F.col("n").cast("long").alias("n_words"), F.char_length("joined").cast("long").alias("word_chars"), without(SYMBOLS).alias("n_symbols"), without(UPPER).alias("n_upper"),
        F.col("n_lines").cast("long").alias("n_lines"), (F.col("n_lines") - F.col("kinds")).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def most_allowed(n: Column, rate: Column, error: float) -> Column:
    """The largest k such that k or fewer of n happen with probability `error` at most if each happens with probability `rate`; -1 if there is none.

    Then k false rejections among n show a rate below `rate`: this is the exact (Clopper-Pearson) bound. Terms of the binomial distribution are added up as logarithms.
    """
    none = F.lit(float("-inf"))

    def step(s: Column, i: Column) -> Column:
        high, low = F.greatest(s["term"], s["sum"]), F.least(s["term"], s["sum"])
        total = high + F.log1p(F.exp(low - high))
        after = F.coalesce(s["term"] + F.log((n - i) / (i + 1)) + F.log(rate / (1 - rate)), none)
        return F.struct(after.alias("term"), total.alias("sum"), F.when(total <= F.log(F.lit(error)), i).otherwise(s["k"]).alias("k"))

    first = F.struct((n * F.log1p(-rate)).alias("term"), none.alias("sum"), F.lit(-1).cast("long").alias("k"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * rate).cast("long")), first, step)["k"]


def cutoffs(rows: DataFrame, labels: DataFrame, scratch: Scratch, *, alpha: float = ALPHA, delta: float = DELTA, cost: int = COST) -> DataFrame:
    """stratum, rule, cutoff and what speaks for it: held_good, false_rejections, allowed. rows: measured; labels: doc_id and good.

    Documents meet labels by identifier with a few numbers each. They are counted by stratum, rule and value, of which there are at most 1001; all else is done on these counts.
    """
    good = labels.where("doc_id is not null and good is not null").groupBy("doc_id").agg(F.max("good").alias("good"))
    told = rows.where("not base_failed").join(good, "doc_id").withColumn("fit", F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    values = F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.expr(f"least(1000, {v})").alias("value")) for k, v in RULES.items()]))
    each = told.select("stratum", "good", "fit", values)
    number = lambda test: F.count(F.when(F.expr(test), 1))
    counts = each.groupBy("stratum", "rule", "value").agg(number("fit and good").alias("fit_good"), number("fit and not good").alias("fit_bad"), number("not fit and good").alias("held_good"))
    rule = Window.partitionBy("stratum", "rule")
    down = rule.orderBy(F.desc("value"))
    above = lambda c: F.coalesce(F.sum(c).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = counts.select(
        "stratum", "rule", "value", F.lag("value").over(down).alias("next"), above("fit_good").alias("good_lost"), above("fit_bad").alias("bad_found"), above("held_good").alias("false_rejections"),
        F.sum("fit_good").over(rule).alias("goods"), F.sum("fit_bad").over(rule).alias("bads"), F.sum("held_good").over(rule).alias("held_good"),
    )
    steps = steps.withColumn("gain", F.col("bad_found") * F.col("goods") - cost * F.col("good_lost") * F.col("bads"))
    steps = steps.withColumn("proposed", F.max(F.struct("gain", "value")).over(rule)).where("proposed.gain > 0 and value >= proposed.value")
    steps = scratch.write(steps, "steps")
    share = steps.groupBy("stratum").agg(F.count_distinct("rule").alias("rules"), F.max("held_good").alias("n"))
    tests = share.agg(F.coalesce(F.sum("rules"), F.lit(1))).first()[0]
    share = share.select(F.col("stratum").alias("of"), most_allowed(F.col("n"), F.lit(alpha) / F.col("rules"), delta / tests).alias("allowed"))
    passed = steps.join(share, F.col("stratum").eqNullSafe(F.col("of"))).where("false_rejections <= allowed")
    last = passed.groupBy("stratum", "rule").agg(F.min_by(F.struct("value", "next", "held_good", "false_rejections", "allowed"), "value").alias("last"))
    cutoff = F.coalesce(F.expr("(last.value + last.next - 1) div 2"), F.col("last.value"))  # half-way to the next value seen: the same documents are rejected
    return last.select("stratum", "rule", cutoff.alias("cutoff"), "last.held_good", "last.false_rejections", "last.allowed")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", good: Column | None = None, **risk) -> DataFrame:
    """doc_id, the COUNTS, base_failed, kept and rejected_by (the rules that reject) of each document. `good` tells good rows of labels; quality = 1 if not given."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(measured(docs, id_col, text_col, stratum_col), "measured")
    told = labels.select(F.col(id_col).alias("doc_id"), (F.col("quality") == 1 if good is None else good).alias("good"))
    found = cutoffs(rows, told, scratch, **risk)
    wide = scratch.write(found.groupBy(F.col("stratum").alias("of")).agg(*[F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(f"cutoff_{k}") for k in RULES]), "cutoffs")
    judged = rows.join(wide, F.col("stratum").eqNullSafe(F.col("of")), "left")  # a row a stratum: the optimiser broadcasts it if its size, known from the files, allows
    rejected = F.filter(F.array(*[F.when(F.expr(f"least(1000, {v}) > cutoff_{k}"), F.lit(k)) for k, v in RULES.items()]), lambda x: x.isNotNull())
    judged = judged.withColumn("rejected_by", rejected)
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), "rejected_by")
