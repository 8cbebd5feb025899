"""Quality rules as a short-circuit cascade, in SQL functions alone.

The rules' verdict is their conjunction, so their order only decides the cost.  On a sample each rule's rejections
and cost are estimated, and the next rule is always the one that rejects most of what is left for its cost.  A rule
reads the text itself, so the costly ones (three-word windows, lines) are never worked out for a document that a
cheaper one has rejected.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, WORD, let, tidy

SAMPLE_ROWS = 1000
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _less(text: Column, characters: str) -> Column:
    """``text`` without these characters."""
    return F.translate(text, characters, "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, the first included."""

    def covered(starts: Column) -> Column:
        # each window covers three words, less what the one before covers already
        end = lambda acc, s: F.struct((acc["n"] + F.least(F.lit(3), s + 3 - acc["to"])).alias("n"), (s + 3).alias("to"))
        return F.aggregate(F.sort_array(starts), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("to")), end, lambda acc: acc["n"])

    def twins(marks: Column) -> Column:
        # marks are sorted by hash, so equal windows are neighbours
        at = lambda i: F.get(marks, i)["h"]
        return F.filter(F.transform(marks, lambda m, i: F.when(m["h"].eqNullSafe(at(i - 1)) | m["h"].eqNullSafe(at(i + 1)), m["i"])), lambda x: x.isNotNull())

    def counted(hashes: Column) -> Column:
        marks = lambda: F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(marks(), lambda m: covered(twins(m))))

    def windows(own: Column) -> Column:
        # own: the words' hashes; the windows are those of three in a row
        three = F.transform(own, lambda a, i: F.xxhash64(a, F.get(own, i + 1), F.get(own, i + 2)))
        return let(F.slice(three, F.lit(1), F.size(own) - 2), counted)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def word_chars(text: Column) -> Column:
    return F.length(_less(text, BLANKS))


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(_less(text, SYMBOLS))


def lines(text: Column) -> Column:
    """A struct of how many lines have a word, and how many of them equal an earlier one."""
    own = F.filter(F.split(text, "\n"), lambda x: F.length(_less(x, BLANKS)) > 0)
    return let(own, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))


def n_repeat_words(text: Column) -> Column:
    return let(_words(text), _repeated)


@dataclass(frozen=True)
class Rule:
    """``fails`` is true for texts to reject; ``cost`` is the work it takes on a text, in units of one pass that copies it:
    a fixed model, from timings of each rule over 3,000 documents (7.7 million characters, best of three runs)."""

    name: str
    fails: Callable[[Column], Column]
    cost: Callable[[Column], Column]


def _chars(times: float) -> Callable[[Column], Column]:
    return lambda t: 50 + times * F.length(t)


#: Thresholds of the base, as the corpus' definition states them, and wide ones after published web-text heuristics.
FEW = Rule("few_words", lambda t: n_words(t) < 50, _chars(1))
REPEATS = Rule("repeats", lambda t: 100 * n_repeat_words(t) > 50 * n_words(t), _chars(4.9))
MORE = (
    Rule("symbols", lambda t: 10 * n_symbols(t) > 2 * n_words(t), _chars(1.7)),
    Rule("word_length", lambda t: let(n_words(t), lambda n: let(word_chars(t), lambda c: (c < 2 * n) | (c > 20 * n))), _chars(1.9)),
    Rule("duplicate_lines", lambda t: let(lines(t), lambda x: (10 * x["dup"] > 3 * x["all"]) & (x["all"] >= 4)), _chars(1.2)),
    Rule("capitals", lambda t: 10 * F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) > 6 * word_chars(t), _chars(1.2)),
    Rule("exclamations", lambda t: 10 * (F.length(t) - F.length(_less(t, "!?"))) > 5 * n_words(t), _chars(2.2)),
)
RULES = (FEW, REPEATS, *MORE)


def order_rules(documents: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 5) -> list[Rule]:
    """The rules by rejections for their cost, each on those documents of a sample that the ones before it let through.

    Only the order comes from the sample of about ``sample_rows`` rows: what is kept is the same for every order.  The
    same table gives the same order.  An empty sample leaves the rules as they are; of equal rules the earlier is first.
    """
    rules = list(rules)
    with tidy(documents.sparkSession):
        total = documents.count()
        if not total:
            return rules
        text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
        some = documents.select(text.alias("text")).sample(False, min(1.0, sample_rows / total), seed)
        judged = [F.array(F.coalesce(r.fails(F.col("text")), F.lit(False)).cast("double"), r.cost(F.col("text")).cast("double")) for r in rules]
        seen = [r["x"] for r in some.select(F.array(*judged).alias("x")).collect()]  # a few numbers a row
    out, left = [], list(range(len(rules)))
    while left:
        rejected = {k: sum(x[k][0] for x in seen) for k in left}
        cost = {k: sum(x[k][1] for x in seen) for k in left}
        best = min(left, key=lambda k: (-rejected[k] / cost[k] if cost[k] else 0.0, cost[k], k))
        out.append(rules[best])
        left.remove(best)
        seen = [x for x in seen if not x[best][0]]
    return out


def passes(rules: list[Rule], text: Column) -> Column:
    verdict = F.lit(True)
    for rule in reversed(rules):  # CASE stops at the first rule that rejects
        verdict = F.when(F.coalesce(rule.fails(text), F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=MORE) -> DataFrame:
    """One row a document: id, the base features, base_failed and kept.

    A null or empty text has no words and fails the base.  Rows are judged alone, so repeated rows come out
    alike and an empty table gives an empty result; texts of any length count whole; other columns are not read.  The
    features of the base are wanted for every row, so only ``rules`` are asked as a cascade.
    """
    ordered = order_rules(documents, rules, text_col)
    whole = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))

    def made(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _repeated(words).cast("long").alias("n_repeat_words"))

    rows = documents.select(F.col(f"`{id_col}`").alias("id"), whole.alias("text"), F.explode(F.array(let(_words(whole), made))).alias("w"))
    failed = (F.col("w.n_words") < 50) | (100 * F.col("w.n_repeat_words") > 50 * F.col("w.n_words"))
    return rows.select(
        F.col("id").alias(id_col), "w.n_words", word_chars(F.col("text")).cast("long").alias("word_chars"), n_symbols(F.col("text")).cast("long").alias("n_symbols"),
        lines(F.col("text"))["dup"].cast("long").alias("n_dup_lines"), "w.n_repeat_words", failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(passes(ordered, F.col("text"))).alias("kept"),
    )


def keep(documents: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The documents that pass every rule, with their own columns only, whatever their names.

    Null and empty texts fail; repeated rows fare alike; an empty table gives an empty result.
    """
    ordered = order_rules(documents, rules, text_col)
    return documents.where(passes(ordered, F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
