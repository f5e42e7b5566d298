"""Quality rules as weak supervision.

DataFrame and SQL functions only. Each rule votes for or against a document or
abstains. Expectation-maximisation over all documents estimates how each rule
votes on good documents and on those with each kind of defect, and the
posterior probability of quality replaces an all-rules-must-pass filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import UPPER, WS_CHARS, WS_CLASS, materialize

#: Characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"

#: A rule: name, measure, votes against at or above, votes for at or below (between them it abstains).
#: The measures are columns of :func:`measures`; a null measure abstains.
RULES = [
    ("symbols", "symbol_share", 0.05, 0.01),
    ("repeats", "repeat_share", 0.35, 0.10),
    ("exclaims", "exclaim_share", 0.20, 0.05),
    ("capitals", "capital_share", 0.40, 0.15),
    ("same_lines", "dup_line_share", 0.40, 0.05),
    ("long_words", "word_length", 18.0, 12.0),
    ("few_words", "one_word_share", 0.30, 0.15),
]


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact counts over the whole text of each document (a null text has no word).

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what the
    rules measure besides: n_exclaims, n_capitals, n_lines, n_one_char. Words of
    repeated three-word windows are found by sorting the windows' 64-bit hashes
    within the document.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(F.col(id_col).alias("id_"), text.alias("text_"), F.btrim(text, F.lit(WS_CHARS)).alias("trim_"))
    step = step.select("*", F.when(F.col("trim_") == "", F.array().cast("array<string>")).otherwise(F.split("trim_", f"[{WS_CLASS}]+", -1)).alias("w_"))
    step = step.select("*", F.size("w_").alias("n_"))
    step = step.select(
        "*",
        F.when(F.col("n_") < 3, F.array().cast("array<bigint>"))
        .otherwise(F.slice(F.transform("w_", lambda x, i: F.xxhash64(x, F.get("w_", i + 1), F.get("w_", i + 2))), F.lit(1), F.greatest(F.col("n_") - 2, F.lit(0))))
        .alias("h_"),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.select(
        "*",
        F.when(F.size(F.array_distinct("h_")) == F.size("h_"), none).otherwise(F.sort_array(F.transform("h_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s_"),
    )
    same = lambda s, k: F.coalesce(F.get("s_", k)["h"] == s["h"], F.lit(False))
    step = step.select("*", F.array_sort(F.transform(F.filter("s_", lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"])).alias("at_"))
    covered = F.aggregate(
        "at_",
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    worded = F.filter(F.split("text_", "\n", -1), lambda line: F.btrim(line, F.lit(WS_CHARS)) != "")
    without = lambda chars: F.length("text_") - F.length(F.translate("text_", chars, ""))
    return step.select(
        F.col("id_").alias(id_col),
        F.col("n_").cast("long").alias("n_words"),
        F.length(F.translate("trim_", WS_CHARS, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        F.size(worded).cast("long").alias("n_lines"),
        F.size(F.array_distinct(worded)).cast("long").alias("n_line_kinds"),
        covered.cast("long").alias("n_repeat_words"),
        without("!").cast("long").alias("n_exclaims"),
        without(UPPER).cast("long").alias("n_capitals"),
        F.size(F.filter("w_", lambda x: F.length(x) == 1)).cast("long").alias("n_one_char"),
    ).withColumn("n_dup_lines", F.col("n_lines") - F.col("n_line_kinds"))


def measures() -> dict[str, Column]:
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    chars = F.when(F.col("word_chars") > 0, F.col("word_chars"))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "repeat_share": F.col("n_repeat_words") / words,
        "exclaim_share": F.col("n_exclaims") / words,
        "capital_share": F.col("n_capitals") / chars,
        "dup_line_share": F.when(F.col("n_lines") >= 8, F.col("n_dup_lines") / F.col("n_lines")),
        "word_length": F.col("word_chars") / words,
        "one_word_share": F.col("n_one_char") / words,
    }


def votes(rules=None) -> list[Column]:
    """-1 (against), 1 (for) or 0 (abstains) of each rule."""
    of = measures()
    return [F.when(of[m] >= against, -1).when(of[m] <= good, 1).otherwise(0).alias(f"v_{name}") for name, m, against, good in (rules or RULES)]


#: What is known of the rules beforehand: the share of good documents, and how often a rule votes against a good document,
#: against a document with the defect that it looks for, and against one with another defect.
GOOD_SHARE, AGAINST_GOOD, AGAINST_OWN, AGAINST_OTHER = 0.8, 0.02, 0.9, 0.03
#: How much this counts, as shares of all documents for the votes and for the classes' sizes, and for the votes in documents
#: at least: many documents overrule it, few do not.
VOTE_WEIGHT, SHARE_WEIGHT, LEAST_WEIGHT = 0.02, 0.5, 200


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500) -> list[tuple[float, list[float]]]:
    """Estimate the classes of documents: their shares, and how often each rule votes against a document of the class.

    ``patterns`` are distinct vote vectors with counts: at most 3 to the power
    of the number of rules, whatever the number of documents. The first class
    are the good documents; each rule has another one for the defect that it
    looks for, as rules see different defects and so disagree on bad documents.
    Starts from the prior. A rule whose votes against go with no others' gains
    nothing by a class of its own: the estimate for good documents rises, and
    such a vote alone no longer rejects. Abstaining adds nothing.
    """
    if not patterns:
        return []
    rules = len(patterns[0][0])
    total = sum(n for _, n in patterns)
    prior = [(GOOD_SHARE, [AGAINST_GOOD] * rules)]
    prior += [((1 - GOOD_SHARE) / rules, [AGAINST_OWN if i == j else AGAINST_OTHER for i in range(rules)]) for j in range(rules)]
    classes, last = prior, None
    weight, share_weight = max(LEAST_WEIGHT, VOTE_WEIGHT * total), SHARE_WEIGHT * total
    for _ in range(rounds):
        member = []
        for p, _ in patterns:
            logs = [math.log(share) + sum(math.log(x if v == -1 else 1 - x) for x, v in zip(against, p) if v) for share, against in classes]
            odds = [math.exp(x - max(logs)) for x in logs]
            member.append([x / sum(odds) for x in odds])
        good = [m[0] for m in member]
        if last is not None and max(abs(a - b) for a, b in zip(good, last)) < 1e-9:
            break
        last, new = good, []
        for c, (share, against) in enumerate(prior):
            held = [m[c] * n for m, (_, n) in zip(member, patterns)]
            known = weight if c == 0 else weight * (1 - GOOD_SHARE) * 5 / rules
            rates = []
            for j, x in enumerate(against):
                votes_against = sum(h for h, (p, _) in zip(held, patterns) if p[j] == -1)
                votes_for = sum(h for h, (p, _) in zip(held, patterns) if p[j] == 1)
                rates.append((votes_against + known * x) / (votes_against + votes_for + known))
            new.append(((sum(held) + share_weight * share) / (total + share_weight), rates))
        classes = new
    return classes


def posterior(classes: list[tuple[float, list[float]]], rules=None) -> Column:
    """P(good | votes) as an expression over the vote columns."""
    if not classes:
        return F.lit(0.5)
    (share, good), *bad = classes
    total = F.lit(1.0)
    for other, against in bad:
        odds = F.lit(math.log(other / share))
        for (name, *_), x, y in zip(rules or RULES, against, good):
            vote = F.col(f"v_{name}")
            odds = odds + F.when(vote == -1, F.lit(math.log(x / y))).when(vote == 1, F.lit(math.log((1 - x) / (1 - y)))).otherwise(F.lit(0.0))
        total = total + F.exp(odds)
    return F.lit(1.0) / total


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, rules=None) -> DataFrame:
    """Score all documents: base counts, ``base_failed``, ``quality`` (posterior), ``kept``.

    ``base_failed``: under 50 words, or more than half of the words in repeated
    three-word windows; such documents are not kept whatever their posterior.
    Null and empty texts have no word, so they fail. Each row is judged by
    itself: repeated rows and null ids get a verdict like any other. An empty
    table gives an empty result. The vote patterns' counts are the only thing
    that reaches the driver.
    """
    scored = base_features(docs, id_col, text_col)
    scored = materialize(scored.select("*", *votes(rules)), "quality")
    names = [f"v_{name}" for name, *_ in (rules or RULES)]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counted = scored.groupBy(*names).count().collect()
    classes = expectation_maximisation(sorted((tuple(r[:-1]), r[-1]) for r in counted))
    return scored.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), posterior(classes, rules).alias("quality")
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
