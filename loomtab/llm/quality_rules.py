"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure of a text is a column expression, so the rules run inside one
scan, without a shuffle and without user functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, unused

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words, in lower case.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with be by at from or this an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
    "pt": "de que e o do da em um para com não uma os".split(),
    "it": "di che e il la per un non è in si del".split(),
    "nl": "de het een van en dat op te zijn met voor niet".split(),
    "pl": "w i na z do się nie jest że to".split(),
    "sv": "och i att det som en på är av för".split(),
    "tr": "ve bir bu da de için ile çok olarak".split(),
    "ru": "и в не на что я с он как это по".split(),
    "el": "και το του της να η ο των με για".split(),
}


#: What may stand around a stop word.
AROUND = ".,;:!?\"'()[]{}<>-"
#: Letters of scripts without stop words here; a text of them has no need of any.
OTHER_LETTERS = r"[^\P{L}\p{IsLatin}\p{IsCyrillic}\p{IsGreek}]"
LETTERS = r"\p{L}"
#: How a line of a list begins, and how one that is cut short ends.
BULLET = r"^[\x20\x09-\x0D]*[-*•·▪◦]"
ELLIPSIS = r"(\.\.\.|…)[\x20\x09-\x0D]*$"


@dataclass(frozen=True)
class Rule:
    """A ratio of two measures must lie between least and most; texts of no denominator fail."""

    name: str
    part: str
    whole: str
    least: float = float("-inf")
    most: float = float("inf")


#: The threshold table.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", most=0.1),
    Rule("shouted_words", "n_shouted", "n_words", most=0.3),
    Rule("stop_word_share", "n_stop_words", "n_words", least=0.02),
    Rule("letter_share", "n_letters", "word_chars", least=0.5),
    Rule("words_per_line", "n_words", "n_lines", least=2.0),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", most=0.9),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", most=0.3),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", most=0.5),
)

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of three words that occur twice or more.

    Hashes of the windows tell exactly which texts have none: equal windows
    have equal hashes. Only in the others are the windows themselves sorted and
    compared with their neighbours.
    """

    def same(a: Column, b: Column) -> Column:
        return reduce(lambda x, y: x & y, (a[c] == b[c] for c in "habc"))

    def count(w: Column) -> Column:
        inner = F.slice(w, 1, F.size(w) - 2)
        hashes = F.transform(inner, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        windows = F.transform(
            inner,
            lambda x, i: F.struct(
                F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), x.alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")
            ),
        )
        found = let(
            F.sort_array(windows),
            lambda s: F.filter(
                F.transform(s, lambda x, k: F.when(F.coalesce(same(x, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, k + 1)), F.lit(False)), x["i"])),
                lambda i: i.isNotNull(),
            ),
        )
        covered = F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))
        return F.when(let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h)), covered).otherwise(0)

    return F.when(F.size(words) >= 4, count(words)).otherwise(0).cast("long")


#: What measures() finds, as long integers.
MEASURES = "n_words word_chars n_symbols n_lines n_dup_lines n_bullet_lines n_ellipsis_lines n_repeat_words n_stop_words n_shouted n_letters".split()


def measures(text: Column, stop_words: Sequence[str] | None = None) -> tuple[Column, Callable[[Column], Column]]:
    """The words of a text, and what makes the struct of its MEASURES from them."""
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws} if stop_words is None else set(stop_words))
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))

    def count(rows: Column, holds: Callable[[Column], Column]) -> Column:
        return F.size(F.filter(rows, holds))

    def of(words: Column) -> Column:
        by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"), count(x, lambda y: y.rlike(BULLET)).alias("bullet"), count(x, lambda y: y.rlike(ELLIPSIS)).alias("cut")))
        found = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.regexp_count(whole, F.lit(SYMBOLS)),
            "by_line": by_line,
            "n_repeat_words": repeated_words(words),
            "n_stop_words": count(words, lambda w: F.btrim(F.lower(w), F.lit(AROUND)).isin(stops)) + F.regexp_count(whole, F.lit(OTHER_LETTERS)),
            "n_shouted": count(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 3)),
            "n_letters": F.regexp_count(whole, F.lit(LETTERS)),
        }
        return F.struct(*(c.alias(n) for n, c in found.items()))

    return F.filter(F.split(whole, f"[{BLANKS}]+"), lambda w: w != ""), of


def measured(docs: DataFrame, names: dict[str, str], text: str = "text", stop_words: Sequence[str] | None = None) -> DataFrame:
    """docs with the measures of its texts as last columns, each under the name that names gives it."""
    words, of = measures(F.col(f"`{text}`"), stop_words)
    own = unused(docs.columns, "words")
    raw = unused([*docs.columns, own], "found")
    by_line = {"n_lines": "n", "n_dup_lines": "dup", "n_bullet_lines": "bullet", "n_ellipsis_lines": "cut"}
    found = docs.withColumn(own, words).withColumn(raw, of(F.col(own)))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {n.lower() for n in names.values()}]
    return found.select(*kept, *((F.col(raw)["by_line"][by_line[m]] if m in by_line else F.col(raw)[m]).cast("long").alias(names[m]) for m in MEASURES))


def base_failed(names: dict[str, str]) -> Column:
    words, repeated = F.col(names["n_words"]), F.col(names["n_repeat_words"])
    return (words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * words)


def failures(names: dict[str, str], rules: Sequence[Rule] = RULES) -> Column:
    """Names of the rules that a text fails, in the table's order."""

    def holds(r: Rule) -> Column:
        part, whole = F.col(names[r.part]).cast("double"), F.col(names[r.whole]).cast("double")
        tests = [whole > 0]
        tests += [part >= r.least * whole] if r.least != float("-inf") else []
        tests += [part <= r.most * whole] if r.most != float("inf") else []
        return reduce(lambda a, b: a & b, tests)

    return F.filter(F.array(*(F.when(~holds(r), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] | None = None) -> DataFrame:
    """docs with its MEASURES, base_failed, failed_rules and kept as last columns.

    stop_words, in lower case, take the place of those of STOP_WORDS.
    A null text counts as one without words, which fails the base. Rows are
    judged one by one, so equal rows get equal verdicts; a null doc_id and other
    columns stay as they are, those of the results' names are replaced; an empty
    table gives an empty one; texts of any length are measured whole.
    """
    names = {m: m for m in MEASURES}
    return verdicts(docs, names, rules, ["base_failed", "failed_rules", "kept"], stop_words)


def verdicts(docs: DataFrame, names: dict[str, str], rules: Sequence[Rule], results: list[str], stop_words: Sequence[str] | None = None) -> DataFrame:
    base, failed, kept = results
    found = measured(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in results)), names, stop_words=stop_words)
    return found.withColumns({base: base_failed(names), failed: failures(names, rules)}).withColumn(kept, ~F.col(base) & (F.size(failed) == 0))


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, that no rule rejects; stop_words as for judge."""
    taken = list(docs.columns)
    names = {}
    for m in [*MEASURES, "base", "failed", "kept", "row"]:
        names[m] = unused(taken, m)
        taken.append(names[m])
    # Pushed below the projection, the filter would compute the measures again in its own lambdas; a row number holds it back.
    judged = verdicts(docs, names, rules, [names["base"], names["failed"], names["kept"]], stop_words).withColumn(names["row"], F.monotonically_increasing_id())
    return judged.filter(F.col(names["kept"]) & (F.col(names["row"]) >= 0)).select(*(F.col(f"`{c}`") for c in docs.columns))
