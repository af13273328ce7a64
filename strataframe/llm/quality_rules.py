"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import SPACE

# Frequent function words of English, German, French and Spanish.
_LOWER_STOP_WORDS = (
    "the of and to in a is that for it was with as on be by are this from or "
    "der die das und in den von zu mit ist im nicht ein eine als des sich dem auf "
    "le la les de des et en un une du dans que est pour qui sur au par pas "
    "el los las y por con para su al se del lo no una"
).split()
#: Each word as it stands and capitalised.
STOP_WORDS = sorted({w for x in _LOWER_STOP_WORDS for w in (x, x.capitalize())})
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """A measure's name and the values between which it passes; None: no limit on that side."""

    measure: str
    low: float | None
    high: float | None


RULES = (
    Rule("n_words", 50, 100_000_000),
    Rule("mean_word_chars", 2, 15),
    Rule("symbol_ratio", None, 0.25),
    Rule("upper_ratio", None, 0.4),
    Rule("exclaim_ratio", None, 0.25),
    Rule("stop_ratio", 0.01, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_ratio", None, 0.5),
)


def measures(text: Column) -> list[dict[str, Column]]:
    """Layers of named columns; each layer may use the names of those before it.

    Few texts repeat a window of three words, so hashes of the windows are compared first: equal
    windows have equal hashes. Only texts with an equal pair sort the windows themselves.
    """
    only = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    at = lambda a, i: F.get(F.col(a), i)
    windows = F.transform(F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, at("hashes", i + 1), at("hashes", i + 2)))
    trigrams = F.transform(F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")), lambda i: F.struct(F.concat_ws(" ", at("words", i), at("words", i + 1), at("words", i + 2)).alias("g"), i.alias("i")))
    starts = F.filter(
        F.transform("ordered", lambda x, k: F.when((x.g == at("ordered", k - 1).g) | (x.g == at("ordered", k + 1).g), x.i)),
        lambda i: i.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda i: F.array(i, i + 1, i + 2)))))
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return [
        {"words": F.array_remove(F.split(text, SPACE, -1), ""), "lines": lines, "n_symbols": only(SYMBOLS), "n_upper": only(r"\p{Lu}"), "n_exclaim": only("!")},
        {
            "n_words": F.size("words").cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_stop": F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).cast("long"),
            "hashes": F.transform("words", lambda w: F.xxhash64(w)),
        },
        {"windows": windows},
        {"ordered": F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(trigrams))},
        {"starts": starts},
        {"n_repeat_words": F.coalesce(F.when(F.col("starts").isNotNull(), covered), F.lit(0)).cast("long")},
        {
            "mean_word_chars": share("word_chars", "n_words"),
            "symbol_ratio": share("n_symbols", "n_words"),
            "upper_ratio": share("n_upper", "word_chars"),
            "exclaim_ratio": share("n_exclaim", "n_words"),
            "stop_ratio": share("n_stop", "n_words"),
            "dup_line_ratio": share("n_dup_lines", "n_lines"),
            "repeat_ratio": share("n_repeat_words", "n_words"),
        },
    ]


def passes(rule: Rule) -> Column:
    limits = [F.col(rule.measure) >= rule.low] * (rule.low is not None) + [F.col(rule.measure) <= rule.high] * (rule.high is not None)
    out = F.lit(True)
    for limit in limits:
        out = out & limit
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: its id, counts, ratios, base_failed, the names of failed rules and kept.

    Null and empty texts have no words, so they fail the length rules. Rows are independent:
    repeated rows and ids give repeated results, and an empty table an empty result. No rule
    needs another row, a shuffle or a user function; the thresholds are a table, so a corpus
    can have its own.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for layer in measures(F.col("text")):
        out = out.withColumns(layer)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~passes(r), F.lit(r.measure)) for r in rules]), lambda x: x.isNotNull())
    out = out.withColumns({"base_failed": base, "failed_rules": failed})
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*names, (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules"), "stop_ratio", "upper_ratio")
