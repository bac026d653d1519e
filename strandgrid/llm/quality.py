"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every rule is a row (name, measure, least, most); ``compile_rules`` turns the
table into a boolean column. No Python runs on the executors.

Defined cases: a null or empty text has no words, fails the base rule and is
rejected; ratios over no words or lines are 0; repeated rows are judged one by
one; an empty table gives an empty result; other columns, whatever their names,
are carried along by ``apply_rules`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, text_or_empty, words_of

# Frequent function words of the four languages.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with be at by this from or an",
    "de": "der die und das den von zu im mit ist des ein auf nicht eine als er sich es dem",
    "fr": "de la le et les des en un du une que est pour qui dans par au sur pas plus",
    "es": "de la que el en y los se del las un por con una su para es al lo como",
}


@dataclass(frozen=True)
class Rule:
    """A measure must lie between least and most, both allowed."""

    name: str
    measure: str
    least: float = float("-inf")
    most: float = float("inf")


#: The production table. The base of the contract comes first.
RULES = (
    Rule("enough_words", "n_words", least=50),
    Rule("few_repeated_words", "repeat_ratio", most=0.5),
    Rule("word_length", "mean_word_length", least=2.5, most=12.0),
    Rule("few_symbols", "symbol_ratio", most=0.1),
    Rule("few_duplicate_lines", "dup_line_ratio", most=0.5),
    Rule("few_bullets", "bullet_ratio", most=0.9),
    Rule("few_ellipses", "ellipsis_ratio", most=0.3),
    Rule("stop_words", "stop_ratio", least=0.01),
)
BASE = ("enough_words", "few_repeated_words")

_P = "__q_"


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Add a struct column ``__q`` of all measures of the whole text. Arrays are steps of their own, so that each is built once."""
    t = text_or_empty(text)
    col = lambda n: F.col(_P + n)
    blank = lambda x: F.btrim(x, F.lit(WS_CHARS)) == ""
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    df = df.withColumns({
        _P + "words": words_of(t),
        _P + "lines": F.filter(F.split(t, "\n"), lambda x: ~blank(x)),
    })
    df = df.withColumns({
        _P + "n": F.size(col("words")),
        _P + "hashes": F.transform(col("words"), lambda w: F.xxhash64(w)),
        _P + "stop": F.size(F.filter(col("words"), lambda w: F.lower(F.btrim(w, F.lit(".,;:!?"))).isin(stops))),
        _P + "n_lines": F.size(col("lines")),
        _P + "n_dup": F.size(col("lines")) - F.size(F.array_distinct(col("lines"))),
        _P + "bullets": F.size(F.filter(col("lines"), lambda x: F.btrim(x, F.lit(WS_CHARS)).rlike("^[-*•]"))),
        _P + "ellipses": F.size(F.filter(col("lines"), lambda x: F.btrim(x, F.lit(WS_CHARS)).rlike("(\\.\\.\\.|…)$"))),
        _P + "chars": F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")),
        _P + "symbols": F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", "")),
    })
    # a window of three words, by the hashes of its words
    df = df.withColumn(_P + "tri", F.when(col("n") >= 3, F.slice(F.transform(col("hashes"), lambda h, i: F.xxhash64(h, F.get(col("hashes"), i + 1), F.get(col("hashes"), i + 2))), F.lit(1), F.greatest(col("n") - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    # windows in order of hash and place: equal ones are neighbours. Only where there are equal ones.
    df = df.withColumn(_P + "sorted", F.when(F.size(F.array_distinct(col("tri"))) < F.size(col("tri")), F.sort_array(F.transform(col("tri"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.get(col("sorted"), j)["h"] == x["h"]
    df = df.withColumn(_P + "places", F.sort_array(F.transform(F.filter(col("sorted"), lambda x, j: F.coalesce(F.when(j > 0, same(x, j - 1)), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform(col("places"), lambda p, j: F.least(F.lit(3), F.coalesce(F.get(col("places"), j + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    df = df.withColumn(_P + "repeat", F.coalesce(covered, F.lit(0)))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n, lines = col("n"), col("n_lines")
    # always true, but not deterministic: a filter above must not be pushed below, where all steps would be repeated in it
    once = F.monotonically_increasing_id() >= 0
    return df.withColumn("__q", F.when(once, F.struct(
        n.cast("long").alias("n_words"), col("chars").cast("long").alias("word_chars"), col("symbols").cast("long").alias("n_symbols"),
        col("n_dup").cast("long").alias("n_dup_lines"), col("repeat").cast("long").alias("n_repeat_words"),
        share(col("repeat"), n).alias("repeat_ratio"), share(col("chars"), n).alias("mean_word_length"), share(col("symbols"), n).alias("symbol_ratio"),
        share(col("stop"), n).alias("stop_ratio"), share(col("n_dup"), lines).alias("dup_line_ratio"), share(col("bullets"), lines).alias("bullet_ratio"), share(col("ellipses"), lines).alias("ellipsis_ratio"),
    ))).drop(*[c for c in df.columns if c.startswith(_P)])


def compile_rules(rules=RULES, at: str = "__q") -> Column:
    """The names of the rules that a row breaks, as an array."""
    broken = []
    for r in rules:
        x = F.col(at)[r.measure]
        bad = F.lit(False)
        if r.least != float("-inf"):
            bad = bad | (x < F.lit(r.least))
        if r.most != float("inf"):
            bad = bad | (x > F.lit(r.most))
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def judge(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Add the struct ``__q`` of measures and the array ``__broken`` of broken rules."""
    return measures(df, text).withColumn("__broken", compile_rules(rules))


def apply_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows that break no rule, with their own columns."""
    names = [text if c == text else f"__c{i}" for i, c in enumerate(df.columns)]
    return judge(df.toDF(*names), text, rules).where(F.size("__broken") == 0).select(*names).toDF(*df.columns)


def op4(docs: DataFrame) -> DataFrame:
    q = F.col("__q")
    base = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    out = judge(docs.select("doc_id", "text"))
    return out.select("doc_id", *[q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], base.alias("base_failed"), (~base & (F.size("__broken") == 0)).alias("kept"))
