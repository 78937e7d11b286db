"""Quality rules by line-first cleaning, in DataFrame functions only.

Every line is judged by itself (end punctuation, navigation, boilerplate). Lines that fail are removed, and a
document goes if too much of its text went with them, or if one of the base rules fails. There is no shuffle: each
document is judged inside its own row, so hot sources and repeated texts cost nothing extra.

Edge cases: a null or empty text has no words, fails the base rule on length and is not kept. Repeated rows are
judged alike. Other columns of the input pass through `clean` untouched, whatever their names. `measure` adds its figures:
an input column of the same name is replaced, and names that begin with q_ are its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import word_list

#: Fixed phrases of boilerplate, in lower case.
BOILERPLATE = (
    "lorem ipsum", "javascript", "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "licensed under", "released under the", "copyright", "subscribe to", "sign up", "log in", "click here",
    "share this", "read more", "skip to content",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; shares are of a document's word characters."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    #: A line of at most so many words needs no end punctuation to count as a heading.
    heading_words: int = 12
    #: Only a line of fewer words than this is boilerplate for a phrase in it; a paragraph may speak of such things.
    boilerplate_words: int = 30
    #: So many bars or arrows in a line make it navigation.
    navigation_marks: int = 3
    #: Share of symbols among a line's word characters from which it is junk.
    max_symbol_share: float = 0.1
    #: A document goes if lines holding more than this share of its word characters are removed.
    max_lost_share: float = 0.5


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _visible(text: Column) -> Column:
    """Code points of text outside ASCII white space."""
    return F.length(_without(text, " \t\n\x0b\x0c\r"))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(_without(text, characters))


def line_facts(line: Column, rules: LineRules = LineRules()) -> Column:
    """What the line rules look at, worked out once per line."""
    bare = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    return F.struct(
        line.alias("line"),
        F.when(_count(bare, " ") < rules.boilerplate_words, F.lower(bare)).otherwise(F.lit("")).alias("lower"),
        F.right(bare, F.lit(4)).alias("end"),
        F.length(_without(bare, " ")).alias("visible"),
        _count(bare, " ").alias("spaces"),
        _count(bare, "|»›•").alias("marks"),
        _count(bare, "#*$%&|<>").alias("symbols"),
    )


def fact_passes(x: Column, rules: LineRules = LineRules()) -> Column:
    """Whether the line with these facts passes every line rule."""
    ended = x["end"].rlike(r"""[.!?…:;。！？]["'”’»)\]]*$""")
    passes = (x["marks"] < rules.navigation_marks) & (x["symbols"] <= rules.max_symbol_share * x["visible"])
    passes = passes & ((x["spaces"] < rules.heading_words) | ended)
    for phrase in BOILERPLATE:
        passes = passes & ~x["lower"].contains(phrase)
    return passes


def measure(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """docs with the base figures, base_failed, kept and clean_text (the text without the lines that failed)."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"q_words": word_list(F.col(text)), "q_lines": F.filter(F.split(body, "\n"), lambda x: _visible(x) > 0)})
    # (window, position) sorted: equal windows of three words stand side by side
    windows = F.when(
        F.size("q_words") >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size("q_words") - 3),
                lambda i: F.struct(F.xxhash64(F.get("q_words", i), F.get("q_words", i + 1), F.get("q_words", i + 2)).alias("w"), i.alias("at")),
            )
        ),
    ).otherwise(F.array().cast("array<struct<w:bigint,at:int>>"))
    out = out.withColumn("q_windows", windows)
    twice = F.filter(
        "q_windows",
        lambda x, i: (x["w"] == F.get("q_windows", i - 1)["w"]) & (i > 0) | (x["w"] == F.get("q_windows", i + 1)["w"]),
    )
    out = out.withColumn("q_at", F.sort_array(F.transform(twice, lambda x: x["at"])))
    # a window adds the words that the one before it does not hold: three at most
    covered = F.aggregate(
        "q_at",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, at: F.struct(at.alias("last"), (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    out = out.withColumns({
        "n_words": F.size("q_words").cast("long"),
        "word_chars": _visible(body).cast("long"),
        "n_symbols": _count(body, "#*$%&|<>").cast("long"),
        "n_dup_lines": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "n_repeat_words": covered,
        "q_facts": F.transform("q_lines", lambda x: line_facts(x, rules)),
    }).withColumn("q_good", F.filter("q_facts", lambda x: fact_passes(x, rules))).withColumn("clean_text", F.array_join(F.transform("q_good", lambda x: x["line"]), "\n"))
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") > rules.max_repeat_share * F.col("n_words"))
    lost = F.col("word_chars") - _visible(F.col("clean_text"))
    return out.withColumns({
        "base_failed": failed,
        "kept": ~failed & (lost <= rules.max_lost_share * F.col("word_chars")),
    }).drop("q_words", "q_lines", "q_windows", "q_at", "q_facts", "q_good")


def clean(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """The documents that stay, with the text of the lines that passed; the columns are those of docs."""
    judged = measure(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}), rules, f"in_{text}")
    # as one generated value: else the optimiser copies what kept is made of into the filter, many times over
    judged = judged.select(*(f"in_{c}" for c in docs.columns), F.explode(F.array(F.struct("kept", "clean_text"))).alias("v")).where("v.kept")
    return judged.select(*(F.col("v.clean_text" if c == text else f"in_{c}").alias(c) for c in docs.columns))
