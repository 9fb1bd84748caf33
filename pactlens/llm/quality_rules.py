"""Quality rules: word and line counts, and how far a text's make-up is from its language.

Two histograms of a text are compared with those of its language by the Jensen-Shannon distance (square root of the
divergence in bits, 0 to 1): characters by class, and words by common word of the language, all others as one more bin.
The language references are sums over every document of the language. They are formed from per-document counts that are
written once, so the text is read in one pass; a reference row exists for each listed language and one for all others,
which bounds the table that is broadcast.

Everything is DataFrame functions on one row, so no text is shuffled and no row meets another but for the sums per
language, which combine before their shuffle. Repeated windows of three words come from one sort of packed hashes per
text, followed by an exact comparison of the windows that collided: time grows as n log n also for very long texts.

Defined results: a null text has no words and no lines; null and unlisted languages share one reference. A text of
fewer words than `min_words` is rejected by the base rules and its distances play no part; the distances' own limits
widen for short texts. Repeated rows stay repeated. A very long text is one row of arrays, up to 2**28 words. An empty table
gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.common import WORD_BREAK
from pactlens.session import materialize

#: Common words of four languages.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and in to is that for it was on are with as by be at this have from".split(),
    "es": "de la que el en y a los se del las un por con una su para es al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas plus avec".split(),
}
SYMBOLS = "[#*$%&|<>]"
#: What is left of a text without a-z and white space is short, and is what the classes are counted in.
PLAIN = r"[a-z\x20\x09-\x0D]+"
#: Two more bins hold white space and a-z, a last one all other characters.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "point": r"[.,;:!?'\"()\-]", "symbol": SYMBOLS}
OTHERS = "*"
POSITION_BITS = 28  # of a packed window; texts of up to 2**28 words
FEW = 16  # repeated windows that are looked up one by one; more are found by a sort


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A distance may reach `base + slope / sqrt(words)`: a short text strays further from its language by chance.
    class_base: float = 0.14
    class_slope: float = 1.25
    word_base: float = 0.20
    word_slope: float = 1.20


def _neighbours(values: Column, same) -> Column:
    """Items of a sorted array that equal the one before or after, by `same(a, b)`."""
    size = F.size(values)
    before = F.concat(F.array(F.element_at(values, 1)), F.slice(values, 1, F.greatest(size - 1, F.lit(0))))
    after = F.concat(F.slice(values, 2, F.greatest(size - 1, F.lit(0))), F.array(F.element_at(values, -1)))
    rows = F.arrays_zip(values.alias("x"), before.alias("b"), after.alias("a"), F.sequence(F.lit(1), size).alias("i"))
    kept = F.filter(
        rows,
        lambda r: ((r["i"] > 1) & same(r["x"], r["b"])) | ((r["i"] < size) & same(r["x"], r["a"])),
    )
    return F.transform(kept, lambda r: r["x"])


def with_counts(documents: DataFrame) -> DataFrame:
    """doc_id, lang, the counts of the base rules, and the two histograms `classes` and `commons`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("t"))
    listed = F.when(F.col("lang").isin(sorted(COMMON_WORDS)), F.col("lang")).otherwise(F.lit(OTHERS))
    split = base.select(
        "doc_id",
        listed.alias("lang"),
        "t",
        F.filter(F.split("t", WORD_BREAK), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    words = F.size("w")
    inner = F.greatest(words - 2, F.lit(0))
    shifted = [F.slice("w", n, inner).alias(name) for n, name in ((1, "a"), (2, "b"), (3, "c"))]
    listed_words = sorted(set().union(*COMMON_WORDS.values()))
    counted = split.select(
        "doc_id",
        "lang",
        words.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length("t").cast("long").alias("n_chars"),
        F.regexp_replace("t", PLAIN, "").alias("rest"),
        F.filter("w", lambda x: x.isin(listed_words)).alias("common"),
        F.when(words >= 4, F.arrays_zip(*shifted)).alias("windows"),
    ).select("*", F.transform("windows", lambda x: F.xxhash64(x["a"], x["b"], x["c"])).alias("hashes"))
    mask = (1 << POSITION_BITS) - 1
    repeated = F.filter(
        F.zip_with("ranked", F.slice("ranked", 2, F.size("ranked")), lambda a, b: F.when(a == b, a)), lambda h: h.isNotNull()
    )
    keyed = (
        counted.select("*", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array("hashes")).alias("ranked"))
        .select("*", F.array_distinct(repeated).alias("repeated"))
        .drop("ranked")
    )
    many = F.size("repeated") > FEW
    packed = keyed.select(
        "*",
        F.when(
            many, F.sort_array(F.transform("hashes", lambda h, i: F.shiftleft(h, POSITION_BITS).bitwiseOR(i.cast("long"))))
        ).alias("packed"),
    )
    looked_up = F.filter(
        F.transform("hashes", lambda h, i: F.when(F.array_contains("repeated", h), i.cast("long"))), lambda i: i.isNotNull()
    )
    near = packed.select(
        "*",
        F.when(
            many, _neighbours(F.col("packed"), lambda a, b: F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS))
        )
        .when(F.size("repeated") > 0, looked_up)
        .alias("near"),
    ).drop("packed", "hashes", "repeated")
    exact = near.select(
        "*",
        F.when(
            F.size("near") > 0,
            F.sort_array(
                F.transform("near", lambda p: F.struct(F.get("windows", p.bitwiseAND(mask).cast("int")).alias("x"), p.bitwiseAND(mask).alias("i")))
            ),
        ).alias("sorted"),
    ).drop("windows", "near")
    places = exact.select(
        "*",
        F.sort_array(
            F.transform(_neighbours(F.col("sorted"), lambda a, b: a["x"] == b["x"]), lambda p: p["i"])
        ).alias("places"),
    ).drop("sorted")
    gaps = F.zip_with(
        F.slice("places", 1, F.greatest(F.size("places") - 1, F.lit(0))),
        F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0))),
        lambda a, b: F.least(b - a, F.lit(3).cast("long")),
    )
    covered = F.when(F.size("places") > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda total, gap: total + gap)).otherwise(0)
    commons = F.coalesce(
        *[
            F.when(
                F.col("lang") == lang,
                F.transform(F.array(*map(F.lit, known)), lambda x: F.size("common") - F.size(F.array_remove("common", x))),
            )
            for lang, known in COMMON_WORDS.items()
        ],
        F.array().cast("array<int>"),
    )
    left = F.length("rest").cast("long")
    counts = {name: left - F.length(F.regexp_replace("rest", kind, "")) for name, kind in CLASSES.items()}
    space = F.col("n_chars") - F.col("word_chars")
    return places.select(
        "doc_id",
        "lang",
        "n_words",
        "word_chars",
        counts["symbol"].alias("n_symbols"),
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        _with_rest(F.array(*counts.values(), space, F.col("n_chars") - space - left), F.col("n_chars")).alias("classes"),
        _with_rest(commons.cast("array<long>"), F.col("n_words")).alias("commons"),
    )


def _with_rest(counts: Column, total: Column) -> Column:
    """`counts` and, as last bin, what they leave of `total`."""
    return F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)))


def language_references(counts: DataFrame) -> DataFrame:
    """For each listed language, and `*` for all others, the summed histograms over all documents."""
    widths = {"classes": len(CLASSES) + 3, "commons": max(map(len, COMMON_WORDS.values())) + 1}
    sums = [
        F.sum(F.coalesce(F.get(name, n), F.lit(0).cast("long"))).alias(f"{name}_{n}") for name, width in widths.items() for n in range(width)
    ]
    return counts.groupBy("lang").agg(*sums).select(
        "lang", *[F.array(*[F.col(f"{name}_{n}") for n in range(width)]).alias(f"{name}_all") for name, width in widths.items()]
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(0.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two arrays of shares, 0 to 1; bins that one array lacks are empty there."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2 / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))) + part(F.coalesce(b, F.lit(0.0)), F.coalesce(a, F.lit(0.0))))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))


def judge(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each row of `documents`: its counts, its two distances, `base_failed` and `kept`."""
    counts = materialize(with_counts(documents), "rule-counts")
    references = F.broadcast(language_references(counts))  # a row for each listed language and one more
    measured = counts.join(references, "lang", "left").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        jensen_shannon(_shares(F.col("classes")), _shares(F.col("classes_all"))).alias("class_distance"),
        jensen_shannon(_shares(F.col("commons")), _shares(F.col("commons_all"))).alias("word_distance"),
    )
    failed = (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words"))
    spread = 1 / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    usual = (F.col("class_distance") <= limits.class_base + limits.class_slope * spread) & (
        F.col("word_distance") <= limits.word_base + limits.word_slope * spread
    )
    return measured.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(usual, F.lit(False)))
