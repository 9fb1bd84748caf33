"""License scans: which license texts stand in which documents.

Documents and templates are lower-cased, cut into words without outer marks, and seen through overlapping windows of words. A window's MinHash
under several hash orders retrieves templates: a window is a candidate for a template when they agree in the minimum of at
least one order (bands of one row). Exact containment of the template's shingles in the document then decides.

A shingle is five words (a shorter template is one shingle of all its words). Templates are windowed too, and a template
shorter than a window makes windows of its own width. Windows start at every word on both sides, so each window of a copy
meets the same window of its template. A window altered to similarity s meets it with probability 1 - (1 - s)^orders, which
is 1 - 2^-16 at one half and 16 orders.

A window can only agree with a template in a minimum that one of its own shingles attains. The few hashes that are minima of
some template are known, so minima are computed for windows around these hashes alone; all others cannot meet.

Everything is DataFrame functions: shingle hashes, minima of array slices, an equi-join on (span, order, minimum) with the
templates' bands. Templates are an argument, a list of the driver's; their bands and shingles are counted, and broadcast up to
MOST_KEYS and MOST_SHINGLES only.

Defined results: null and empty texts hold no license. One row per document row id and template whose containment reaches
`containment`, with that share; repeated rows give repeated results. A template without words never matches. No rows give no rows.
A very long text is one array of hashes in one row; what holds no telling hash goes no further. Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.llm.license_texts import TEMPLATES
from pactlens.session import materialize

SHINGLE, WINDOW, ORDERS = 5, 32, 16
MOST_KEYS, MOST_SHINGLES = 200_000, 1_000_000  # of templates, up to which they are broadcast


def words(text: Column) -> Column:
    """Lower-case words between characters that are neither letters nor digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def _word_count(text: str) -> int:
    return len([w for w in re.split(r"[\W_]+", text.lower()) if w])


def shingle_hashes(tokens: Column, width: int) -> Column:
    """Hash of each run of `width` neighbouring words."""
    count = F.greatest(F.size(tokens) - (width - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice(tokens, n + 1, count).alias(f"w{n}") for n in range(width)])
    return F.when(count > 0, F.transform(shifted, lambda x: F.xxhash64(*[x[f"w{n}"] for n in range(width)]))).otherwise(F.array().cast("array<long>"))


def _mask(order: int) -> int:
    return (0x9E3779B97F4A7C15 * (order + 1)) % (1 << 63)


def bands(part: Column, orders: int) -> Column:
    """The minimum of a window's hashes under each order, an order being one mask over the hashes."""

    def lowest(mask: int) -> Column:
        return F.array_min(F.transform(part, lambda h: h.bitwiseXOR(F.lit(mask))))

    lows = [lowest(_mask(order)) for order in range(orders)]
    return F.array(*[F.struct(F.lit(order).alias("band"), low.alias("low")) for order, low in enumerate(lows)])


def _windows(first: Column, last: Column, hashes: Column, span: int) -> Column:
    starts = F.sequence(F.greatest(first, F.lit(1)), F.greatest(F.least(last, F.size(hashes) - span + 1), first, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda s: F.slice(hashes, s, span)))


def scan(documents: DataFrame, notices: Mapping[str, str] = TEMPLATES, containment: float = 0.8, orders: int = ORDERS) -> DataFrame:
    """doc_id, license and containment of each license found in each row."""
    spark = documents.sparkSession
    templates: dict[tuple[int, int], list[tuple[str, str]]] = {}
    for name, text in notices.items():
        if count := _word_count(text):
            width = min(SHINGLE, count)
            templates.setdefault((width, min(WINDOW, count) - width + 1), []).append((name, text))
    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w")).withColumn("row", F.monotonically_increasing_id())
    result = None
    for width in sorted({width for width, _ in templates}):
        held = [(name, text, span) for (w, span), many in sorted(templates.items()) if w == width for name, text in many]
        known = spark.createDataFrame(held, "license string, notice string, span int").select(
            "license", "span", shingle_hashes(words(F.col("notice")), width).alias("t")
        )
        spans = sorted({span for _, _, span in held})
        cut = lambda frame, span: frame.where(F.col("span") == span).select(
            "license", "span", F.explode(_windows(F.lit(1), F.size("t"), F.col("t"), span)).alias("part")
        )
        windows = functools.reduce(DataFrame.unionByName, [cut(known, span) for span in spans])
        keys = windows.select("license", "span", F.explode(bands(F.col("part"), orders)).alias("b")).select("license", "span", "b.band", "b.low").distinct()
        rows = keys.collect()  # at most templates x windows x orders
        minima = sorted({row.low ^ _mask(row.band) for row in rows})
        shingles = sum(max(1, _word_count(text)) for _, text, _ in held)
        sent = lambda frame, size, most: F.broadcast(frame) if size <= most else frame
        telling = lambda h: h.isin(minima)
        seen = base.select("doc_id", "row", shingle_hashes(F.col("w"), width).alias("h")).where(F.exists("h", telling))
        seen = materialize(seen, "license-shingles")  # rows with such a hash only
        places = F.filter(F.transform("h", lambda h, i: F.when(telling(h), i + 1)), lambda i: i.isNotNull())
        near = seen.select("row", "h", F.explode(places).alias("at"))
        met = functools.reduce(
            DataFrame.unionByName,
            [
                near.select("row", F.slice("h", F.greatest(F.col("at") - span + 1, F.lit(1)), 2 * span - 1).alias("h"))
                .select("row", F.lit(span).alias("span"), F.explode(_windows(F.lit(1), F.size("h"), F.col("h"), span)).alias("part"))
                for span in spans
            ],
        )
        found = (
            met.select("row", "span", F.explode(bands(F.col("part"), orders)).alias("b"))
            .select("row", "span", "b.band", "b.low")
            .join(sent(keys, len(rows), MOST_KEYS), ["span", "band", "low"])
            .select("row", "license")
            .distinct()
        )
        part = (
            found.join(seen, "row")
            .join(sent(known.select("license", "t"), shingles, MOST_SHINGLES), "license")
            .select("doc_id", "license", (F.size(F.array_intersect("h", "t")) / F.size(F.array_distinct("t"))).alias("containment"))
            .where(F.col("containment") >= containment)
        )
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "doc_id long, license string, containment double")
    return result
