"""Rows from request documents, response documents and service logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactlens.functions.dates import on_or_before, sentinel_as_null
from pactlens.session import materialize
from pactlens.sources.documents import COMMUNICATION_FIELDS, CONTACT_FIELDS, CONTACT_NUMBERS, COORDINATOR_FIELDS, log_fields


def blank_as_null(column: Column) -> Column:
    """A nil element and an empty text both mean "not given"."""
    return F.nullif(column, F.lit(""))


def time_or_null(column: Column) -> Column:
    """Time text to a timestamp; year-1 sentinels and unreadable texts are NULL."""
    return sentinel_as_null(F.try_to_timestamp(blank_as_null(column)).cast("timestamp_ntz"))


def flatten_coordinators(requests: DataFrame, document: str, item: str, header: list[str]) -> DataFrame:
    """Header fields and one row per travel coordinator; a request without any keeps one row."""
    doc = F.col(document)
    rows = requests.select(
        *[blank_as_null(doc[name]).alias(name) for name in header],
        F.posexplode_outer(doc["TravelCoOrdinators"][item]).alias("position", "member"),
    )
    members = [blank_as_null(F.col("member")[name]).alias(f"member_{name}") for name in COORDINATOR_FIELDS]
    return rows.select(*header, "position", *members)


def flatten_communications(requests: DataFrame, document: str, item: str, header: list[str]) -> DataFrame:
    """One row per communication entry; a request without any keeps one row."""
    doc = F.col(document)
    rows = requests.select(
        *[blank_as_null(doc[name]).alias(name) for name in header],
        F.posexplode_outer(doc["CommunicationDetails"][item]).alias("position", "entry"),
    )
    return rows.select(*header, "position", *[blank_as_null(F.col("entry")[name]).alias(name) for name in COMMUNICATION_FIELDS])


def explode_contacts(responses: DataFrame, document: str, envelope: list[str]) -> DataFrame:
    """One row per contact with the envelope fields; empty texts and year-1 dates are NULL."""
    doc = F.col(document)
    rows = responses.select(
        *[doc[name].alias(f"page_{name}") for name in envelope],
        F.posexplode(doc["contactDetails"]).alias("position", "contact"),
    )
    contact = F.col("contact")
    fields = []
    for name in CONTACT_FIELDS:
        value = contact[name]
        if name in ("dob", "passportExpiryDate"):
            value = time_or_null(value)
        elif name not in CONTACT_NUMBERS:
            value = blank_as_null(value)
        fields.append(value.alias(name))
    return rows.select(*[f"page_{name}" for name in envelope], "position", *fields)


def contact_profile(contacts: DataFrame, as_of: dt.date) -> DataFrame:
    """Contacts by role and title: number, blank e-mails, passports expired at the date."""
    expired = on_or_before(F.col("passportExpiryDate"), as_of - dt.timedelta(days=1))
    return contacts.groupBy("isSMEAdmin", "isProgramAdmin", "title").agg(
        F.count(F.lit(1)).alias("contacts"),
        F.count_if(F.col("emailID").isNull()).alias("blank_emails"),
        F.count_if(expired).alias("expired_passports"),
    )


def log_rows(records: DataFrame, *keep: str) -> DataFrame:
    """Log records as rows of labelled fields."""
    return records.select(*keep, *[column.alias(name) for name, column in log_fields(F.col("record")).items()])


def severity_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity", "method").agg(F.count(F.lit(1)).alias("records"))


def exception_text(text: Column) -> Column:
    """The part of an exception text before its stack frames."""
    return F.regexp_extract(text, r"(?s)^(.*?)(?:\n\s+at |$)", 1)


def exception_chain(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per exception of a chain `a ---> b ---> c` with its depth; the last one is the root cause."""
    links = F.split(exception_text(F.col("exception")), r"\s*--->\s*")
    exploded = rows.where(F.col("exception").isNotNull()).select(
        *keep, F.posexplode(links).alias("depth", "link"), F.size(links).alias("links")
    )
    kind = F.regexp_extract("link", r"^([^:]+)", 1)
    return exploded.select(*keep, "depth", F.trim(kind).alias("exception_type"), (F.col("depth") == F.col("links") - 1).alias("is_root"))


def stack_frames(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per `at Type.Method(...)` frame in order."""
    frames = F.regexp_extract_all("exception", F.lit(r"(?m)^\s*at ([^\n(]+\([^\n]*\))"), F.lit(1))
    exploded = rows.where(F.col("exception").isNotNull()).select(*keep, F.posexplode(frames).alias("position", "frame"))
    call = F.regexp_extract("frame", r"^([^(]+)\(", 1)
    return exploded.select(
        *keep,
        "position",
        F.regexp_extract(call, r"^(.*)\.[^.]+$", 1).alias("type_name"),
        F.regexp_extract(call, r"([^.]+)$", 1).alias("method_name"),
    )


def response_fields(message: Column) -> dict[str, Column]:
    """Reference key, status and error text of a response document in a log message."""
    body = F.regexp_extract(message, r"(?s)(<\w+.*>)", 1)
    # Element names without their namespace prefix, which the sender picks.
    body = F.regexp_replace(body, r"(</?)\w+:", "$1")
    schema = "ProfileReferencekey STRING, Status STRING, Errors STRUCT<string: ARRAY<STRING>>"
    parsed = F.from_xml(F.nullif(body, F.lit("")), schema)
    return {
        "reference": blank_as_null(parsed["ProfileReferencekey"]),
        "status": blank_as_null(parsed["Status"]),
        "error_text": blank_as_null(F.array_join(parsed["Errors"]["string"], "; ")),
    }


def match_responses(requests: DataFrame, responses: DataFrame, key: str = "reference") -> DataFrame:
    """Each request with the status and error text of its response, if one came.

    Responses are written first: the join's test for a key would otherwise parse them again, and before they are dealt out.
    """
    return requests.join(materialize(responses, "responses"), key, "left")


def answers_in_order(requests: DataFrame, answers: DataFrame, key: str = "reference", thread: str = "thread_id", at: str = "at") -> DataFrame:
    """Each request with the answer that belongs to it: an answer goes to the last request of its key and thread that is still open.

    Requests (id, key, thread, time) and answers (key, thread, time and their own columns) of a key and thread are sorted
    once by time; a request precedes an answer of the same moment. The running number of requests less answers, taken
    above its lowest value so far, is how many requests are open: an answer closes the one that opened that level.
    So a request that was sent again gets its own answer, and answers that find no open request belong to none.
    Rows without a key belong to none either; a NULL thread counts as one thread.
    """
    fields = [name for name in answers.columns if name not in (key, thread, at)]
    none = F.lit(None)
    opened = requests.select(
        F.col(key).alias("k"), F.col(thread).alias("t"), F.col(at).alias("at"), F.lit(0).alias("closes"), F.col("request_id"),
        *[none.cast(answers.schema[name].dataType).alias(name) for name in fields],
    )
    closed = answers.select(
        F.col(key).alias("k"), F.col(thread).alias("t"), F.col(at).alias("at"), F.lit(1).alias("closes"),
        none.cast(requests.schema["request_id"].dataType).alias("request_id"), *fields,
    )
    events = opened.unionByName(closed).where(F.col("k").isNotNull())
    tie = F.xxhash64("request_id", *fields)
    order = W.partitionBy("k", "t").orderBy("at", "closes", "request_id", tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    balance = events.withColumn("balance", F.sum(F.lit(1) - 2 * F.col("closes")).over(order))
    balance = balance.withColumn("floor", F.least(F.min("balance").over(order), F.lit(0)))
    # After a request its own level, before an answer that of the request which it closes.
    level = F.col("balance") - F.col("floor") + F.col("closes")
    before = W.partitionBy("k", "t").orderBy("at", "closes", "request_id", tie)
    alone = (F.col("closes") == 1) & (F.col("floor") < F.coalesce(F.lag("floor").over(before), F.lit(0)))
    placed = balance.withColumns({"level": level, "alone": alone}).where(~F.col("alone"))
    same_level = W.partitionBy("k", "t", "level").orderBy("at", "closes", "request_id", tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    matched = placed.withColumn("answered_id", F.last("request_id", ignorenulls=True).over(same_level)).where("closes = 1")
    found = matched.select(F.col("answered_id").alias("found_id"), F.col("at").alias("answered_at"), *fields)
    return requests.join(found, F.col("request_id") == F.col("found_id"), "left").drop("found_id")


SKETCH_ITEMS = 1024  # frames a sketch tracks for each group
_SKETCH_ERROR = 3.5  # a frame that is not tracked has at most this share / SKETCH_ITEMS of its group's rows


def top_frames(frames: DataFrame, by: str, frame: str, k: int, items: int = SKETCH_ITEMS) -> DataFrame:
    """The `k` most frequent frames of each group with their exact counts; ties go to the lower frame.

    A mergeable sketch per group, of fixed size, names candidates; a second pass counts these exactly. That is the answer where
    the candidates are all frames there are, or the k-th count is above what a frame that is none may have; where not
    (long tails of rare frames), all frames of the group are counted.
    """
    rows = frames.select(F.col(by).alias("grp"), F.col(frame).alias("frame")).where(F.col("frame").isNotNull())
    sketches = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(frame, {items}, {items})").alias("top"))
    sketches = materialize(sketches, "frame-sketches")
    candidates = sketches.select("grp", F.explode("top.item").alias("frame"))
    named = candidates.select(F.col("grp").alias("c_grp"), F.col("frame").alias("c_frame"))
    exact = rows.join(named, F.col("grp").eqNullSafe(F.col("c_grp")) & (F.col("frame") == F.col("c_frame")), "left_semi")
    exact = exact.groupBy("grp", "frame").agg(F.count(F.lit(1)).alias("records"))
    best = W.partitionBy("grp").orderBy(F.desc("records"), "frame")
    exact = materialize(exact, "frame-candidates")
    best = W.partitionBy("grp").orderBy(F.desc("records"), "frame")
    ranked = exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    least = ranked.groupBy(F.col("grp").alias("l_grp")).agg(F.min("records").alias("least"), F.count(F.lit(1)).alias("found"))
    covered = exact.groupBy(F.col("grp").alias("x_grp")).agg(F.sum("records").alias("covered"))
    most_missed = F.col("rows") * _SKETCH_ERROR / items
    judged = (
        sketches.join(least, F.col("grp").eqNullSafe(F.col("l_grp")), "left")
        .join(covered, F.col("grp").eqNullSafe(F.col("x_grp")), "left")
        .select(F.col("grp").alias("j_grp"), ((F.col("covered") == F.col("rows")) | ((F.col("found") >= k) & (F.col("least") > most_missed))).alias("sure"))
    )
    sure = ranked.join(judged.where("sure"), F.col("grp").eqNullSafe(F.col("j_grp")), "left_semi")
    rest = rows.join(judged.where("NOT coalesce(sure, false)"), F.col("grp").eqNullSafe(F.col("j_grp")), "left_semi")
    rest = rest.groupBy("grp", "frame").agg(F.count(F.lit(1)).alias("records")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    whole = sure.unionByName(rest)
    return whole.select(F.col("grp").alias(by), "rank", F.col("frame").alias(frame), "records")
