"""Payload extraction over documents and logs derived from the test tables.

The texts are built row by row from `customer` and `events`; sources are written as files to the scratch
folder and read back, the other queries parse the text column.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pactlens.plans import payloads
from pactlens.queries.registry import big, query
from pactlens.session import scratch_path
from pactlens.sources import documents

YEAR_ONE = "0001-01-01T00:00:00"


def _nil(*names: str) -> str:
    return "".join(f'<{name} i:nil="true" />' for name in names)


def _entry(n: int) -> str:
    return f"""'<Communication><ActionMode i:nil="true" /><CallingCode>+{n}0</CallingCode><CountryCode>N' || c_nationkey
        || '</CountryCode><IsPhoneNumberChanged>N</IsPhoneNumberChanged><PhoneNumber>5' || (c_custkey * 10 + {n})
        || '</PhoneNumber><PhoneType>MOBILE</PhoneType><Preferred>Y</Preferred><Valid>Y</Valid></Communication>'"""


def _coordinator(n: int) -> str:
    return f"""'<TravelCoordinator><ActionMode>A</ActionMode><DOB i:nil="true" /><Department></Department><EmailId>t' || c_custkey || 'x{n}'
        || '</EmailId><FirstName>F' || c_custkey || '</FirstName><InactivateDate>{YEAR_ONE}</InactivateDate><LastName>L{n}</LastName>'
        || '<TVCReferenceKey>T' || c_custkey || '-{n}</TVCReferenceKey><Title>MR</Title><joiningDate>2021-0{n}-15T00:00:00</joiningDate>'
        || '</TravelCoordinator>'"""


# Text of one enrolment request per customer: 0-2 communication entries, 1-2 coordinators.
REQUEST_TEXT = f"""'<EnrolmentRequest xmlns:i="http://www.w3.org/2001/XMLSchema-instance" xmlns="urn:example:enrolment"><Address1>Street '
    || c_custkey || '</Address1>{_nil('Address2', 'Address3')}<City>CT' || c_nationkey || '</City><CommunicationDetails>'
    || CASE WHEN c_custkey % 3 >= 1 THEN {_entry(1)} ELSE '' END || CASE WHEN c_custkey % 3 = 2 THEN {_entry(2)} ELSE '' END
    || '</CommunicationDetails><CompanyName>' || c_name || '</CompanyName>{_nil('CompanyEmailId')}'
    || '<EnrollmentDate>2023-02-11T13:25:0' || (c_custkey % 10) || '.1234567+03:00</EnrollmentDate>'
    || '<PassportExpiry>' || CASE WHEN c_custkey % 4 = 0 THEN '{YEAR_ONE}' ELSE '2024-05-0' || (c_custkey % 4) || 'T00:00:00' END
    || '</PassportExpiry><ProfileReferencekey>K' || c_custkey || '</ProfileReferencekey>{_nil('PromoCode')}<TravelCoOrdinators>'
    || {_coordinator(1)} || CASE WHEN c_custkey % 2 = 1 THEN {_coordinator(2)} ELSE '' END
    || '</TravelCoOrdinators><channel>WEB</channel></EnrolmentRequest>'"""


def _contact(n: int) -> str:
    values = ", ".join(
        f'"{name}": ""'
        for name in documents.CONTACT_FIELDS
        if name
        not in (
            "title",
            "dob",
            "passportExpiryDate",
            "firstName",
            "lastName",
            "emailID",
            "isSMEAdmin",
            "isProgramAdmin",
            "pageNumber",
            "pageSize",
            "remarks",
            "validationErrors",
        )
    )
    return f"""'{{"title": "' || CASE WHEN event_id % 4 = 0 THEN '' ELSE 'MR' END || '", "dob": "' || CASE WHEN event_id % 5 < 2 THEN '{YEAR_ONE}'
        ELSE '198{n}-02-0' || (event_id % 5) || 'T00:00:00' END || '", "passportExpiryDate": "202' || (event_id % 7) || '-03-04T00:00:00'
        || '", "firstName": "F' || event_id || '", "lastName": "L{n}", "emailID": "' || CASE WHEN event_id % 3 = 1 THEN '' ELSE 'e' || event_id END
        || '", "isSMEAdmin": "' || CASE WHEN event_id % 6 = 5 THEN 'Y' ELSE 'N' END || '", "isProgramAdmin": "N", "pageNumber": 0, "pageSize": 0, '
        || '"remarks": null, "validationErrors": null, {values}}}'"""


# Text of one response page per event: 0-2 contacts.
RESPONSE_TEXT = f"""'{{"validationCode": "V' || event_id || '", "productCode": "' || event_type || '", "pageNumber": 1, "pageSize": '
    || get_json_object(props, '$.k') || ', "contactDetails": [' || CASE WHEN event_id % 3 >= 1 THEN {_contact(1)} ELSE '' END
    || CASE WHEN event_id % 3 = 2 THEN ', ' || {_contact(2)} ELSE '' END || '], "errors": null, "action": "N", "validationErrors": null}}'"""

GAP = " " * 17
FRAMES = (
    "\\n   at Net.Sockets.Socket.EndReceive(IAsyncResult r)\\n   at Net.Stream.EndRead(IAsyncResult r)"
    "\\n   --- End of inner exception stack trace ---\\n   at App.Client.MoveNext()"
)

# Text of one log record per event: errors are FATAL with a chain of 2 or 3 exceptions and 3 frames.
LOG_TEXT = f"""'Timestamp: ' || date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS') || '{GAP}Message: ' || event_type || ' for user ' || user_id
    || CASE WHEN event_id % 5 = 0 THEN '\\n second line' ELSE '' END || '{GAP}Severity:' || CASE WHEN event_type = 'error' THEN 'FATAL' ELSE 'INFO' END
    || '{GAP}Machine:Host.Get(:0){GAP}Process Name:App [(null)]{GAP}Thread Id:[' || (event_id % 4) || ']{GAP}Exception: '
    || CASE WHEN event_type = 'error' THEN 'Sys.AggregateException: Several errors. ---> Net.RequestException: No answer.'
        || CASE WHEN event_id % 2 = 0 THEN ' ---> IO.IOException: Closed.' ELSE '' END || '{FRAMES}' ELSE '' END
    || '{GAP}UserName: SYSTEM{GAP}Method:M' || (user_id % 3) || '{GAP}Identity:{GAP}Logger:App.Log'"""

# Text of one response record per customer, but for every fourth.
ANSWER_TEXT = """'2023-02-11 13:26:41,250 Message: Reply:\\n<ServiceResponse xmlns:i="http://www.w3.org/2001/XMLSchema-instance"'
    || ' xmlns="urn:example:answer"><Action i:nil="true" /><Errors xmlns:d2p1="urn:example:arrays">'
    || CASE WHEN c_custkey % 3 = 0 THEN '<d2p1:string>Customer exists</d2p1:string>' ELSE '' END || '</Errors><ProfileReferencekey>K' || c_custkey
    || '</ProfileReferencekey><Status>' || CASE WHEN c_custkey % 3 = 0 THEN 'false' ELSE 'true' END || '</Status></ServiceResponse>'
    || ' Severity:INFO Machine:Host Process Name:App Thread Id:[1] Exception: UserName: SYSTEM Method:Reply Identity: Logger:App.Log'"""


def _base(t, name: str):
    return t.spark.read.parquet(f"{t.folder}/{name}.parquet")


def _spread(t, name: str):
    """Rows of a table over all cores: a document is many times its row's size, so one split of a file makes very many of them."""
    return _base(t, name).repartition(4 * t.spark.sparkContext.defaultParallelism)


def _requests(t):
    return _spread(t, "customer").select(documents.parse_requests(F.expr(REQUEST_TEXT)).alias("doc"))


def _responses(t):
    return _base(t, "events").select(documents.parse_responses(F.expr(RESPONSE_TEXT)).alias("doc"))


def _log_rows(t):
    record = F.regexp_replace(F.expr(LOG_TEXT), "^Timestamp: ", "")
    return payloads.log_rows(_base(t, "events").select("event_id", record.alias("record")), "event_id")


def _written(t, base: str, text: str, label: str) -> str:
    path = scratch_path(t.spark, label)
    _base(t, base).select(F.expr(text).alias("value")).write.text(path)
    return path


@query(
    "xml_source",
    """SELECT 'K' || c_custkey AS reference, c_name AS company, 'CT' || c_nationkey AS city, CAST(NULL AS VARCHAR) AS address2,
        CAST(c_custkey % 3 AS BIGINT) AS communications, CAST(1 + c_custkey % 2 AS BIGINT) AS coordinators FROM customer""",
)
def xml_source(t):
    # Files of up to 500 requests each, under one root element.
    path = scratch_path(t.spark, "requests")
    batches = _base(t, "customer").groupBy(F.expr("c_custkey div 500").alias("batch"))
    files = batches.agg(F.array_join(F.collect_list(F.expr(REQUEST_TEXT)), "").alias("body"))
    text = F.concat(F.lit("<Requests>"), "body", F.lit("</Requests>"))
    files.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    requests = documents.read_requests(t.spark, path, "EnrolmentRequest")
    return requests.select(
        F.col("ProfileReferencekey").alias("reference"),
        F.col("CompanyName").alias("company"),
        F.col("City").alias("city"),
        payloads.blank_as_null(F.col("Address2")).alias("address2"),
        F.coalesce(F.size("CommunicationDetails.Communication"), F.lit(0)).alias("communications"),
        F.size("TravelCoOrdinators.TravelCoordinator").alias("coordinators"),
    ).withColumn("communications", F.greatest("communications", F.lit(0)))


@query(
    "json_source",
    """SELECT 'V' || event_id AS code, event_type AS product, CAST(json_extract_string(props, '$.k') AS BIGINT) AS page_size,
        CAST(event_id % 3 AS BIGINT) AS contacts FROM events""",
)
def json_source(t):
    responses = documents.read_responses(t.spark, _written(t, "events", RESPONSE_TEXT, "responses"))
    return responses.select(
        F.col("validationCode").alias("code"),
        F.col("productCode").alias("product"),
        F.col("pageSize").alias("page_size"),
        F.size("contactDetails").alias("contacts"),
    )


LOG_TIME_SQL = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at"


@query(
    "log_source",
    f"""SELECT {LOG_TIME_SQL}, CASE WHEN event_type = 'error' THEN 'FATAL' ELSE 'INFO' END AS severity,
        CASE WHEN event_id % 5 = 0 THEN CAST(2 AS BIGINT) ELSE 1 END AS message_lines FROM events""",
)
def log_source(t):
    records = documents.read_log_records(t.spark, _written(t, "events", LOG_TEXT, "logs"))
    rows = payloads.log_rows(records)
    return rows.select(
        F.col("timestamp").alias("logged_at"), "severity", F.size(F.split("message", "\n")).alias("message_lines")
    )


@query(
    "xml_flatten_members",
    f"""SELECT 'K' || c_custkey AS ProfileReferencekey, c_name AS CompanyName, {big('n - 1', 'position')}, 'F' || c_custkey AS member_FirstName,
        'L' || n AS member_LastName, 't' || c_custkey || 'x' || n AS member_EmailId, CAST(NULL AS VARCHAR) AS member_DOB,
        CAST(NULL AS VARCHAR) AS member_Department, 'T' || c_custkey || '-' || n AS member_TVCReferenceKey
    FROM customer, (VALUES (1), (2)) AS v(n) WHERE n = 1 OR c_custkey % 2 = 1""",
)
def xml_flatten_members(t):
    rows = payloads.flatten_coordinators(_requests(t), "doc", "TravelCoordinator", ["ProfileReferencekey", "CompanyName"])
    kept = ("FirstName", "LastName", "EmailId", "DOB", "Department", "TVCReferenceKey")
    return rows.select("ProfileReferencekey", "CompanyName", "position", *[f"member_{name}" for name in kept])


@query(
    "xml_communications",
    f"""SELECT 'K' || c_custkey AS ProfileReferencekey, {big('n - 1', 'position')}, '+' || n || '0' AS CallingCode, 'N' || c_nationkey AS CountryCode,
        '5' || (c_custkey * 10 + n) AS PhoneNumber, CAST(NULL AS VARCHAR) AS ActionMode
    FROM customer, (VALUES (1), (2)) AS v(n) WHERE n <= c_custkey % 3
    UNION ALL SELECT 'K' || c_custkey, NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 3 = 0""",
)
def xml_communications(t):
    rows = payloads.flatten_communications(_requests(t), "doc", "Communication", ["ProfileReferencekey"])
    return rows.select("ProfileReferencekey", "position", "CallingCode", "CountryCode", "PhoneNumber", "ActionMode")


@query(
    "nil_and_sentinel_to_null",
    """SELECT 'K' || c_custkey AS reference, CAST(NULL AS VARCHAR) AS address2, CAST(NULL AS VARCHAR) AS promo_code,
        CASE WHEN c_custkey % 4 <> 0 THEN '2024-05-0' || (c_custkey % 4) || ' 00:00:00' END AS passport_expiry,
        '2023-02-11 10:25:0' || (c_custkey % 10) AS enrolled_at FROM customer""",
)
def nil_and_sentinel_to_null(t):
    doc = F.col("doc")
    enrolled = F.convert_timezone(F.current_timezone(), F.lit("UTC"), payloads.time_or_null(doc["EnrollmentDate"]))
    return _requests(t).select(
        doc["ProfileReferencekey"].alias("reference"),
        payloads.blank_as_null(doc["Address2"]).alias("address2"),
        payloads.blank_as_null(doc["PromoCode"]).alias("promo_code"),
        payloads.time_or_null(doc["PassportExpiry"]).alias("passport_expiry"),
        enrolled.alias("enrolled_at"),
    )


@query(
    "json_explode_contacts",
    f"""SELECT 'V' || event_id AS page_validationCode, event_type AS page_productCode, {big('n - 1', 'position')}, 'F' || event_id AS firstName,
        'L' || n AS lastName, CASE WHEN event_id % 4 <> 0 THEN 'MR' END AS title, CASE WHEN event_id % 3 <> 1 THEN 'e' || event_id END AS emailID,
        CASE WHEN event_id % 5 >= 2 THEN '198' || n || '-02-0' || (event_id % 5) || ' 00:00:00' END AS dob,
        CAST(NULL AS VARCHAR) AS nationality FROM events, (VALUES (1), (2)) AS v(n) WHERE n <= event_id % 3""",
)
def json_explode_contacts(t):
    rows = payloads.explode_contacts(_responses(t), "doc", ["validationCode", "productCode"])
    return rows.select(
        "page_validationCode", "page_productCode", "position", "firstName", "lastName", "title", "emailID", "dob", "nationality"
    )


@query(
    "json_contact_profile",
    """SELECT CASE WHEN event_id % 6 = 5 THEN 'Y' ELSE 'N' END AS isSMEAdmin, 'N' AS isProgramAdmin,
        CASE WHEN event_id % 4 <> 0 THEN 'MR' END AS title, CAST(count(*) AS BIGINT) AS contacts,
        CAST(count(*) FILTER (WHERE event_id % 3 = 1) AS BIGINT) AS blank_emails,
        CAST(count(*) FILTER (WHERE 2020 + event_id % 7 <= 2023) AS BIGINT) AS expired_passports
    FROM events, (VALUES (1), (2)) AS v(n) WHERE n <= event_id % 3 GROUP BY 1, 2, 3""",
)
def json_contact_profile(t):
    contacts = payloads.explode_contacts(_responses(t), "doc", [])
    return payloads.contact_profile(contacts, dt.date(2023, 6, 30))


FATAL_SQL = "CASE WHEN event_type = 'error' THEN 'FATAL' ELSE 'INFO' END"


@query(
    "log_records",
    f"""SELECT event_id, {LOG_TIME_SQL.replace('logged_at', 'timestamp')},
        event_type || ' for user ' || user_id || CASE WHEN event_id % 5 = 0 THEN chr(10) || ' second line' ELSE '' END AS message,
        {FATAL_SQL} AS severity, 'Host.Get(:0)' AS machine, 'App [(null)]' AS process_name, '[' || (event_id % 4) || ']' AS thread_id,
        CASE WHEN event_type = 'error' THEN 'Sys.AggregateException' END AS exception, 'SYSTEM' AS username,
        'M' || (user_id % 3) AS method, CAST(NULL AS VARCHAR) AS identity, 'App.Log' AS logger FROM events""",
)
def log_records(t):
    rows = _log_rows(t)
    return rows.withColumn("exception", F.regexp_extract("exception", "^([^:]+):", 1))


@query(
    "log_severity_counts",
    f"SELECT {FATAL_SQL} AS severity, 'M' || (user_id % 3) AS method, CAST(count(*) AS BIGINT) AS records FROM events GROUP BY 1, 2",
)
def log_severity_counts(t):
    return payloads.severity_counts(_log_rows(t))


@query(
    "log_exception_chain",
    f"""SELECT event_id, {big('n', 'depth')}, ['Sys.AggregateException', 'Net.RequestException', 'IO.IOException'][n + 1] AS exception_type,
        n = CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS is_root
    FROM events, (VALUES (0), (1), (2)) AS v(n) WHERE event_type = 'error' AND (n < 2 OR event_id % 2 = 0)""",
)
def log_exception_chain(t):
    return payloads.exception_chain(_log_rows(t), "event_id")


@query(
    "log_stack_frames",
    f"""SELECT event_id, {big('n', 'position')}, ['Net.Sockets.Socket', 'Net.Stream', 'App.Client'][n + 1] AS type_name,
        ['EndReceive', 'EndRead', 'MoveNext'][n + 1] AS method_name
    FROM events, (VALUES (0), (1), (2)) AS v(n) WHERE event_type = 'error'""",
)
def log_stack_frames(t):
    return payloads.stack_frames(_log_rows(t), "event_id")


# Sends of a request (custkey % 3 + 1 of them, 20 seconds apart) and replies: most 10 seconds after their send, some not at all, those of
# every sixth customer only after all sends (last send first), and every seventh customer has one before any send.
SENDS = "SELECT c_custkey, n FROM customer, (VALUES (0), (1), (2)) AS v(n) WHERE n <= c_custkey % 3"
REPLIES = """SELECT c_custkey, n, CASE WHEN c_custkey % 6 = 5 THEN 100 - n ELSE 20 * n + 10 END AS second FROM sends WHERE (c_custkey + n) % 4 <> 0
    UNION ALL SELECT c_custkey, -1, -5 FROM customer WHERE c_custkey % 7 = 0"""


@query(
    "request_response_order",
    f"""WITH sends AS ({SENDS}), replies AS ({REPLIES}),
    pairs AS (SELECT s.c_custkey, s.n AS sent, r.n AS said, r.second, row_number() OVER (PARTITION BY r.c_custkey, r.n ORDER BY s.n DESC) AS nearest
        FROM sends s JOIN replies r ON r.c_custkey = s.c_custkey AND 20 * s.n <= r.second
        WHERE (SELECT count(*) FROM sends o WHERE o.c_custkey = s.c_custkey AND o.n > s.n AND 20 * o.n <= r.second)
            = (SELECT count(*) FROM replies o WHERE o.c_custkey = s.c_custkey AND o.second >= 20 * s.n AND o.second < r.second))
    SELECT 'K' || s.c_custkey AS reference, {big('s.n', 'attempt')}, p.said IS NOT NULL AS answered, 'S' || p.said AS status, {big('p.second', 'answer_second')}
    FROM sends s LEFT JOIN pairs p ON p.c_custkey = s.c_custkey AND p.sent = s.n AND p.nearest = 1""",
)
def request_response_order(t):
    """Requests that were sent again, each with its own answer."""
    customers = _base(t, "customer").select("c_custkey")
    sends = customers.select("c_custkey", F.explode(F.sequence(F.lit(0), (F.col("c_custkey") % 3).cast("int"))).alias("n"))
    keys = [F.concat(F.lit("K"), "c_custkey").alias("reference"), F.concat(F.lit("["), F.col("c_custkey") % 4, F.lit("]")).alias("thread_id")]
    start = F.lit("2023-02-11 13:00:00").cast("timestamp_ntz")
    at = lambda second: (start + F.make_dt_interval(secs=second)).alias("at")
    requests = sends.select(*keys, at(F.col("n") * 20), (F.col("c_custkey") * 10 + F.col("n")).cast("long").alias("request_id"), F.col("n").alias("attempt"))
    usual = sends.where((F.col("c_custkey") + F.col("n")) % 4 != 0).withColumn(
        "second", F.when(F.col("c_custkey") % 6 == 5, 100 - F.col("n")).otherwise(20 * F.col("n") + 10)
    )
    early = customers.where(F.col("c_custkey") % 7 == 0).select("c_custkey", F.lit(-1).alias("n"), F.lit(-5).alias("second"))
    replies = usual.unionByName(early).select(*keys, at(F.col("second")), F.concat(F.lit("S"), "n").alias("status"), F.col("second").alias("answer_second"))
    found = payloads.answers_in_order(requests, replies)
    return found.select("reference", "attempt", F.col("status").isNotNull().alias("answered"), "status", "answer_second")


ROOT_SQL = "CASE WHEN event_id % 2 = 0 THEN 'IO.IOException' ELSE 'Net.RequestException' END"


@query(
    "log_top_frames",
    f"""WITH frames AS (SELECT {ROOT_SQL} AS exception_type, unnest(['Net.Sockets.Socket.EndReceive', 'Net.Stream.EndRead',
            'App.Client.Step' || (user_id % 40)]) AS frame FROM events WHERE event_type = 'error'),
    counted AS (SELECT exception_type, frame, count(*) AS records FROM frames GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY exception_type ORDER BY records DESC, frame) AS rank FROM counted)
    SELECT exception_type, {big('rank')}, frame, {big('records')} FROM ranked WHERE rank <= 6""",
)
def log_top_frames(t):
    """The frames that root causes pass through most often."""
    record = F.regexp_replace(F.regexp_replace(F.expr(LOG_TEXT), "^Timestamp: ", ""), r"MoveNext\(\)", F.concat(F.lit("Step"), F.col("user_id") % 40, F.lit("()")))
    rows = payloads.log_rows(_base(t, "events").where("event_type = 'error'").select("event_id", record.alias("record")), "event_id")
    roots = payloads.exception_chain(rows, "event_id").where("is_root").select("event_id", "exception_type")
    frames = payloads.stack_frames(rows, "event_id").select("event_id", F.concat_ws(".", "type_name", "method_name").alias("frame"))
    return payloads.top_frames(frames.join(roots, "event_id"), "exception_type", "frame", 6)


# An element of a page without blanks; every seventh last name holds what looks like a border.
COMPACT_CONTACT = """'{"title":"MR","firstName":"F' || event_id || '","lastName":"' || CASE WHEN event_id % 7 = 0 THEN 'a},{\\\\"b' ELSE 'L' END
    || event_id || '","emailID":"' || CASE WHEN event_id % 3 = 1 THEN '' ELSE 'e' || event_id END || '","pageNumber":' || (event_id % 9) || '}'"""


@query(
    "json_large_pages",
    """SELECT 'V' || (event_id // 3000) AS page, CAST(row_number() OVER (PARTITION BY event_id // 3000 ORDER BY event_id) - 1 AS BIGINT) AS position,
        'F' || event_id AS first_name, CASE WHEN event_id % 7 = 0 THEN 'a},{"b' ELSE 'L' END || event_id AS last_name,
        CASE WHEN event_id % 3 <> 1 THEN 'e' || event_id END AS email, CAST(event_id % 9 AS BIGINT) AS page_number FROM events""",
)
def json_large_pages(t):
    """Pages of one physical line each, cut at element borders."""
    path = scratch_path(t.spark, "large-pages")
    texts = _base(t, "events").select(F.expr("event_id div 3000").alias("page"), "event_id", F.expr(COMPACT_CONTACT).alias("text"))
    bodies = texts.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("event_id", "text"))).alias("items"))  # the stand-in's own pages
    body = F.array_join(F.transform("items", lambda item: item["text"]), ",")
    head = F.concat(F.lit('{"validationCode":"V'), "page", F.lit('","productCode":"P","pageNumber":1,"pageSize":999999999,"contactDetails":['))
    page = F.concat(head, body, F.lit('],"errors":null,"action":"N","validationErrors":null}'))
    bodies.select(page.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    rows = documents.read_large_pages(t.spark, path)
    contact = F.col("contact")
    return rows.select(
        F.col("envelope.validationCode").alias("page"),
        "position",
        contact["firstName"].alias("first_name"),
        contact["lastName"].alias("last_name"),
        payloads.blank_as_null(contact["emailID"]).alias("email"),
        contact["pageNumber"].alias("page_number"),
    )


@query(
    "request_response_join",
    """SELECT 'K' || c_custkey AS reference, c_name AS company,
        CASE WHEN c_custkey % 4 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'false' ELSE 'true' END END AS status,
        CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 3 = 0 THEN 'Customer exists' END AS error_text FROM customer""",
)
def request_response_join(t):
    doc = F.col("doc")
    requests = _requests(t).select(doc["ProfileReferencekey"].alias("reference"), doc["CompanyName"].alias("company"))
    answers = _spread(t, "customer").where(F.col("c_custkey") % 4 != 0).select(F.expr(ANSWER_TEXT).alias("record"))
    fields = payloads.response_fields(documents.log_fields(F.col("record"))["message"])
    responses = answers.select(*[column.alias(name) for name, column in fields.items()])
    return payloads.match_responses(requests, responses)
