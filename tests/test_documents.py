import datetime as dt
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from pactlens.plans import payloads
from pactlens.sources import documents

LOG = (
    '<Request><Key>K1</Key></Request>\r\n'
    "Timestamp: 2021-01-02 03:04:05,678  Message: start of call  Severity:INFO  Machine:Host  Process Name:P [(null)]  Thread Id:[1]"
    "  Exception:   UserName: NAME ONE  Method:Run  Identity:  Logger:L\r\n"
    "Timestamp: 2021-01-02 03:04:06,000  Message: Lookup of a fare broke off  Severity:FATAL  Machine:Host  Process Name:P  Thread Id:[2]"
    "  Exception: A.OneException: first, ---> B.TwoException: second\r\n   at X.Y.Call(String s, Int32 n)\r\n   at X.Z.Inner.MoveNext()\r\n"
    "   --- End of inner exception stack trace ---\r\n   at Top.Run()\r\n\r\n  UserName: N  Method:Run  Identity:  Logger:L\r\n"
    "Timestamp: 2021-01-02 03:04:07,001  Message: this record ends\r\n half way"
)


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text, newline="")
    return str(tmp_path)


def test_log_keeps_headless_and_cut_records(spark, tmp_path):
    records = documents.read_log_records(spark, write(tmp_path, "a.log", LOG))
    rows = {r.timestamp: r for r in payloads.log_rows(records, "record").collect()}
    assert len(rows) == 4
    assert rows[None].record.startswith("<Request>") and rows[None].severity is None
    first = rows[dt.datetime(2021, 1, 2, 3, 4, 5, 678000)]
    assert (first.message, first.severity, first.thread_id, first.exception) == ("start of call", "INFO", "[1]", None)
    assert (first.username, first.method, first.identity, first.logger) == ("NAME ONE", "Run", None, "L")
    cut = rows[dt.datetime(2021, 1, 2, 3, 4, 7, 1000)]
    assert cut.message == "this record ends\n half way" and cut.severity is None and cut.logger is None


def test_exception_chain_and_frames(spark, tmp_path):
    rows = payloads.log_rows(documents.read_log_records(spark, write(tmp_path, "a.log", LOG)))
    chain = payloads.exception_chain(rows, "severity").orderBy("depth").collect()
    assert [(r.depth, r.exception_type, r.is_root) for r in chain] == [(0, "A.OneException", False), (1, "B.TwoException", True)]
    frames = payloads.stack_frames(rows, "severity").orderBy("position").collect()
    assert [(r.type_name, r.method_name) for r in frames] == [("X.Y", "Call"), ("X.Z.Inner", "MoveNext"), ("Top", "Run")]
    counts = {(r.severity, r.method): r.records for r in payloads.severity_counts(rows).collect()}
    assert counts == {("INFO", "Run"): 1, ("FATAL", "Run"): 1, (None, None): 2}


def test_response_in_log_message(spark):
    message = (
        'Answer:\n<R xmlns:i="u" xmlns="v"><Errors xmlns:d="w"><d:string>no seat</d:string><d:string>late</d:string></Errors>'
        "<ProfileReferencekey>K7</ProfileReferencekey><Status>false</Status></R>"
    )
    df = spark.createDataFrame([(1, message), (2, "no document"), (3, None)], "id INT, m STRING")
    fields = payloads.response_fields(F.col("m"))
    rows = {r.id: r for r in df.select("id", *[c.alias(n) for n, c in fields.items()]).collect()}
    assert (rows[1].reference, rows[1].status, rows[1].error_text) == ("K7", "false", "no seat; late")
    assert rows[2].reference is None and rows[3].status is None


def test_request_document_file(spark, tmp_path):
    body = (
        '<Req xmlns:i="http://www.w3.org/2001/XMLSchema-instance" xmlns="urn:x">\r\n<Address1>A</Address1><Address2 i:nil="true" />'
        "<CommunicationDetails><Item><PhoneNumber>1</PhoneNumber></Item></CommunicationDetails>"
        "<EffectiveFrom>0001-01-01T00:00:00</EffectiveFrom><EnrollmentDate>2023-02-11T13:25:41.7654321+03:00</EnrollmentDate>"
        '<ProfileReferencekey>K1</ProfileReferencekey><TravelCoOrdinators><Person><FirstName>F</FirstName><DOB i:nil="true" /></Person>'
        "<Person><FirstName>G</FirstName></Person></TravelCoOrdinators></Req>"
    )
    schema = documents.request_schema("Item", "Person")
    docs = documents.read_requests(spark, write(tmp_path, "r.xml", body), "Req", schema).select(F.struct("*").alias("doc"))
    people = payloads.flatten_coordinators(docs, "doc", "Person", ["ProfileReferencekey", "Address2"]).orderBy("position").collect()
    assert [(p.ProfileReferencekey, p.Address2, p.position, p.member_FirstName, p.member_DOB) for p in people] == [
        ("K1", None, 0, "F", None),
        ("K1", None, 1, "G", None),
    ]
    phones = payloads.flatten_communications(docs, "doc", "Item", ["ProfileReferencekey"]).collect()
    assert [(p.position, p.PhoneNumber) for p in phones] == [(0, "1")]
    times = docs.select(payloads.time_or_null(F.col("doc.EffectiveFrom")).alias("a"), payloads.time_or_null(F.col("doc.EnrollmentDate")).alias("b"))
    assert times.first() == (None, dt.datetime(2023, 2, 11, 10, 25, 41, 765432))


def test_response_document_file(spark, tmp_path):
    body = (
        '{"validationCode": "V", "productCode": "P", "pageNumber": 1, "pageSize": 999999999, "contactDetails": [\n'
        '{"title": "", "dob": "0001-01-01T00:00:00", "passportExpiryDate": "2020-01-01T00:00:00", "emailID": "", "isSMEAdmin": "Y", "isProgramAdmin": "N"},\n'
        '{"title": "MR", "dob": "1980-01-02T00:00:00", "passportExpiryDate": null, "emailID": "e", "isSMEAdmin": "N", "isProgramAdmin": "N"}],\n'
        '"errors": null, "action": "N", "validationErrors": null}'
    )
    pages = documents.read_responses(spark, write(tmp_path, "r.json", body), one_per_line=False).select(F.struct("*").alias("doc"))
    contacts = payloads.explode_contacts(pages, "doc", ["pageSize"])
    rows = contacts.orderBy("position").collect()
    assert [(r.page_pageSize, r.title, r.dob, r.emailID) for r in rows] == [
        (999999999, None, None, None),
        (999999999, "MR", dt.datetime(1980, 1, 2), "e"),
    ]
    profile = {r.isSMEAdmin: r for r in payloads.contact_profile(contacts, dt.date(2020, 1, 2)).collect()}
    assert (profile["Y"].contacts, profile["Y"].blank_emails, profile["Y"].expired_passports) == (1, 1, 1)
    assert profile["N"].expired_passports == 0
    none = payloads.contact_profile(contacts, dt.date(2020, 1, 1)).agg(F.sum("expired_passports")).first()[0]
    assert none == 0


def test_answers_go_to_the_last_open_request(spark):
    t0 = dt.datetime(2023, 5, 6, 7, 0)
    at = lambda n: t0 + dt.timedelta(seconds=n)
    requests = [(1, "A", "[1]", at(0)), (2, "A", "[1]", at(10)), (3, "A", "[2]", at(5)), (4, "B", None, at(1)), (5, "B", None, at(1)), (6, None, "[1]", at(0)), (7, "C", "[1]", at(9)), (8, "A", "[1]", at(40))]
    answers = [
        ("A", "[1]", at(12), "second"), ("A", "[1]", at(13), "first"), ("A", "[1]", at(14), "stray"), ("A", "[2]", at(5), "same moment"),
        ("B", None, at(2), "b"), (None, "[1]", at(3), "no key"), ("C", "[1]", at(1), "before"), ("A", "[1]", at(50), "third"),
    ]
    found = payloads.answers_in_order(
        spark.createDataFrame(requests, "request_id LONG, reference STRING, thread_id STRING, at TIMESTAMP_NTZ"),
        spark.createDataFrame(answers, "reference STRING, thread_id STRING, at TIMESTAMP_NTZ, status STRING"),
    )
    got = {r.request_id: r.status for r in found.collect()}
    assert len(got) == 8 and {k: v for k, v in got.items() if k not in (4, 5)} == {1: "first", 2: "second", 3: "same moment", 6: None, 7: None, 8: "third"}
    assert sorted([got[4], got[5]], key=str) == [None, "b"]


def test_answers_in_order_against_a_stack(spark):
    draw = random.Random(4)
    requests, answers, want = [], [], {}
    for key in range(60):
        open_requests = []
        for second in range(draw.randrange(12)):
            if draw.random() < 0.5:
                requests.append((len(requests), f"K{key}", "[1]", dt.datetime(2023, 1, 1, 0, 0, second)))
                open_requests.append(requests[-1][0])
            else:
                answers.append((f"K{key}", "[1]", dt.datetime(2023, 1, 1, 0, 0, second), f"s{len(answers)}"))
                if open_requests:
                    want[open_requests.pop()] = answers[-1][3]
    found = payloads.answers_in_order(
        spark.createDataFrame(requests, "request_id LONG, reference STRING, thread_id STRING, at TIMESTAMP_NTZ"),
        spark.createDataFrame(answers, "reference STRING, thread_id STRING, at TIMESTAMP_NTZ, status STRING"),
    )
    assert {r.request_id: r.status for r in found.collect()} == {r[0]: want.get(r[0]) for r in requests}


def test_top_frames_are_exact(spark):
    draw = random.Random(8)
    rows = [(draw.choice(["a", "b", None]), f"f{min(int(draw.expovariate(0.02)), 400)}") for _ in range(5000)] + [("flat", f"g{n}") for n in range(300)] + [("few", "h"), ("few", None)]
    df = spark.createDataFrame(rows, "kind STRING, frame STRING").repartition(5)
    counts = {}
    for kind, frame in rows:
        if frame:
            counts.setdefault(kind, Counter())[frame] += 1
    want = {kind: sorted(((-n, f) for f, n in held.items()))[:4] for kind, held in counts.items()}
    for items in (16, 64, 1024):  # a small sketch leaves groups uncertain, which are then counted whole
        got = {}
        for r in payloads.top_frames(df, "kind", "frame", 4, items).orderBy("rank").collect():
            got.setdefault(r.kind, []).append((-r.records, r.frame))
        assert got == want


def test_one_line_page_is_cut_at_element_borders(spark, tmp_path):
    contacts = []
    for n in range(3000):
        odd = ["plain", 'a},{b', 'quote " inside', "back\\slash", 'all \\"},{"', "é},{ 日"][n % 6]
        contacts.append({"title": "MR", "lastName": odd, "firstName": f"F{n}", "pageNumber": n, "emailID": ""})
    page = {"validationCode": "V", "productCode": "P", "pageNumber": 1, "pageSize": 999999999, "contactDetails": contacts, "errors": "x},{y", "action": "N", "validationErrors": None}
    texts = {"large": page, "one": {**page, "contactDetails": contacts[:1]}, "none": {**page, "contactDetails": []}, "null": {**page, "contactDetails": None}}
    for name, doc in texts.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, separators=(",", ":"), ensure_ascii=False) + "\r\n", encoding="utf-8")
    settings = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        assert spark.read.text(f"{tmp_path}/large.json", lineSep=documents.PAGE_SEPARATOR).where("length(value) > 0").groupBy(F.spark_partition_id()).count().count() > 5
        rows = documents.read_large_pages(spark, str(tmp_path)).collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    got = {}
    for r in rows:
        got.setdefault(r.file.rsplit("/", 1)[1][:-5], []).append(r)
    for name, doc in texts.items():
        held = sorted(got[name], key=lambda r: r.position)
        want = doc["contactDetails"] or [None]
        assert [r.position for r in held] == list(range(len(want)))
        for r, contact in zip(held, want):
            assert r.envelope.productCode == "P" and r.envelope.errors == "x},{y"
            assert (r.contact and (r.contact.lastName, r.contact.firstName, r.contact.pageNumber)) == (contact and (contact["lastName"], contact["firstName"], contact["pageNumber"]))


def test_documents_of_one_file_are_parsed_by_many_tasks(spark, folder):
    from pactlens.queries import documents as queries
    from pactlens.sources.standins import standin_tables

    tables = standin_tables(spark, folder)
    tables.folder = folder
    assert queries._requests(tables).select(F.spark_partition_id()).distinct().count() > 8


def test_responses_are_parsed_before_the_join(spark):
    text = F.concat(F.lit("<R><ProfileReferencekey>K"), F.col("id"), F.lit("</ProfileReferencekey><Status>true</Status></R>"))
    fields = payloads.response_fields(text)
    responses = spark.range(1, 4).select(*[column.alias(name) for name, column in fields.items()])
    requests = spark.range(3).select(F.concat(F.lit("K"), F.col("id")).alias("reference"))
    found = payloads.match_responses(requests, responses)
    assert sorted((r.reference, r.status) for r in found.collect()) == [("K0", None), ("K1", "true"), ("K2", "true")]
    assert "from_xml" not in found._jdf.queryExecution().executedPlan().toString()
