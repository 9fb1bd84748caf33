"""Request documents (XML), response documents (JSON) and service logs as rows.

The readers take folders of many files; the parsers take a text column. Parsing is Spark's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scalar fields of an enrolment request, in document order.
REQUEST_FIELDS = (
    "Address1",
    "Address2",
    "Address3",
    "AddressForCommunication",
    "AddressType",
    "AddressValid",
    "City",
    "CompanyCode",
    "CompanyEmailId",
    "CompanyName",
    "ContactType",
    "Country",
    "CustomerReference",
    "CustomerStatus",
    "DealCode",
    "EffectiveFrom",
    "EffectiveTo",
    "EnrollmentDate",
    "FAX",
    "FAXCountryCode",
    "MemberCardName",
    "OLDFFPNumber",
    "POBox",
    "PassortNumber",
    "PassportExpiry",
    "PassportIssueCountry",
    "Phone1",
    "Phone2",
    "PostalOrZipcode",
    "ProfileReferencekey",
    "ProgramCode",
    "PromoCode",
    "State",
    "TierCode",
    "channel",
)

# Fields of one communication entry.
COMMUNICATION_FIELDS = (
    "ActionMode",
    "CallingCode",
    "CountryCode",
    "IsPhoneNumberChanged",
    "PhoneNumber",
    "PhoneType",
    "Preferred",
    "Valid",
)

# Fields of one travel coordinator.
COORDINATOR_FIELDS = (
    "ActionMode",
    "DOB",
    "Department",
    "EmailId",
    "FirstName",
    "Gender",
    "IDCardNumber",
    "InactivateDate",
    "InactivatedBy",
    "IsEmailIdChanged",
    "JobTitle",
    "LastName",
    "MiddleName",
    "MobileCallingCode",
    "MobileCountryCode",
    "MobileNumber",
    "Nationality",
    "PassportNumber",
    "PhoneNumber1",
    "PhoneNumber2",
    "ReasonForInactivation",
    "TVCReferenceKey",
    "Title",
    "TravelCoOrdinatorType",
    "joiningDate",
)

# Fields of one contact in a response page.
CONTACT_FIELDS = (
    "title",
    "dob",
    "nationality",
    "jobTitle",
    "passportExpiryDate",
    "passportIssuedCountry",
    "ffpNumber",
    "firstName",
    "lastName",
    "emailID",
    "passportNumber",
    "pageNumber",
    "pageSize",
    "isSMEAdmin",
    "isProgramAdmin",
    "mobileNumber",
    "callingCodeMobileNumber",
    "callingMobileCountryCode",
    "department",
    "businessPhone",
    "callingCodeBusinessPhone",
    "callingBusinessCountryCode",
    "remarks",
    "verificationCode",
    "action",
    "validationErrors",
)
CONTACT_NUMBERS = ("pageNumber", "pageSize")

# Labels of a log record, in the order they are written.
LOG_LABELS = (
    "Message",
    "Severity",
    "Machine",
    "Process Name",
    "Thread Id",
    "Exception",
    "UserName",
    "Method",
    "Identity",
    "Logger",
)
LOG_SEPARATOR = "\nTimestamp: "
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"


def _texts(names) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def request_schema(communication: str = "Communication", coordinator: str = "TravelCoordinator") -> T.StructType:
    """Schema of an enrolment request; the tags of its two repeated elements are parameters."""
    schema = _texts(REQUEST_FIELDS)
    schema = schema.add("CommunicationDetails", T.StructType([T.StructField(communication, T.ArrayType(_texts(COMMUNICATION_FIELDS)))]))
    return schema.add("TravelCoOrdinators", T.StructType([T.StructField(coordinator, T.ArrayType(_texts(COORDINATOR_FIELDS)))]))


def response_schema() -> T.StructType:
    """Schema of one page of contacts."""
    contact = T.StructType(
        [T.StructField(name, T.LongType() if name in CONTACT_NUMBERS else T.StringType()) for name in CONTACT_FIELDS]
    )
    return T.StructType(
        [
            T.StructField("validationCode", T.StringType()),
            T.StructField("productCode", T.StringType()),
            T.StructField("pageNumber", T.LongType()),
            T.StructField("pageSize", T.LongType()),
            T.StructField("contactDetails", T.ArrayType(contact)),
            T.StructField("errors", T.StringType()),
            T.StructField("action", T.StringType()),
            T.StructField("validationErrors", T.StringType()),
        ]
    )


def read_requests(spark: SparkSession, path: str, row_tag: str, schema: T.StructType | None = None) -> DataFrame:
    """Enrolment requests of all files below `path`; files are split at row tags."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema or request_schema()).load(path)


def parse_requests(text: Column, schema: T.StructType | None = None) -> Column:
    return F.from_xml(text, (schema or request_schema()).simpleString())


def read_responses(spark: SparkSession, path: str, one_per_line: bool = True) -> DataFrame:
    """Response pages: one document per line (splittable), or one document per file."""
    return spark.read.schema(response_schema()).option("multiLine", not one_per_line).json(path)


PAGE_SEPARATOR = "},{"
_QUOTED = r'"(?:[^"\\]++|\\.)*+"'


def read_large_pages(spark: SparkSession, path: str, array: str = "contactDetails") -> DataFrame:
    """Rows of pages that are one physical line each, one page per file: file, `envelope` (the page without its array), position
    and `contact`, an element.

    Such a line is cut at its element borders, so that the splits of one file are read by many tasks. Splits come as texts
    between `},{`; one that stands inside a quoted value is no border. Whether a text begins inside a value follows from the
    number of quotes before it: counted per text, summed per split, and summed over the splits of a file (a row each). Texts
    of one element are joined again; what precedes the first element and follows the last one is the envelope.
    Elements are flat objects, without blanks between them, as in the pages' schema. A page without elements keeps one row
    with a NULL element.
    """
    read = spark.read.text(path, lineSep=PAGE_SEPARATOR).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "[\\r\\n]+$", "").alias("text")
    )
    bare = F.regexp_replace("text", r"\\.", "")
    texts = read.withColumn("quotes", F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit(""))))
    per_split = texts.groupBy("file", "split").agg(F.sum("quotes").alias("split_quotes"))
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)  # a row per split
    per_split = per_split.select(F.col("file").alias("s_file"), F.col("split").alias("s_split"), F.coalesce(F.sum("split_quotes").over(earlier), F.lit(0)).alias("quotes_before"))
    inside = W.partitionBy("file", "split").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    opened = texts.join(per_split, (F.col("file") == F.col("s_file")) & (F.col("split") == F.col("s_split")))
    opened = opened.withColumn("starts", ((F.col("quotes_before") + F.coalesce(F.sum("quotes").over(inside), F.lit(0))) % 2 == 0).cast("long"))
    # A text that begins outside a value begins an element; numbers of elements are summed in the same two steps.
    by_split = opened.groupBy("file", "split").agg(F.sum("starts").alias("split_starts"))
    by_split = by_split.select(F.col("file").alias("e_file"), F.col("split").alias("e_split"), F.coalesce(F.sum("split_starts").over(earlier), F.lit(0)).alias("starts_before"))
    upto = W.partitionBy("file", "split").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = opened.join(by_split, (F.col("file") == F.col("e_file")) & (F.col("split") == F.col("e_split")))
    numbered = numbered.withColumn("position", F.col("starts_before") + F.sum("starts").over(upto) - 1)
    parts = F.array_sort(F.collect_list(F.struct("split", "at", "text")))  # of one element
    elements = numbered.groupBy("file", "position").agg(F.array_join(F.transform(parts, lambda part: part["text"]), PAGE_SEPARATOR).alias("text"))

    # The first element comes with the head of the page, the last with its tail; one of a kind per file.
    head = rf'(?s)^(.*?"{array}"\s*:\s*\[)\s*\{{?(.*)$'
    tail = rf'(?s)^((?:[^"{{}}\[\]]++|{_QUOTED})*+)\}}?\s*(\].*)$'
    last = elements.groupBy("file").agg(F.max("position").alias("last"))
    marked = elements.join(last.withColumnRenamed("file", "l_file"), F.col("file") == F.col("l_file")).drop("l_file")
    is_first, is_last = F.col("position") == 0, F.col("position") == F.col("last")
    found = F.regexp_extract("text", head, 1)
    cut = marked.withColumn("head", F.when(is_first, F.when(found != "", found).otherwise(F.col("text")))).withColumn("text", F.when(is_first, F.regexp_extract("text", head, 2)).otherwise(F.col("text")))
    cut = cut.withColumn("tail", F.when(is_last, F.regexp_extract("text", tail, 2))).withColumn("text", F.when(is_last, F.regexp_extract("text", tail, 1)).otherwise(F.col("text")))
    contact = response_schema()["contactDetails"].dataType.elementType
    rows = cut.select("file", "position", "head", "tail", F.when(F.trim("text") != "", F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), contact)).alias("contact"))
    envelopes = rows.groupBy("file").agg(F.from_json(F.concat(F.max("head"), F.max("tail")), response_schema()).alias("envelope"))
    named = envelopes.withColumnRenamed("file", "p_file")
    return rows.join(named, F.col("file") == F.col("p_file")).select("file", "envelope", F.col("position").cast("int").alias("position"), "contact")


def parse_responses(text: Column) -> Column:
    return F.from_json(text, response_schema())


def read_log_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with column `record`; lines that follow a record's first line stay with it.

    The separator is not part of a record, so a record starts with its time. What precedes the first
    separator of a file (a record without a time) is kept.
    """
    records = spark.read.text(path, lineSep=LOG_SEPARATOR)
    text = F.regexp_replace(F.regexp_replace("value", "\\r", ""), "^Timestamp: |\\n+$", "")
    return records.select(text.alias("record")).where(F.trim("record") != "")


def log_fields(record: Column) -> dict[str, Column]:
    """The labelled fields of a record; a field that is missing (a headless or cut-off record) is NULL."""

    def blank_as_null(column: Column) -> Column:
        return F.nullif(F.trim(column), F.lit(""))

    stamp = F.regexp_extract(record, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})", 1)
    fields = {"timestamp": F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit(LOG_TIME_FORMAT)).cast("timestamp_ntz")}
    for position, label in enumerate(LOG_LABELS):
        following = "|".join(LOG_LABELS[position + 1 :])
        end = rf"(?=\s(?:{following}):|$)" if following else "$"
        pattern = rf"(?s)(?:^|\s){label}:(.*?){end}"
        fields[label.lower().replace(" ", "_")] = blank_as_null(
            F.regexp_replace(F.regexp_extract(record, pattern, 1), r"^\s+|\s+$", "")
        )
    return fields
