"""The search with one parameter at a time, against its SQL, and properties of its pages."""

import datetime as dt
from collections import Counter

import pytest

from compare import normal
from pactlens.plans import search
from pactlens.plans.search import PagedSearch, SearchRequest, header_candidates, page_rows, search_agreements
from pactlens.queries.measuring import AS_OF_DATE, NOT_SOTO_SQL, period_sql, search_sql
from pactlens.queries.registry import portable, with_standins
from pactlens.schemas import SEARCH_COLUMNS, TABLES
from pactlens.sources.standins import SPARK, standin_sql, standin_tables
from pactlens.sources.tables import AgreementTables

BASE = {
    "product_code": "MAGIQ",
    "customer_type": "CORP",
    "soto_ind": "N",
    "created_from": dt.date(1995, 1, 1),
    "inc_from": dt.date(1995, 1, 1),
    "page_size": 1_000_000,
    "currency_code": "C0",
    "as_of": AS_OF_DATE,
}
BASE_SQL = f"""h.customer_type = 'CORP' AND {NOT_SOTO_SQL} AND {period_sql('1995-01-01', '9999-12-31')}
    AND CAST(h.created_date AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2099-12-31'"""

APPROVED_SQL = """EXISTS (SELECT 1 FROM wf_approval_history w JOIN inc_agreement_group x ON w.wf_request_id = x.workflow_id
    WHERE x.inc_hdr_id = h.inc_hdr_id AND w.actioned_by = 'U7' AND w.action_code = 'APPROVE' AND w.status = 'APPROVED')"""

CASES = {
    "deal": (
        {"deal_code": "D12"},
        "EXISTS (SELECT 1 FROM inc_associated_accounts x WHERE x.inc_hdr_id = h.inc_hdr_id AND x.deal_code = 'D12')",
    ),
    "approved_by_me": ({"approved_by_me": "Y", "user_name": "U7"}, APPROVED_SQL),
    "territory_and_name": (
        {"location_type": "TERRITORY", "country": "T1,T2", "incentive_name": "i", "source": "F"},
        """h.incentive_city IN (SELECT location_code FROM location_hierarchy WHERE territory_code IN ('T1', 'T2'))
            AND upper(h.inc_name) LIKE '%I%' AND h.source_type = 'F'""",
    ),
    "requested_by_me": (
        {"requested_by_me": "Y", "user_name": "U7", "group_status": "ACTIVE,CLOSED", "promo_code": "P3"},
        "h.created_by = 'U7' AND g.status IN ('ACTIVE', 'CLOSED') AND coalesce(h.promo_code, '##') = 'P3'",
    ),
}


@pytest.fixture(scope="module")
def tables(spark, folder):
    return standin_tables(spark, folder)


@pytest.mark.parametrize("case", sorted(CASES))
def test_one_parameter(tables, duck, case):
    parameters, where = CASES[case]
    result = portable(search_agreements(tables, SearchRequest(**{**BASE, **parameters})))
    cursor = duck.execute(with_standins(search_sql("MAGIQ", f"{BASE_SQL} AND {where}", "TRUE")))
    columns, rows = normal(result.columns, [tuple(row) for row in result.collect()])
    assert rows
    assert (columns, rows) == normal([item[0] for item in cursor.description], cursor.fetchall())


def test_requests_without_result_set(tables):
    for parameters in ({"incentive_id": 5}, {"is_product_level": "Y"}, {"product_code": None}):
        result = search_agreements(tables, SearchRequest(**{**BASE, **parameters}))
        assert tuple(result.columns) == SEARCH_COLUMNS and result.count() == 0


@pytest.mark.parametrize(
    "parameters", [{"soto_ind": None}, {"requested_by_me": "N"}, {"approved_by_me": "N"}, {"page_number": 10_000, "page_size": 50}]
)
def test_requests_that_match_nothing(tables, parameters):
    assert page_rows(tables, SearchRequest(**{**BASE, **parameters})).count() == 0


def test_empty_result_has_all_columns(tables):
    result = search_agreements(tables, SearchRequest(**{**BASE, "soto_ind": None}))
    assert tuple(result.columns) == SEARCH_COLUMNS and len(SEARCH_COLUMNS) == 111
    assert result.count() == 0


def test_pages_partition_all_rows(tables):
    narrow = {**BASE, "product_code": "OTHER"}
    key = ["rnk", "agreement_group_id", "add_hdr_id", "miles_expiry_date"]
    everything = page_rows(tables, SearchRequest(**narrow)).select(*key).collect()
    size = len(everything) // 2
    parts = []
    for number in (1, 2, 3):
        parts += page_rows(tables, SearchRequest(**{**narrow, "page_number": number, "page_size": size})).select(*key).collect()
    assert size and sorted(map(str, parts)) == sorted(map(str, everything))


def test_result_from_parquet_tables_and_pushdown(spark, tables, folder, tmp_path):
    needed = set(TABLES) - {"amendment_request", "amendment_request_aud", "gen_error_code", "lead_header"}
    for name in needed & set(standin_sql(SPARK)):
        getattr(tables, name).write.parquet(f"{tmp_path}/{name}")
    stored = AgreementTables.from_parquet(spark, str(tmp_path), clean=True)
    request = SearchRequest(**{**BASE, "product_code": "PLB", "page_size": 40})
    got = search_agreements(stored, request)
    want = search_agreements(tables, request)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = header_candidates(stored, request).select("inc_hdr_id")._jdf.queryExecution().executedPlan().toString()
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    for text in ("EqualTo(sales_product_code,PLB)", "EqualTo(customer_type,CORP)", "GreaterThanOrEqual(created_date"):
        assert text in pushed
    assert "promo_code" not in pushed.split("ReadSchema")[1]


def test_later_pages_count_nothing(spark, tables, monkeypatch):
    """Page 2 of a request reuses the rank index of page 1."""
    counted = []
    original = search.rank_of_values
    monkeypatch.setattr(search, "rank_of_values", lambda *args: counted.append(1) or original(*args))
    request = SearchRequest(**{**BASE, "product_code": "OTHER", "page_size": 40})
    pages = PagedSearch(tables, request)
    first, second = pages.page(1).collect(), pages.page(2).collect()
    assert len(counted) == 1 and first and second
    for number, got in ((1, first), (2, second)):
        want = search_agreements(tables, SearchRequest(**{**BASE, "product_code": "OTHER", "page_size": 40, "page_number": number}))
        assert sorted(map(str, got)) == sorted(map(str, want.collect()))
    assert PagedSearch(tables, SearchRequest(**{**BASE, "incentive_id": 5})).page(1).count() == 0


def test_each_table_of_the_rule_chain_is_read_once(tables):
    """Rules, periods, slabs and what-ifs of a page: one read each, for header and group facts together."""
    read = Counter()

    def load(name):
        read[name] += 1
        return getattr(tables, name)

    class Counted:
        spark = tables.spark

        def __getattr__(self, name):
            return load(name)

    counted = Counted()
    request = SearchRequest(**{**BASE, "product_code": "PLB", "page_size": 40})
    page = page_rows(tables, request)
    chain = search.rule_chain(counted, search.PageScope(page), with_groups=True)
    search.header_facts(tables, search.PageScope(page), chain, tables.inc_agreement_group)
    search.group_facts(tables, search.PageScope(page), chain)
    assert {name: read[name] for name in ("inc_rule_comp_hdr", "inc_rule_comp_period", "inc_rule_comp_value", "inc_rule_comp_whatif", "inc_models", "inc_types", "inc_payout_types")} == dict.fromkeys(
        ("inc_rule_comp_hdr", "inc_rule_comp_period", "inc_rule_comp_value", "inc_rule_comp_whatif", "inc_models", "inc_types", "inc_payout_types"), 1
    )
    rules = {r.rule_comp_hdr_id for r in chain.rules.collect()}
    headers = {r.inc_hdr_id for r in page.collect()}
    assert {r.rule_comp_hdr_id for r in chain.of_headers.collect()} == {r.rule_comp_hdr_id for r in tables.inc_rule_comp_hdr.collect() if r.rule_header_id in headers}
    assert rules >= {r.rule_comp_hdr_id for r in chain.whatifs.collect()}
