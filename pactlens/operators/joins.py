"""Joins and lookups.

No side is broadcast by hint: Spark broadcasts a lookup whose size it knows to be small, re-checks with
run-time sizes, and splits hot keys in shuffled joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens.functions.conditional import yes_no
from pactlens.functions.text import full_name, parse_list, split_list
from pactlens.operators.aggregates import latest, list_column, lowest


def with_lookup(
    df: DataFrame, lookup: DataFrame, keys: dict[str, str], value: str, name: str, order: tuple[str, ...] = ()
) -> DataFrame:
    """Left join one value per key; of several lookup rows the lowest is taken. keys: df column -> lookup column."""
    one = lookup.groupBy(*[F.col(column).alias(f"lk{n}") for n, column in enumerate(keys.values())]).agg(
        lowest(F.col(value), *[F.col(column) for column in order], F.col(value)).alias("lk_value")
    )
    condition = F.lit(True)
    for n, column in enumerate(keys):
        condition = condition & (df[column] == F.col(f"lk{n}"))
    joined = df.join(one, condition, "left").withColumn(name, F.col("lk_value"))
    return joined.drop("lk_value", *[f"lk{n}" for n in range(len(keys))])


def codes_of_type(codes: DataFrame, *types: str) -> DataFrame:
    return codes.where(F.col("code_type").isin(list(types)))


def location_address(addresses: DataFrame, cities: DataFrame, countries: DataFrame) -> DataFrame:
    """Per customer, the valid LOCATION address: city name (or raw city) and country code of the lowest one.

    The country name is the lowest among all of them, so an address in an unknown country does not hide a known one.
    """
    held = addresses.where((F.col("valid") == "Y") & (F.col("address_type") == "LOCATION"))
    named = with_lookup(held, countries, {"country_code": "country_code"}, "country_name", "found_country")
    chosen = named.groupBy("customer_profile_id").agg(
        F.min(F.struct("city", "country_code")).alias("a"), F.min("found_country").alias("address_country_name")
    )
    chosen = chosen.select(
        "customer_profile_id", F.col("a.city").alias("address_city"), F.col("a.country_code").alias("address_country"), "address_country_name"
    )
    named = with_lookup(chosen, cities, {"address_city": "city_code"}, "city_name", "known_city")
    return named.select(
        "customer_profile_id",
        F.coalesce("known_city", "address_city").alias("address_city_name"),
        "address_country",
        "address_country_name",
    )


def with_city_code(df: DataFrame, cities: DataFrame, city_name: str, country: str, name: str) -> DataFrame:
    """City code by name and country, ignoring case."""
    lookup = cities.select(F.upper("city_name").alias("cn"), F.upper("country_code").alias("cc"), "city_code")
    keyed = df.withColumn("u_city", F.upper(city_name)).withColumn("u_country", F.upper(country))
    return with_lookup(keyed, lookup, {"u_city": "cn", "u_country": "cc"}, "city_code", name).drop("u_city", "u_country")


def location_cities(hierarchy: DataFrame, level: str, codes: str | None) -> DataFrame | None:
    """City codes below a COUNTRY, REGION or TERRITORY; None for a level without a hierarchy lookup."""
    column = {"COUNTRY": "country_code", "REGION": "region_code", "TERRITORY": "territory_code"}.get(level)
    if column is None:
        return None
    return hierarchy.where(F.col(column).isin(parse_list(codes) or [])).select(F.col("location_code").alias("city_code"))


def location_scope(df: DataFrame, hierarchy: DataFrame, level: str | None, codes: str | None, soto: str | None) -> DataFrame:
    """NETWORK passes all; sold-outside agreements match by group country, others by the header's city."""
    if (level or "NETWORK") == "NETWORK":
        return df
    soto = soto or "N"
    items = parse_list(codes) or []
    if soto == "Y":
        return df.where(F.col("group_country_code").isin(items) & (F.col("master_agreement") == "N"))
    if soto == "N" and level == "CITY":
        return df.where(F.col("incentive_city").isin(items))
    cities = location_cities(hierarchy, level, codes)
    if soto != "N" or cities is None:
        return df.where(F.lit(False))
    return df.join(cities, df["incentive_city"] == cities["city_code"], "left_semi")


def left_join_spread(df: DataFrame, lookup: DataFrame, key: str, lookup_key: str, spread_by: str) -> DataFrame:
    """Left join on a key that is NULL in many rows.

    Rows without a key cannot match, so they are spread over the partitions instead of all meeting in one.
    """
    keyed = df.withColumn(
        "join_salt", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(spread_by), F.lit(4096)).cast("int")).otherwise(F.lit(-1))
    )
    # Always -1, but not a literal: a constant would be folded out of the join keys.
    salted = lookup.withColumn("lookup_salt", F.pmod(F.xxhash64(lookup_key), F.lit(1)).cast("int") - 1)
    condition = (keyed["join_salt"] == salted["lookup_salt"]) & (keyed[key] == salted[lookup_key])
    return keyed.join(salted, condition, "left").drop("join_salt", "lookup_salt", lookup_key)


HOT_SHARE = 1000  # a key with more than this part of all rows is hot


def join_hot(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join of rows to their parents by `key`, in which no key gathers in one task, whatever the session's settings.

    A count, combined on the map side, finds the keys that hold more than a thousandth of all rows: fewer than a thousand,
    so they may be broadcast. Their rows are dealt over salts in proportion to their number, their parent rows are
    copied once per salt; all other rows have one salt. Rows that are equal in all columns share a salt.
    """
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("hot_rows"))
    total = many.agg(F.count(F.lit(1))).scalar()
    hot = counts.where(F.col("hot_rows") * HOT_SHARE > total).select(
        F.col(key).alias("hot_key"), F.ceil(F.col("hot_rows") * HOT_SHARE / total).cast("int").alias("hot_salts")
    )
    dealt = many.join(F.broadcast(hot), many[key] == hot["hot_key"], "left")
    # Not a constant for usual rows: it would be folded out of the join's keys.
    dealt = dealt.withColumn("hot_salt", F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in many.columns]), F.coalesce("hot_salts", F.lit(1))).cast("int"))
    copied = one.join(F.broadcast(hot), one[key] == hot["hot_key"], "left")
    copied = copied.withColumn("hot_salt", F.explode(F.sequence(F.lit(0), F.coalesce("hot_salts", F.lit(1)) - 1)))
    return dealt.drop("hot_key", "hot_salts").join(copied.drop("hot_key", "hot_salts"), [key, "hot_salt"]).drop("hot_salt")


def left_join_hot(one: DataFrame, many: DataFrame, key: str) -> DataFrame:
    """Left join of parents to their rows, hot keys as in `join_hot`; parents without rows keep one with NULLs."""
    alone = one.join(many.select(key).distinct(), key, "left_anti")
    rest = [F.lit(None).cast(field.dataType).alias(field.name) for field in many.schema.fields if field.name != key]
    columns = [*one.columns, *[name for name in many.columns if name != key]]
    return join_hot(many, one, key).select(columns).unionByName(alone.select("*", *rest))


def header_with_parent_group(headers: DataFrame, groups: DataFrame) -> DataFrame:
    """Headers with the forecast of their parent's headline group."""
    parents = headline_groups(groups).select(
        F.col("inc_hdr_id").alias("parent_hdr_id"),
        F.col("forecast_base_rev").alias("parent_forecast"),
    )
    return left_join_spread(headers, parents, "parent_inc_id", "parent_hdr_id", "inc_hdr_id")


def headline_groups(groups: DataFrame) -> DataFrame:
    """One group per header: a master group first, then the lowest id."""
    any_id = F.col("agreement_group_id")
    master_id = F.when(F.col("master_agreement") == "Y", any_id)
    names = ("agreement_group_id", "expected_base_revenue", "forecast_base_rev")
    # Plain numbers as aggregation buffers keep this a hash aggregate; a minimum over structs would sort.
    firsts = [F.min_by(name, order).alias(f"{kind}_{name}") for name in names for kind, order in (("m", master_id), ("a", any_id))]
    chosen = [
        F.when(F.col("m_agreement_group_id").isNotNull(), F.col(f"m_{name}")).otherwise(F.col(f"a_{name}")).alias(name) for name in names
    ]
    return groups.groupBy("inc_hdr_id").agg(*firsts).select("inc_hdr_id", *chosen)


def having(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in `keys` (EXISTS / IN). Keys are reduced to distinct ones before they are shuffled."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def payout_chain(models: DataFrame, types: DataFrame, payouts: DataFrame) -> DataFrame:
    """Agreement group -> model -> type -> payout type."""
    return (
        models.join(types, "inc_model_id")
        .join(payouts, "inc_type_id")
        .select("agreement_group_id", "inc_type_id", "incentive_type", "payout_type_id", "payment_frequency_type")
    )


def rule_slabs(rules: DataFrame, periods: DataFrame, values: DataFrame) -> DataFrame:
    """Rule -> period -> value slab."""
    return rules.join(periods, "rule_comp_hdr_id").join(values, "rule_comp_period_id")


def approved_headers(approvals: DataFrame, groups: DataFrame, user_name: str) -> DataFrame:
    """Headers with a group whose workflow the user approved."""
    mine = approvals.where(
        (F.col("actioned_by") == user_name) & (F.col("action_code") == "APPROVE") & (F.col("status") == "APPROVED")
    ).select(F.col("wf_request_id").alias("workflow_id"))
    return groups.select("inc_hdr_id", "workflow_id").join(mine.distinct(), "workflow_id", "left_semi").select("inc_hdr_id").distinct()


def shrinking_headers(headers: DataFrame, rules: DataFrame, whatifs: DataFrame) -> DataFrame:
    """Ids of headers with a what-if of negative growth inside the agreement's own period.

    An inner join reduced to distinct ids, not a semi-join: Spark can then split a header that owns very many what-ifs.
    """
    negative = whatifs.where(F.col("growth_perc") < 0).join(
        rules.select("rule_comp_hdr_id", "rule_header_id"), "rule_comp_hdr_id"
    )
    inside = (
        (headers["inc_hdr_id"] == negative["rule_header_id"])
        & (negative["period_from"] >= headers["effective_from"])
        & (negative["period_to"] <= headers["effective_to"])
    )
    return negative.join(headers, inside).select("inc_hdr_id").distinct()


def user_roles(users: DataFrame, privileges: DataFrame, roles: DataFrame) -> DataFrame:
    """Active users with their active roles through active privileges."""
    active = F.col("active") == "Y"
    return (
        users.where(active)
        .select("user_id", "user_name")
        .join(privileges.where(active).select("user_id", "role_id"), "user_id")
        .join(roles.where(active).select("role_id", "role_code", "role_name"), "role_id")
    )


def names_of_code_lists(
    df: DataFrame, column: str, codes: DataFrame, code: str, value: str, name: str, separator: str, order: tuple[str, ...]
) -> DataFrame:
    """Names of the codes in a comma-separated column, as one list text.

    Each distinct list text is resolved once; rows then look their text up. Item lists are as long as
    one text of one row, so gathering them is bounded.
    """
    texts = df.where(F.col(column).isNotNull()).select(F.col(column).alias("list_text")).distinct()
    items = texts.select("list_text", F.explode(F.array_distinct(split_list(F.col("list_text")))).alias("list_code"))
    names = (
        items.join(codes, items["list_code"] == codes[code])
        .groupBy("list_text")
        .agg(list_column(F.col(value), [F.col(key) for key in order], separator).alias("list_names"))
        .withColumnRenamed("list_text", "names_key")
    )
    return df.join(names, df[column] == names["names_key"], "left").withColumn(name, F.col("list_names")).drop("names_key", "list_names")


def contact_people(contacts: DataFrame, communications: DataFrame) -> DataFrame:
    """Per customer, name of the newest program contact and portal contact, and the e-mail of the newest that has one.

    Each is a maximum by contact id, so a customer with a third of all contacts is combined on the map side.
    """
    kinds = {"cp": F.col("contact_type") == "SMEADMIN", "pa": F.col("contact_type").isin("PAADMIN", "PA")}
    relevant = contacts.where(kinds["cp"] | kinds["pa"])
    name = full_name(F.col("first_name"), F.col("last_name"))
    names = relevant.groupBy("customer_profile_id").agg(
        *[latest(name, F.when(test, F.col("contact_detail_id"))).alias(f"{kind}name") for kind, test in kinds.items()]
    )
    mails = communications.where(F.col("communication_type") == "EMAIL").select("contact_detail_id", "communication_value")

    def newest_mail(test: Column) -> Column:
        entry = F.struct((-F.col("contact_detail_id")).alias("k"), F.col("communication_value").alias("v"))
        return F.min(F.when(test, entry))["v"]

    emails = (
        relevant.join(mails, "contact_detail_id")
        .groupBy(F.col("customer_profile_id").alias("mail_customer"))
        .agg(*[newest_mail(test).alias(f"{kind}email") for kind, test in kinds.items()])
    )
    return names.join(emails, names["customer_profile_id"] == emails["mail_customer"], "left").drop("mail_customer")
