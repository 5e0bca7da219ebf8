"""Provider rows (maps of text) -> canonical contract rows and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import amount_loose, amount_strict, amount_unsigned, delivery_amount, first_non_negative, whole_number
from ..functions.dates import delivery_date, lenient_date, strict_date
from ..functions.identity import contract_key, delivery_id, delivery_number, group_key, item_codes, item_names, numbered_row_hash
from ..functions.text import business_number, canonical_text, category, compact_text, digits, display_number, first_agency, first_non_blank, first_text, supplier_list, text_or_empty, trimmed

# The provider's field names, each list in order of priority, and labels that localized keys contain.
NUMBER_FIELDS = ["bizno", "bizrno", "cntrctCorpBizno", "cntrctEntrpsBizno", "bidwinnrBizrno", "corpBizno", "rprsntCorpBizrno"]
NUMBER_LABEL = "사업자등록번호"
NAME_FIELDS = ["cntrctCorpNm", "cntrctEntrpsNm", "bidwinnrNm", "corpNm", "rprsntCorpNm"]
DATE_FIELDS = ["cntrctCnclsDate", "cntrctDate", "cntrctDt"]
CONTRACT_NAME_FIELDS = ["cntrctNm", "prodNm", "prdlstNm"]
TOTAL_FIELDS = ["totCntrctAmt", "ttalCntrctAmt", "cntrctAmt", "cntrctPrce"]
CURRENT_FIELDS = ["thtmCntrctAmt", "currCntrctAmt", "cntrctAmt", "cntrctPrce"]
NO_FIELDS = ["dcsnCntrctNo", "cntrctNo", "cntrctRefNo"]
ORIGINAL_FIELDS = ["frstCntrctDate", "firstContractDate", "orgnlCntrctDate", "originalContractDate"]
ORDER_FIELDS = ["cntrctOrd", "contractOrder", "cntrctChgOrd", "contractChangeOrder"]
AGENCY_NAME_FIELDS = ["dminsttNm", "dmndInsttNm", "demandInsttNm", "demandAgencyName"]
AGENCY_CODE_FIELDS = ["dminsttCd", "dmndInsttCd", "demandInsttCd", "demandAgencyCode"]
CONTRACT_AGENCY_NAME_FIELDS = ["cntrctInsttNm", "contractInsttNm", "contractAgencyName"]
CONTRACT_AGENCY_CODE_FIELDS = ["cntrctInsttCd", "contractInsttCd", "contractAgencyCode"]
METHOD_FIELDS = ["cntrctMthdNm", "cntrctCnclsMthdNm", "contractMthdNm", "contractMethod"]
TYPE_FIELDS = ["cntrctCnclsSttusNm", "contractConclusionStatusName", "contractType"]
NOTICE_FIELDS = ["bidNtceNo", "ntceNo", "noticeNo"]
DETAIL_URL_FIELDS = ["cntrctDtlInfoUrl", "cntrctInfoUrl", "cntrctDetailUrl", "contractDetailUrl", "dtlInfoUrl", "detailUrl"]
NOTICE_URL_FIELDS = ["bidNtceDtlUrl", "bidNtceDetailUrl", "bidNtceUrl", "noticeDetailUrl"]
CODE_FIELDS = ["dtilPrdctClsfcNo", "detailItemCode", "itemCode"]
ITEM_NAME_FIELDS = ["prodNm", "prdlstNm"]
AMOUNT_FIELDS = ["corpCntrctAmt", "supplierContractAmount", "participationAmount", "participAmt", "shareAmount", "cntrctAmt"]
RATE_FIELDS = ["corpShareRate", "supplierRate", "participationRate", "participRate", "shareRate", "cntrctShrRt"]
LABELS = {"name": ["업체명"], "representative": ["대표자명"], "date": ["계약체결일자", "계약일자"], "contract": ["계약명", "품명"], "total": ["총계약금액", "계약금액", "금액"], "current": ["금액"], "address": ["주소"], "detail": ["상세"], "notice": ["공고", "상세"]}
THIRD_PARTY, UNIT_PRICE, DELIVERY = "제3자단가", "제3자단가계약", "납품요구"
STANDARD_DATASET, DELIVERY_DATASET = "public-standard-contract", "third-party-delivery"


def lookup_rows(items: DataFrame, numbers: DataFrame, row: str = "row", carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, failures): a canonical row for each item and requested number that it names, with the items' columns in ``carry``; items that
    lack a required field, with the reason.

    Items meet numbers by the numbers that they hold, an equi-join, not by trying every pair.
    """
    r = F.col(row)
    by_key = F.transform(F.map_values(F.map_filter(r, lambda k, v: k.isin(NUMBER_FIELDS) | F.contains(k, F.lit(NUMBER_LABEL)))), lambda v: business_number(F.coalesce(v, F.lit(""))))
    held = F.array_distinct(F.array_compact(F.concat(by_key, F.transform(supplier_list(r["corpList"]), lambda s: s["biz_no"]))))
    each = items.withColumn("biz_no", F.explode(held)).join(numbers.select("biz_no").distinct(), "biz_no")
    own = F.get(F.filter(supplier_list(r["corpList"]), lambda s: s["biz_no"] == F.col("biz_no")), F.lit(0))
    agency = first_agency(r["dminsttList"])
    pick = lambda keys, label=None: first_non_blank(r, keys, LABELS[label] if label else None)
    name = F.coalesce(pick(NAME_FIELDS, "name"), own["name"])
    day, title = strict_date(pick(DATE_FIELDS, "date")), pick(CONTRACT_NAME_FIELDS, "contract")
    detail, notice = pick(DETAIL_URL_FIELDS[:1], "detail"), pick(NOTICE_URL_FIELDS[:1], "notice")
    missing = F.concat_ws(", ", F.when(name.isNull(), "business_name"), F.when(day.isNull(), "contract_date"), F.when(title.isNull(), "contract_name"))
    out = each.withColumn("_missing", missing)
    rows = out.where("_missing = ''").select(
        *carry, F.lit(STANDARD_DATASET).alias("source_dataset"), numbered_row_hash(r, F.col("biz_no")).alias("source_row_hash"), F.col("biz_no").alias("biz_no_normalized"), display_number(F.col("biz_no")).alias("biz_no_display"),
        name.alias("business_name"), F.coalesce(pick(["rprsntCorpCeoNm"], "representative"), own["representative"]).alias("representative_name"), pick(["addr", "adres", "corpAddr", "rprsntCorpAdrs"], "address").alias("address"),
        category(pick(["bsnsDivNm", "businessCategory"])).alias("business_category"), pick(["ntceNo", "bidNtceNo"]).alias("notice_no"), pick(["bidNtceOrd"]).alias("notice_order"), pick(["bidNtceNm"]).alias("notice_name"),
        pick(NO_FIELDS).alias("contract_no"), pick(["untyCntrctNo"]).alias("unified_contract_no"), title.alias("contract_name"), day.alias("contract_date"),
        amount_strict(pick(CURRENT_FIELDS, "current")).alias("current_contract_amount"), amount_strict(pick(TOTAL_FIELDS, "total")).alias("total_contract_amount"),
        F.coalesce(pick(AGENCY_CODE_FIELDS[:2]), agency["code"]).alias("demand_agency_code"), F.coalesce(pick(AGENCY_NAME_FIELDS[:2]), agency["name"]).alias("demand_agency_name"),
        pick(["cntrctInsttCd"]).alias("contract_agency_code"), pick(["cntrctInsttNm"]).alias("contract_agency_name"), pick(METHOD_FIELDS[:2]).alias("contract_method"), pick(["bidwinrDcsnMthdNm"]).alias("winning_method"),
        name.alias("business_name_at_contract"), detail.alias("contract_detail_url"), notice.alias("notice_detail_url"), F.coalesce(detail, notice).alias("raw_source_url"),
    )
    return rows, out.where("_missing != ''").select("biz_no", row, F.concat(F.lit("missing "), "_missing").alias("reason"))


def suppliers_of(row: Column) -> Column:
    """Suppliers of a row, distinct by number and name: those of the list with a number, then the direct number fields, each with the first direct name."""
    listed = F.transform(supplier_list(row["corpList"]), lambda s: F.struct(s["biz_no"].alias("biz_no"), F.coalesce(s["name"], F.lit("")).alias("name"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("double").alias("rate")))
    # A list of objects carries amounts and shares too.
    objects = F.from_json(row["corpList"], "array<map<string,string>>")
    known = F.transform(
        F.coalesce(objects, F.array().cast("array<map<string,string>>")),
        lambda m: F.struct(business_number(first_text(m, ["bizno", "bizrno", "corpBizno", "rprsntCorpBizrno"])).alias("biz_no"), first_text(m, ["corpNm", "rprsntCorpNm", "cntrctCorpNm"]).alias("name"), first_non_negative(m, AMOUNT_FIELDS).alias("amount"), first_non_negative(m, RATE_FIELDS).alias("rate")),
    )
    direct = F.array(*(F.struct(business_number(F.coalesce(row[k], F.lit(""))).alias("biz_no"), first_text(row, NAME_FIELDS).alias("name"), F.lit(None).cast("double").alias("amount"), F.lit(None).cast("double").alias("rate")) for k in NUMBER_FIELDS))
    from_list = F.when(objects.isNotNull(), known).otherwise(listed)
    return F.array_distinct(F.filter(F.concat(from_list, direct), lambda s: s["biz_no"].isNotNull()))


def projections(items: DataFrame, row: str = "row") -> DataFrame:
    """One projection a provider row, whoever its suppliers are: the items' columns and the contract's."""
    r = F.col(row)
    text = lambda keys, default="": first_text(r, keys, default)
    total = amount_loose(text(TOTAL_FIELDS))
    current = amount_loose(text(CURRENT_FIELDS))
    names = item_names(*(r[k] for k in ITEM_NAME_FIELDS))
    no, notice, url = canonical_text(text(NO_FIELDS)), canonical_text(text(NOTICE_FIELDS)), canonical_text(text(DETAIL_URL_FIELDS))
    agency, contract_agency, title = (canonical_text(text(k)) for k in (AGENCY_NAME_FIELDS, CONTRACT_AGENCY_NAME_FIELDS, CONTRACT_NAME_FIELDS))
    key = contract_key(no, notice, url, canonical_text(text(DATE_FIELDS)), agency, contract_agency, title, canonical_text(F.array_join(F.array_sort(names), "\n")), canonical_text(text(METHOD_FIELDS)), canonical_text(text(TYPE_FIELDS)), total.cast("string"))
    original = lenient_date(text(ORIGINAL_FIELDS))
    return items.select(
        "*", F.lit(STANDARD_DATASET).alias("source_dataset"), key["kind"].alias("contract_key_kind"), key["key"].alias("contract_key"), group_key(key["kind"], key["key"], original, notice, title, agency, contract_agency).alias("contract_group"), suppliers_of(r).alias("suppliers"), text(CONTRACT_NAME_FIELDS, "-").alias("contract_name"),
        names.alias("item_names"), item_codes(F.array(*(F.coalesce(r[k], F.lit("")) for k in CODE_FIELDS))).alias("item_codes"), lenient_date(text(DATE_FIELDS)).alias("contract_date"), original.alias("original_contract_date"),
        whole_number(text(ORDER_FIELDS)).alias("amendment_order"), F.when(current != 0, current).otherwise(total).alias("current_contract_amount"), total.alias("total_contract_amount"),
        text(AGENCY_NAME_FIELDS, "-").alias("demand_agency_name"), text(AGENCY_CODE_FIELDS).alias("demand_agency_code"), text(CONTRACT_AGENCY_NAME_FIELDS, "-").alias("contract_agency_name"), text(CONTRACT_AGENCY_CODE_FIELDS).alias("contract_agency_code"),
        text(METHOD_FIELDS, "-").alias("contract_method"), F.nullif(text(TYPE_FIELDS), F.lit("")).alias("contract_type"), text(NO_FIELDS).alias("contract_no"), text(NOTICE_FIELDS).alias("notice_no"), text(DETAIL_URL_FIELDS).alias("contract_detail_url"), text(NOTICE_URL_FIELDS).alias("notice_detail_url"),
    )


def delivery_details(items: DataFrame, numbers: DataFrame, row: str = "row", carry: tuple[str, ...] = ()) -> DataFrame:
    """Third-party unit-price delivery details of the requested numbers as canonical rows, with the items' columns in ``carry``; rows that lack a required field fall away."""
    r = F.col(row)
    pick = lambda *keys: first_non_blank(r, list(keys))
    each = items.withColumn("biz_no", business_number(F.coalesce(r["cntrctCorpBizno"], F.lit("")))).join(numbers.select("biz_no").distinct(), "biz_no")
    amount = delivery_amount(pick("prdctAmt", "dlvrReqAmt"), pick("incdecAmt"))
    out = each.where(F.contains(pick("cntrctCnclsStleNm"), F.lit(THIRD_PARTY))).select(
        *carry, F.lit(DELIVERY_DATASET).alias("source_dataset"), numbered_row_hash(r, F.col("biz_no")).alias("source_row_hash"), F.col("biz_no").alias("biz_no_normalized"), display_number(F.col("biz_no")).alias("biz_no_display"),
        pick("corpNm").alias("business_name"), pick("dminsttRgnNm").alias("address"), F.lit("shopping_third_party").alias("business_category"), pick("dlvrReqNm").alias("notice_name"), pick("dlvrReqNo").alias("contract_no"),
        delivery_number(pick("dlvrReqNo"), pick("dlvrReqChgOrd"), pick("prdctSno")).alias("unified_contract_no"), pick("prdctIdntNoNm", "dtilPrdctClsfcNoNm", "prdctClsfcNoNm", "dlvrReqNm").alias("contract_name"),
        strict_date(pick("dlvrReqRcptDate", "IntlCntrctDlvrReqDate")).alias("contract_date"), amount.alias("current_contract_amount"), amount.alias("total_contract_amount"), pick("dminsttCd").alias("demand_agency_code"),
        pick("dminsttNm").alias("demand_agency_name"), pick("brnofceNm").alias("contract_agency_name"), pick("cntrctCnclsStleNm").alias("contract_method"),
    )
    return out.where("business_name is not null and contract_date is not null and contract_name is not null and contract_no is not null")


def product_deliveries(items: DataFrame, registry: DataFrame, code: str, row: str = "row") -> DataFrame:
    """Final deliveries of one product by registered suppliers as competitor rows, one for each that the provider sends twice."""
    r = F.col(row)
    number = digits(text_or_empty(F.coalesce(r["bizno"], r["cntrctCorpBizno"])))
    keep = (compact_text(r["dtilPrdctClsfcNo"]) == code) & (compact_text(r["cntrctDivNm"]) == UNIT_PRICE) & (compact_text(r["cntrctDlvrDivNm"]) == DELIVERY) & (F.upper(compact_text(r["fnlCntrctDlvrReqChgOrdYn"])) == "Y")
    day, no, amount = delivery_date(r["cntrctDlvrReqDate"]), text_or_empty(r["cntrctDlvrReqNo"]), amount_unsigned(r["prdctAmt"])
    some = lambda c, default: F.coalesce(F.nullif(text_or_empty(c), F.lit("")), default)
    each = items.where(keep).withColumn("biz_no", number).join(F.broadcast(registry.select("biz_no")), "biz_no", "left_semi")  # a fixed number of rows
    return each.where(day.isNotNull() & (no != "") & amount.isNotNull()).select(
        delivery_id(F.col("biz_no"), no, r["cntrctDlvrReqChgOrd"], r["prdctIdntNo"], day, amount).alias("id"), "biz_no", display_number(F.col("biz_no")).alias("biz_no_display"), some(r["corpNm"], F.col("biz_no")).alias("business_name"),
        some(r["cntrctDlvrReqNm"], F.lit(f"{UNIT_PRICE} {DELIVERY}")).alias("contract_name"), F.array(F.lit(code)).alias("item_codes"), day.alias("contract_date"), amount.alias("current_contract_amount"), amount.alias("total_contract_amount"),
        text_or_empty(r["dminsttNm"]).alias("demand_agency_name"), F.lit(UNIT_PRICE).alias("contract_type"), no.alias("contract_no"), text_or_empty(r["uprcCntrctNo"]).alias("notice_no"), F.lit(DELIVERY_DATASET).alias("source_dataset"),
    ).dropDuplicates(["id"])


def combined_address(base: Column, detail: Column) -> Column:
    """Both parts, unless one holds the other at its end or its start."""
    a, b = text_or_empty(base), text_or_empty(detail)
    out = F.when(a == "", b).when(b == "", a).when(a.endswith(b), a).when(b.startswith(a), b).otherwise(F.concat_ws(" ", a, b))
    return F.nullif(out, F.lit(""))


def single_values(row: Column, fields: dict[str, list[str]]) -> list[Column]:
    """Columns of a lookup's answer, each by its list of field names."""
    return [first_non_blank(row, keys).alias(name) for name, keys in fields.items()]


def canonical_code(code: Column) -> Column:
    """A product class of eight digits stands for its first detail code."""
    d = digits(trimmed(code))
    return F.when(d == "39121801", "3912180101").otherwise(d)
