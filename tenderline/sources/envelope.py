"""Provider envelopes: one page of JSON text a row -> items, totals and errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "map<string,string>"
OK = "00"


def items_of(page: Column) -> Column:
    """The items of a page as an array of maps of text: a list, a list or one object under ``item``, or nothing."""
    node = F.get_json_object(page, "$.response.body.items")
    inner = F.get_json_object(page, "$.response.body.items.item")
    one = F.coalesce(F.when(F.trim(node).startswith("["), node), inner)
    as_list = F.from_json(F.when(F.trim(one).startswith("["), one), f"array<{ITEM}>")
    as_one = F.array(F.from_json(F.when(F.trim(one).startswith("{"), one), ITEM))
    return F.coalesce(as_list, F.when(F.trim(one).startswith("{"), as_one), F.array().cast(f"array<{ITEM}>"))


# Where a result header may stand.
HEADERS = ("$.response.header", "$['nkoneps.com.response.ResponseError'].header")
COMMON = "$.OpenAPI_ServiceResponse.cmmMsgHeader"


def page_error(page: Column) -> Column:
    """(code, message) of a page that reports an error or lacks its parts; null for a good page."""
    code = F.coalesce(*(F.get_json_object(page, f"{h}.resultCode") for h in HEADERS), F.get_json_object(page, f"{COMMON}.returnReasonCode"))
    message = F.coalesce(*(F.get_json_object(page, f"{h}.resultMsg") for h in HEADERS), F.get_json_object(page, f"{COMMON}.returnAuthMsg"), F.get_json_object(page, f"{COMMON}.errMsg"))
    total = F.get_json_object(page, "$.response.body.totalCount")
    kind = (
        F.when(F.try_parse_json(page).isNull(), F.struct(F.lit("json").alias("code"), F.lit("the page is not JSON").alias("message")))
        .when(code.isNull(), F.struct(F.lit("envelope").alias("code"), F.lit("no result header").alias("message")))
        .when(code != OK, F.struct(code.alias("code"), F.coalesce(message, F.lit("")).alias("message")))
        .when(F.get_json_object(page, "$.response.body").isNull(), F.struct(F.lit("envelope").alias("code"), F.lit("no body").alias("message")))
        .when(~F.coalesce(total.rlike(r"^\d+$"), F.lit(False)), F.struct(F.lit("envelope").alias("code"), F.lit("totalCount is not a whole number").alias("message")))
    )
    return kind


def parsed_pages(pages: DataFrame, page: str = "page") -> DataFrame:
    """The pages' columns with items, total_count and error."""
    p = F.col(page)
    return pages.withColumns({"items": items_of(p), "total_count": F.get_json_object(p, "$.response.body.totalCount").try_cast("bigint"), "error": page_error(p)})


def exploded(pages: DataFrame, page: str = "page") -> DataFrame:
    """One row for each item of the good pages: the pages' other columns, item_no and row (a map of text)."""
    good = parsed_pages(pages, page).where("error is null")
    rest = [c for c in pages.columns if c != page]
    return good.select(*rest, F.posexplode("items").alias("item_no", "row"))
