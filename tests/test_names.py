"""Names, paths and values on literals."""

import pytest
from pyspark.sql import functions as F

from spanflow.functions import scalars as S


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_service_alias(spark):
    assert column(spark, ["order-service", "Payment.Service", " Shipping Service ", ""], S.service_alias) == ["orderService", "paymentService", "shippingService", "service"]


def test_raw_operation(spark):
    raw = ["GET /v1/users/{id}", "POST /orders", "PUT /items/:sku", "DELETE /v1/a/b/", "UserService.Get", "pkg.Order/Reserve", "Inventory.Check", " custom op 42 ", ""]
    assert column(spark, raw, S.raw_operation_id) == ["getV1UsersById", "postOrders", "putItemsBySku", "deleteV1AB", "get", "reserve", "check", "customOp42", "op"]


def test_operation_id(spark):
    none = F.lit(None).cast("string")
    op = lambda c: S.operation_id(c, none, none, none, none, none)
    assert column(spark, ["GET /health", "GET /a/{x_y}/b", "do the-Thing", "PUT /"], op) == ["getHealth", "getABByXY", "doTheThing", "putRoot"]
    rpc = lambda c: S.operation_id(F.lit("x"), none, none, none, none, c)
    assert column(spark, ["Reserve_stock", ""], rpc) == ["reserveStock", "x"]


def test_url_path(spark):
    urls = ["http://h:80/a/b?q=1#f", "https://h", "/p?q", "", "plain"]
    assert column(spark, urls, S.url_path) == ["/a/b", "/", "/p?q", "", "plain"]


def test_small_helpers(spark):
    assert column(spark, ["a.b/c-d"], S.service_file_name) == ["a_b_c-d"]
    assert column(spark, ["Card-No"], S.identifier) == ["card_no"]
    assert column(spark, ["Get-It"], S.sanitized_operation) == ["getIt"]
    assert column(spark, ["a.b.c"], S.field_name) == ["c"]
    assert column(spark, ["a.b", "nope", None], lambda c: S.split_call(c)[1]) == ["b", None, None]
    assert column(spark, ["nope"], lambda c: S.split_call(c, trim=False)[1]) == [""]
    assert column(spark, ["${b.x} ${ a } ${b.x} $c"], S.variable_references) == [["a", "b.x"]]


@pytest.mark.parametrize(("http", "code", "name", "want"), [(404, 1, "x", 404), (None, 1, "CreateOrder", 201), (None, 1, "list", 200), (None, 2, "create", None)])
def test_inferred_status(spark, http, code, name, want):
    assert spark.range(1).select(S.inferred_status(F.lit(http).cast("int"), F.lit(code), F.lit(name))).first()[0] == want
