import base64

from pyspark.sql import functions as F

from lakeleaf.functions import text as T


def test_base64url_of_long_keys_has_no_line_breaks(spark):
    keys = ["", "a", "x?>" * 19, "y" * 58, "https://www.example.com/vol_5/" + "z" * 300]
    rows = spark.createDataFrame([(k,) for k in keys], "key string").select("key", T.base64url(F.col("key").cast("binary")).alias("token")).collect()
    assert {r["key"]: r["token"] for r in rows} == {k: base64.urlsafe_b64encode(k.encode()).decode().rstrip("=") for k in keys}
