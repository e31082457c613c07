"""The training-data operators run where the package is on the driver's path only."""

from test_shipping import alone


def test_operators_run_where_the_package_is_not(tmp_path):
    alone(tmp_path, """
for name, query in entry.queries().items():
    if name.startswith("op"):
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
""")
