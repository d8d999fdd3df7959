from checks import proxy


def test_every_line_item_is_a_flight_and_a_ticket(spark, sf):
    lines = proxy.table(spark, sf, "lineitem")
    n, again = lines.count(), lines.where("l_linenumber = 3").count()
    assert proxy.flights(spark, sf).count() == proxy.tickets(spark, sf).count() == n
    assert proxy.raw_flights(spark, sf).count() == proxy.raw_tickets(spark, sf).count() == n + again


def test_raw_tables_scan_the_lines_once(spark, sf):
    plan = proxy.raw_flights(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("l_linenumber") and plan.count("lineitem.parquet") == 1
