"""Small series used by several tests."""

from datetime import date, timedelta

from shelfcast.schemas import Protocol

START, END, ORIGIN = date(2009, 12, 1), date(2011, 1, 28), date(2011, 1, 1)
ONE_ORIGIN = Protocol(forecast_starts=(ORIGIN,), expanding_start=START)


def day_list(start=START, end=END):
    return [start + timedelta(days=i) for i in range((end - start).days + 1)]


def grid_of(spark, values, product="example", start=START):
    data = [(product, start + timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "product_id string, date date, units double")


def repeating(n=len(day_list())):
    return [float(i % 7 + 1) for i in range(n)]
