"""Declared schemas (no inference) for the travel tables and request tables."""

from __future__ import annotations

from pyspark.sql import types as T

FLIGHTS = T.StructType([
    T.StructField("travelCode", T.LongType()),
    T.StructField("userCode", T.LongType()),
    T.StructField("from", T.StringType()),
    T.StructField("to", T.StringType()),
    T.StructField("flightType", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("time", T.DoubleType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("agency", T.StringType()),
    T.StructField("date", T.StringType()),
])

HOTELS = T.StructType([
    T.StructField("travelCode", T.LongType()),
    T.StructField("userCode", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("place", T.StringType()),
    T.StructField("days", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("total", T.DoubleType()),
    T.StructField("date", T.StringType()),
])

USERS = T.StructType([
    T.StructField("code", T.LongType()),
    T.StructField("company", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("age", T.IntegerType()),
])

HOTEL_CATALOGUE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("style", T.StringType()),
    T.StructField("climate", T.StringType()),
    T.StructField("star_rating", T.IntegerType()),
    T.StructField("avg_price_per_night", T.DoubleType()),
    T.StructField("review_score", T.DoubleType()),
    T.StructField("amenities", T.StringType()),
    T.StructField("travel_type", T.StringType()),
    T.StructField("bookings", T.LongType()),
])

FLIGHT_REQUEST = T.StructType([
    T.StructField("flightType", T.StringType()),
    T.StructField("agency", T.StringType()),
    T.StructField("from", T.StringType()),
    T.StructField("to", T.StringType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("time", T.DoubleType()),
    T.StructField("day", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("weekday", T.IntegerType()),
])

CLASSIFY_REQUEST = T.StructType([
    T.StructField("first_name", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("first_letter", T.StringType()),
    T.StructField("last_letter", T.StringType()),
    T.StructField("name_length", T.IntegerType()),
    T.StructField("age", T.IntegerType()),
])

HOTEL_REQUEST = T.StructType([
    T.StructField("destination", T.StringType()),
    T.StructField("style", T.StringType()),
    T.StructField("climate", T.StringType()),
    T.StructField("travel_type", T.StringType()),
    T.StructField("amenities", T.ArrayType(T.StringType())),
    T.StructField("budget_max", T.DoubleType()),
    T.StructField("min_stars", T.IntegerType()),
    T.StructField("min_review", T.DoubleType()),
])
