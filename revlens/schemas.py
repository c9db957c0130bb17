"""Table schemas and naming.

Columns are bound by name, never by position. Canonical names are snake_case;
``HEADER_NAMES`` maps them to the display/CSV header of a raw review record.
"""

from pyspark.sql import types as T

RAW_REVIEW = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("grade", T.IntegerType()),
    T.StructField("grade_accepted", T.BooleanType()),
    T.StructField("bank", T.StringType()),
    T.StructField("review", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("proxy_used", T.BooleanType()),
    T.StructField("status", T.StringType()),
    T.StructField("clear_conditions", T.IntegerType()),
    T.StructField("polite_employee", T.IntegerType()),
    T.StructField("availability", T.IntegerType()),
    T.StructField("convenience", T.IntegerType()),
    T.StructField("city", T.StringType()),
    T.StructField("date", T.StringType()),
])

# CSV header of the raw record, in the writer's order.
HEADER_NAMES = {
    "url": "URL", "grade": "Grade", "grade_accepted": "Grade Accepted", "bank": "Bank",
    "review": "Review", "product": "Product", "proxy_used": "Proxy Used", "status": "Status",
    "clear_conditions": "Clear Conditions", "polite_employee": "Polite Employee",
    "availability": "Availability", "convenience": "Convenience", "city": "City", "date": "Date",
}

PROB_COLS = ["NEGATIVE", "NEUTRAL", "POSITIVE"]
RATING_COLS = ["grade", "clear_conditions", "polite_employee", "availability", "convenience"]
SUB_RATING_COLS = ["clear_conditions", "polite_employee", "availability", "convenience"]

# The stand-in review table used by registered queries (see sources.tables).
REVIEWS = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("bank", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("review", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("grade", T.IntegerType()),
    T.StructField("clear_conditions", T.IntegerType()),
    T.StructField("polite_employee", T.IntegerType()),
    T.StructField("availability", T.IntegerType()),
    T.StructField("convenience", T.IntegerType()),
    T.StructField("NEGATIVE", T.DoubleType()),
    T.StructField("NEUTRAL", T.DoubleType()),
    T.StructField("POSITIVE", T.DoubleType()),
])
