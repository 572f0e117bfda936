"""Display names of columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_name(name: Column | str) -> Column:
    """``cell_idCount`` -> ``cell id Count``: underscores and camel case become blanks."""
    return F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), "(?<=[a-z])(?=[A-Z][a-z])", " ")
