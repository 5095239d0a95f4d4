"""States of uploads."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F


def upload_status(readable: Column, has_gps: Column) -> Column:
    """The status of the files of a group (an aggregate): two positions make a survey; nothing readable is an error; the rest is
    a warning."""
    return F.when(F.count_if(readable & has_gps) >= 2, "ready_for_processing").when(F.count_if(readable) == 0, "error").otherwise("warning_no_gps")
