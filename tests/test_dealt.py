"""Rows whose texts make long work are dealt to all cores, also where their file is one split."""

import pytest
from pyspark.sql import functions as F

from veladura.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["audit_fix", "audit_warnings", "download_forced", "coverage_log", "old_left_over", "field_names", "field_places"])
def test_work_reaches_all_cores(spark, name):
    tasks = QUERIES[name](spark, SF).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism
