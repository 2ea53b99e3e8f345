"""Every registered job that has SQL against that SQL on the smallest data."""

import pytest
from compare import compare
from conftest import SF

from gridspark.catalog.all_jobs import JOBS


@pytest.mark.parametrize("key", [k for k, job in JOBS.items() if job.sql is not None])
def test_job_equals_sql(spark, con, key):
    ok, note = compare(spark, con, JOBS[key], SF)
    assert ok, note


def test_every_job_is_wired():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(JOBS) <= set(entry.queries())
