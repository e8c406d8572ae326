import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Path of the passenger scoring CSV (FIXTURES F1) whose golden facts are
# checked in test_reference_facts.py; those tests skip when it is not given.
GOLDEN_CSV = os.environ.get("COHORT_GOLDEN_CSV", "")
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from cohort.session import local_session
    s = local_session("*", shuffle_partitions=8, app="cohort-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def passengers(spark):
    """The passenger scoring file (FIXTURES F1), read as data."""
    if not GOLDEN_CSV or not os.path.exists(GOLDEN_CSV):
        pytest.skip("set COHORT_GOLDEN_CSV to the F1 passenger CSV")
    from cohort.sources.files import read_csv
    schema = ("PassengerId int, Pclass int, Name string, Sex string, Age double, SibSp int, "
              "Parch int, Ticket string, Fare double, Cabin string, Embarked string")
    return read_csv(spark, GOLDEN_CSV, schema=schema).cache()
