import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sheetscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Make a DataFrame from tuples and a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture
def workbook(rows):
    """Two sheets: three employees and two absences."""
    return {
        "Employes": rows(
            [(1, "Alice", "IT", 60000), (2, "Bob", "RH", 45000), (3, "Carol", "IT", 75000)],
            "ID bigint, Nom string, Departement string, Salaire bigint",
        ),
        "Absences": rows(
            [(1, "2024-01-10", 3), (2, "2024-02-05", 1)], "ID_Employe bigint, Date_Debut string, Duree_Jours bigint"
        ),
    }
