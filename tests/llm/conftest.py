from __future__ import annotations

import pytest
from check import compare


@pytest.fixture(scope="session")
def check_sql(spark, duck, sf_dir):
    """Compare a registered query with its SQL on the small tables."""
    from tonelake.llm import queries

    def check(name: str) -> None:
        got = queries.QUERIES[name](spark, sf_dir).toPandas()
        assert compare(got, duck.execute(queries.ORACLE_SQL[name]).df()) == ""

    return check
