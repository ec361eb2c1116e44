"""Independent SQL for every query key, for DuckDB on the given tables.

Money is kept in whole cents and every quotient is rounded by integer arithmetic,
so that the expected values are exact. Nothing here is used by the library.
"""

from oracle.analyses import ANALYSES
from oracle.intake import INTAKE
from oracle.measures import MEASURES
from oracle.tables import with_tables


def oracle_sql() -> dict[str, str]:
    return {key: with_tables(sql) for key, sql in {**INTAKE, **ANALYSES, **MEASURES}.items()}
