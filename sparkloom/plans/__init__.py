"""Named queries over the test tables, with the SQL they are held against."""

from sparkloom.plans.generation import GENERATION
from sparkloom.plans.profiling import PROFILING
from sparkloom.plans.rules import RULES
from sparkloom.plans.safety import SAFETY
from sparkloom.plans.scans import SCANS

FLAGSHIP = "column_profile_lineitem"
_ALL = PROFILING + RULES + GENERATION + SCANS + SAFETY


def queries() -> dict:
    return {name: f for name, f, _ in _ALL}


def oracle_sql() -> dict:
    return {name: sql for name, _, sql in _ALL if sql}
