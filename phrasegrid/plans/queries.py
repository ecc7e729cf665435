"""All core queries by name."""

from . import analytics, records

FLAGSHIP = analytics.catalog_evaluation


def queries():
    return records.queries() | analytics.queries()
