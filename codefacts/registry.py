"""All registered queries of the engine and their SQL twins."""

from codefacts.queries import ORACLE_SQL, QUERIES, building, indexing, merging, navigating, ordering, placing, reading, rules, scalars, streams

__all__ = ["ORACLE_SQL", "QUERIES", "building", "indexing", "merging", "navigating", "ordering", "placing", "reading", "rules", "scalars", "streams"]
