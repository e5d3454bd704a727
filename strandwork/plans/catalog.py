"""All registered queries and their SQL."""

from strandwork.plans import more, queries  # noqa: F401  (more registers its queries)

QUERIES, SQL = queries.QUERIES, queries.SQL
