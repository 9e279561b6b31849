"""All registered queries of the curation operators."""

from . import queries, queries_files, queries_more, queries_rows

assert queries_files and queries_more and queries_rows  # importing them registers their queries

QUERIES, SQL = queries.QUERIES, queries.SQL
