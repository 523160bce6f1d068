"""Every registered query with the SQL that must give the same rows."""

from catalog import layout, scalars, stored, tables

QUERIES = {**layout.QUERIES, **scalars.QUERIES, **tables.QUERIES, **stored.QUERIES}
