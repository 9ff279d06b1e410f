"""All queries of the library, and their SQL where SQL can express them."""

from __future__ import annotations

from lumenfold.plans import bandmath_queries, file_queries, format_queries, geo_queries, metadata_queries, more_queries, raster_queries, result_queries, spectral_queries

QUERIES = bandmath_queries.QUERIES | file_queries.QUERIES | format_queries.QUERIES | geo_queries.QUERIES | metadata_queries.QUERIES | more_queries.QUERIES | raster_queries.QUERIES | result_queries.QUERIES | spectral_queries.QUERIES
ORACLE = bandmath_queries.ORACLE | file_queries.ORACLE | format_queries.ORACLE | geo_queries.ORACLE | metadata_queries.ORACLE | more_queries.ORACLE | raster_queries.ORACLE | result_queries.ORACLE | spectral_queries.ORACLE
