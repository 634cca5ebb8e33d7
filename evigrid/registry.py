"""All queries of the library and the SQL they are held against."""

from evigrid.plans import ORACLES, QUERIES, admission, chunk_index, chunking, eventlog, evidence, lifecycle, links, retrieval, streams, tables  # noqa: F401
