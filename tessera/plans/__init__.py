"""Reports, rollups and backfills, and the catalog of queries."""
