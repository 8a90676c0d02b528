"""Writers: partitioned tables, clustered rewrites, storage reports."""
