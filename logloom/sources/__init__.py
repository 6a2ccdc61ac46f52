"""Log scans, normalisers, table snapshots and exports."""
