"""DataFrame operators: ordered scans, time joins, matching, series, payload and sweeps."""
