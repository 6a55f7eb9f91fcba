"""Sources and sinks: grids, tables, remote services, results."""
