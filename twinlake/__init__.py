"""Mirroring of snapshots (keyed tables, file listings) with Spark: compare, plan, apply, verify, report."""
