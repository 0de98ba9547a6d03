"""Readers, the partitioned store, run settings and the driver-table adapters."""
