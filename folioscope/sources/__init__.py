"""Readers, admission gates, sinks and the driver-table adapters."""
