"""Schemas, readers, sinks and the adapters that derive a panel from transactional tables."""
