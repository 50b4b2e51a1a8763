"""Locks, transactions and the log: state of the driver, not of the data."""
