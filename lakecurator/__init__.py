"""Reconciliation and planning of large media libraries on PySpark."""
