"""Audits of an index that is still growing, by structured streaming."""
