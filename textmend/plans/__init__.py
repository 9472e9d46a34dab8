"""Whole documents: from files or tables to corrected lines, pages and reports."""
