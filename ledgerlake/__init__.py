"""Retail-sales lakehouse jobs written as plain DataFrame functions.

functions/  column expressions and job parameters
operators/  DataFrame -> DataFrame steps
sources/    readers and writers
plans/      whole jobs built from the above
"""
