"""Hydro-climate panel analytics on Spark DataFrames.

``functions``  column expressions (calendar, units, text, geometry, distributions)
``sources``    table scans and sinks
``operators``  DataFrame -> DataFrame operators
``plans``      the domain panel on the driver tables and the registered queries
"""
