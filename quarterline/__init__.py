"""Programme-indicator reporting on PySpark DataFrames.

``functions``  Column -> Column helpers (classifiers, labels, predicates)
``operators``  DataFrame -> DataFrame verbs (reshape, grid, shares, fills, ...)
``sources``    readers, the area-estimate harvest, writers
``plans``      whole reports composed from the verbs
``workload``   the registered queries, their input tables and their SQL oracles
"""

__version__ = "0.1.0"
