"""thali — restaurant-commerce analytics on PySpark.

Subpackages:

* ``sources``   — model schemas, driver/JDBC scans, the model binding, request tables, sinks, layouts
* ``functions`` — predicates (P), scalar functions (F) and quality rules (V) as Column expressions
* ``operators`` — joins (J), aggregates (A), ordering and paging (O), change jobs (D)
* ``plans``     — the reports and listings (R1–R28) and their SQL twins' model bindings
* ``streaming`` — the live counterparts (T1–T7) on Structured Streaming

``thali.catalog`` registers every query with its SQL twin; ``__spark_entry__`` wires it for the driver.
"""

__version__ = "0.1.0"
