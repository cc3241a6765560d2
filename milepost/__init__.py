"""milepost: milestone forecasting for land-acquisition projects on Spark.

Subpackages: ``sources`` (tables, fixtures, snapshots), ``functions`` (column
expressions, codes, quantiles), ``operators`` (master dataset, features,
statistics, training, forecast, snapshot, scoring), ``plans`` (jobs, service
calls, registered queries and oracles) and ``streaming`` (request scoring).
"""

__version__ = "0.1.0"
