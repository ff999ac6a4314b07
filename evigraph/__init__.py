"""evigraph: set-at-a-time analytics over evidence graphs, written for Spark.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns.  Nothing in the package collects rows to the driver.
"""

__version__ = "0.1.0"
