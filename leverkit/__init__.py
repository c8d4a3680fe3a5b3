"""leverkit: reliever leverage / runs-saved analytics as Spark DataFrame operators.

Every public operator is a pure ``DataFrame -> DataFrame`` function whose
column names are parameters, so the same code runs on pitch-by-pitch game
data and on any other ordered entity/event table.
"""

__version__ = "0.1.0"
