"""furrow: batch analytics on Spark for evidence reviews and gridded farm data.

Everything is DataFrame composition: operators take and return DataFrames (or Columns), stay lazy
unless their docstring says otherwise, and leave the physical plan to Catalyst and AQE.
"""

__version__ = "0.1.0"
