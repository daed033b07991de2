"""postlens: social-post analytics as Spark DataFrame operators.

Every operator takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing runs until an action is called, except where a docstring
says that a small, bounded result is fetched to build the next plan.
"""

__version__ = "0.1.0"
