"""frameloom: Spark-first analytics for stacks of image frames and their metadata.

Every operator takes DataFrames and returns a DataFrame; nothing is executed
until the caller runs an action, except where a docstring says otherwise.
"""

__version__ = "0.1.0"
