"""Operators of a training-data pipeline, one module per operator.

Nothing else in the package imports this subpackage; ``__spark_entry__.py``
registers :mod:`cohortlake.llm.queries` when it can be imported.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
