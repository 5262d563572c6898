"""Operators for preparing language-model training data.

Nothing else in tidemark imports this subpackage; ``queries.py`` registers
its operators for the driver when the folder is present.
"""

import sys

from pyspark import cloudpickle

# Functions travel to the executors whole, so those need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
