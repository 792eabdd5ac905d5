"""Operators for preparing language-model training data, and their queries.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries
when it is present.
"""

import sys

from pyspark import cloudpickle

# Executors get the operators' functions with the tasks; they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
