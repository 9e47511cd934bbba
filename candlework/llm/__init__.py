"""Operators of a training-data pipeline.

Functions of this subpackage travel to the executors by value, so workers need numpy, pyarrow and the tokenizer
library, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
