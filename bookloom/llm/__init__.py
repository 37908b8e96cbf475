"""Operators of a pipeline that prepares text for training language models.

Nothing else in the package imports this subpackage. ``queries`` and ``oracle``
hold what is registered; the other modules hold the operators. Functions that
run in tasks are sent by value, so executors need not have the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
