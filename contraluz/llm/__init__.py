"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import sys

from pyspark.cloudpickle import register_pickle_by_value

# workers need no copy of the library: the functions travel with the plan
register_pickle_by_value(sys.modules[__name__])
