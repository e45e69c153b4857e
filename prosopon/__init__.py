"""Document-corpus analytics on PySpark: documents in, typed tables, listings, audits and change plans out."""

import sys

from pyspark import cloudpickle

from prosopon.profile import Profile

# The two Arrow helpers travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Profile"]
