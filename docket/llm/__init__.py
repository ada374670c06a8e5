"""Training-data operators over a corpus of documents and pages. Nothing outside this package imports it.

Functions of this package that run on executors travel by value, so executors need the public libraries they use but not
this package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
