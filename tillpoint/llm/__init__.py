"""Training-data operators: packing, fingerprints, near-duplicate search,
page extraction, line dedup, chat formatting, personal data, language ID,
benchmark decontamination, sharding, hard negatives, license scan and periodic
runs.  Nothing else in the library imports this subpackage.

Functions that run in Python workers are sent by value, so executors need
the public libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
