"""Operators of a large-scale training-data pipeline: decontamination, mixing, language-model
scoring, personal data, repeated passages, web archives, near-duplicates, language and main text.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Python workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
