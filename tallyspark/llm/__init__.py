"""Operators of a training-data pipeline, one module each.

Nothing else in the library imports this package; its queries are in
``queries.py`` and its staged job in ``corpus_pipeline.py`` at the top of the
repository.
"""

import sys

from pyspark import cloudpickle

# The functions that run inside tasks travel with the job, so executors need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
