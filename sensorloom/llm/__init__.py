"""Training-data operators: license scans, language ID, near-duplicates, toxicity, mixing,
repeated passages, vector search, audio fingerprints, personal data and packing.

Functions that run in Python workers are pickled by value, so executors need no copy of
this package on their path.
"""

from pyspark import cloudpickle

import sensorloom

cloudpickle.register_pickle_by_value(sensorloom)
