"""Training-data operators: deduplication, scans, quality, tokenisation.

Nothing else in the library imports this subpackage.  Task code is pickled by
value, so executors need numpy, pyarrow and the other libraries but not this
package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
