"""Training-data operators: PII, exact top-k, token counts, quality, packing, line dedup,
SimHash near-dedup, language ID, I-Match fingerprints and source mixing.

Names that begin with an underscore are the operators' own: a column of docs with such a name may be
overwritten; all others pass through or are ignored, whatever they are called.

Nothing else in the library imports this subpackage.  Functions that run on executors are pickled by
value, so a cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
