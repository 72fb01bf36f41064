"""Market-data research on Spark: trades to bars, features, models, backtests and live signals.

The package is organised as

* ``sources``   - trade store, exchange files, sample tables
* ``operators`` - bars, ordered operators, features, splits, metrics, backtest, ledger, statistics
* ``plans``     - model fitting, subset search, cross-validation, end-to-end studies, net scoring
* ``streaming`` - live bars, tick features, stateful operators
* ``functions`` - intervals, scalar maths, ticker text
* ``catalog``   - named queries over the sample tables
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
