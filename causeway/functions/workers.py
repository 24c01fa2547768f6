"""Worker functions that travel with their code, so executors need not have this package installed."""

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])
