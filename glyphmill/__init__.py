"""glyphmill: DataFrame operators that build, clean, split, augment and evaluate text datasets on Spark."""

import sys

from pyspark import cloudpickle

from .session import build_session, checkpoint_dir

# functions for Python workers travel with their code, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "checkpoint_dir"]
