"""Tables by name, cleaned and keyed, on Spark."""

import sys

from pyspark import cloudpickle

from .catalog import get_input_info, get_input_paths
from .functions import *  # noqa: F403
from .functions import __all__ as _functions
from .operators import *  # noqa: F403
from .operators import __all__ as _operators
from .plans import keyed_table
from .sinks import publish_data, save_data
from .sources import *  # noqa: F403
from .sources import __all__ as _sources

# Tasks carry the few helpers they need, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    *_functions,
    *_operators,
    *_sources,
    "get_input_info",
    "get_input_paths",
    "keyed_table",
    "publish_data",
    "save_data",
]
