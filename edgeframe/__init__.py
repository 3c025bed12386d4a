"""edgeframe: vertex and edge tables on Spark.

Gather vertex values onto edges, map them with vector expressions, sum by row or over
everything.  See README.md.
"""

from .functions import UnsupportedOperation, V, where
from .operators import *  # noqa: F401,F403
from .operators import __all__ as _operators
from .plans import EdgeProgram, mesh_job
from .sources import *  # noqa: F401,F403
from .sources import __all__ as _sources

__all__ = ["EdgeProgram", "UnsupportedOperation", "V", "mesh_job", "where", *_operators, *_sources]
