"""Imports every query module so that all queries are registered."""

from . import q_profile  # noqa: F401
from . import q_eda  # noqa: F401
from . import q_prep  # noqa: F401
from . import q_metrics  # noqa: F401
from . import q_models  # noqa: F401
from . import q_trust  # noqa: F401
from . import q_io  # noqa: F401
