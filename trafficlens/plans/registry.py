"""All registered queries of the access-log operators."""

from __future__ import annotations

from . import change as _change  # noqa: F401  registers on import
from . import common
from . import keys as _keys  # noqa: F401  registers on import
from . import live as _live  # noqa: F401  registers on import
from . import log as _log  # noqa: F401  registers on import
from . import requests as _requests  # noqa: F401  registers on import


def queries() -> dict:
    return dict(common.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(common.SQL)
