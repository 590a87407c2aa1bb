"""Names of the queries the driver runs, with the SQL that gives the same rows."""

from __future__ import annotations

from .evaluation import ORACLE as _A
from .evaluation import QUERIES as _a
from .events import ORACLE as _B
from .events import QUERIES as _b
from .text import ORACLE as _C
from .text import QUERIES as _c
from .dataset import ORACLE as _D
from .dataset import QUERIES as _d
from .hub import ORACLE as _E
from .hub import QUERIES as _e

FLAGSHIP = "metric_rollup"
QUERIES: dict = {**_a, **_b, **_c, **_d, **_e}
ORACLE_SQL: dict[str, str] = {**_A, **_B, **_C, **_D, **_E}
