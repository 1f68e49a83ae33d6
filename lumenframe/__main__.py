"""``python -m lumenframe list`` or ``python -m lumenframe run QUERY SF_DIR``: the registered queries from a shell."""

from __future__ import annotations

import sys

from . import catalog
from .session import build_session


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(f"{n}{' (SQL)' if n in catalog.ORACLE_SQL else ''}" for n in sorted(catalog.QUERIES)))
        return 0
    if args[:1] == ["run"] and len(args) == 3 and args[1] in catalog.QUERIES:
        catalog.QUERIES[args[1]](build_session(), args[2]).show(100, truncate=80)
        return 0
    print(__doc__)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
