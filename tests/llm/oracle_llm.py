"""Compare this subpackage's queries with their oracle SQL. ``python tests/llm/oracle_llm.py [names…]``."""

from __future__ import annotations

import os
import sys
import time
from types import SimpleNamespace

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), os.path.dirname(os.path.dirname(HERE))]

from oracle import compare, connect  # noqa: E402
from spoor.llm.queries import ORACLES, QUERIES  # noqa: E402


def main(argv):
    from spoor.session import get_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"},
    )
    con, bad = connect(sf), 0
    for name in argv or QUERIES:
        start = time.time()
        problem, n = compare(spark, con, name, SimpleNamespace(run=QUERIES[name], oracle=ORACLES.get(name)), sf)
        bad += problem is not None
        print("BAD" if problem else "ok", name, n, f"{time.time() - start:.1f}s", problem or "", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
