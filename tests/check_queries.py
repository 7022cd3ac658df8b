"""Command line: compare queries with their SQL. Usage: python -m tests.check_queries [sf] [name-part ...]"""

import sys
import time

from cotejo.catalog import registry
from cotejo.session import local_session
from tests import oracle


def main(argv):
    sf = argv[0] if argv else "0.001"
    parts = argv[1:]
    sf_dir = f"{oracle.DATA}/sf{sf}"
    spark, con = local_session(), oracle.connect(sf_dir)
    failed = 0
    for name, (fn, sql) in registry().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if sql is None:
                n = df.count()
                msg = None if n else "EMPTY"
                note = f"rows-only n={n}"
            else:
                msg, note = oracle.compare(df, sql, con), ""
        except Exception as e:
            msg, note = f"{type(e).__name__}: {str(e)[:700]}", ""
        failed += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {time.time() - t:.1f}s {note} {msg or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
