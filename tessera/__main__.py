"""python -m tessera list | show NAME FOLDER [ROWS] | write NAME FOLDER TARGET | explain NAME FOLDER"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession


def main(args: list[str]) -> int:
    from tessera import plans

    if args[:1] == ["list"]:
        print(*sorted(plans.QUERIES), sep="\n")
        return 0
    if len(args) < 3 or args[0] not in ("show", "write", "explain") or args[1] not in plans.QUERIES:
        print(__doc__)
        return 2
    spark = SparkSession.builder.getOrCreate()
    df = plans.QUERIES[args[1]](spark, args[2])
    if args[0] == "show":
        df.show(int(args[3]) if len(args) > 3 else 20, False)
    elif args[0] == "write":
        df.write.parquet(args[3])
    else:
        df.explain("formatted")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
